"""Workbooks (.xlsx): sheets to rows with typed cells, and tables to sheets.

Files come through Spark's binary reader, so any store will do.  A task opens a file and
hands on its sheets, packed as they are; each sheet is then a row of its own, dealt to a
task, which streams it and holds no more than a batch of rows.  Writing streams the rows
of each table through the driver into one file, batch by batch: a workbook is one zip,
and a sheet ends at 1048576 rows, beyond which a table goes on in another sheet.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

# --- fixed values of the format ---
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1048576
#: Built-in number formats that show a day, or a time.
DAY_FORMATS = (14, 15, 16, 17)
TIME_FORMATS = (18, 19, 20, 21, 22, 45, 46, 47)
DAY_ZERO = datetime.datetime(1899, 12, 30)
# --- end of fixed values ---
BATCH = 10000

CELL = "struct<v string, k string>"


def _number_kinds(styles: bytes | None) -> list[str]:
    """For each cell style: n (a number), d (a day) or t (a time)."""
    if styles is None:
        return []
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()) for f in root.iter(f"{MAIN}numFmt")}

    def kind(number: int) -> str:
        code = own.get(number, "")
        if number in TIME_FORMATS or re.search("[hs]", code):
            return "t"
        return "d" if number in DAY_FORMATS or re.search("[dy]", code) else "n"

    xfs = root.find(f"{MAIN}cellXfs")
    return [kind(int(x.get("numFmtId", 0))) for x in ([] if xfs is None else xfs)]


def _strings(shared: bytes | None) -> list[str]:
    if shared is None:
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(shared).iter(f"{MAIN}si")]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shown(text: str, kind: str) -> str:
    number = float(text)
    if kind == "n":
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    at = DAY_ZERO + datetime.timedelta(seconds=round(number * 86400))
    return at.date().isoformat() if kind == "d" else at.isoformat(sep=" ")


def _rows(sheet: bytes, strings: list[str], kinds: list[str]) -> Iterator[tuple[int, list[dict | None]]]:
    """(row number, cells) of all rows that have a value."""
    number = 0
    for _, row in ElementTree.iterparse(io.BytesIO(sheet)):
        if row.tag != f"{MAIN}row":
            continue
        number = int(row.get("r") or number + 1)
        cells: list[dict | None] = []
        for i, c in enumerate(row.iter(f"{MAIN}c")):
            at = _column(c.get("r")) if c.get("r") else i
            kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else None if v is None else v.text
            if text is None or kind == "e" or not text.strip():
                continue
            style = int(c.get("s", 0))
            if kind == "s":
                cell = {"v": strings[int(text)], "k": "s"}
            elif kind in ("inlineStr", "str"):
                cell = {"v": text, "k": "s"}
            elif kind == "b":
                cell = {"v": "true" if text == "1" else "false", "k": "b"}
            else:
                k = kinds[style] if style < len(kinds) else "n"
                cell = {"v": _shown(text, k), "k": k}
            cells += [None] * (at + 1 - len(cells))
            cells[at] = cell if cell["v"].strip() else None
        row.clear()
        if any(cells):
            yield number, cells


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells): every row that is not empty of every sheet of the workbooks
    at ``path``; a cell has a value ``v`` as text and a kind ``k``: s text, n number, b
    boolean, d day, t time."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    there = set(z.namelist())
                    part = lambda n: z.read(n) if n in there else None  # noqa: B023, E731
                    to = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
                        target = to[s.get(LINK)]
                        data = z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
                        yield pd.DataFrame({"file": [path_], "sheet": [s.get("name")], "data": [zlib.compress(data, 1)], "shared": [part("xl/sharedStrings.xml")], "styles": [part("xl/styles.xml")]})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, sheet, data, shared, styles in zip(b["file"], b["sheet"], b["data"], b["shared"], b["styles"]):
                out = []
                for number, row in _rows(zlib.decompress(data), _strings(shared), _number_kinds(styles)):
                    out.append((file, sheet, number, row))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=["file", "sheet", "row", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sheets = files.mapInPandas(opened, "file string, sheet string, data binary, shared binary, styles binary")
    return sheets.repartition("file", "sheet").mapInPandas(parsed, f"file string, sheet string, row long, cells array<{CELL}>")


TYPES = {"n": "double", "b": "boolean", "d": "date", "t": "timestamp"}


def read(spark: SparkSession, path: str, sheet: str | None = None, typed: bool = True) -> DataFrame:
    """The rows below the first row that is not empty of each sheet (or of those named
    ``sheet``), which names the columns, with file and sheet.  Columns are joined by name
    over sheets and files; empty rows and columns drop out.  ``typed`` columns whose
    cells are all of one kind have its type, others are text."""
    rows = cells(spark, path)
    if sheet is not None:
        rows = rows.where(F.col("sheet") == sheet)
    heads = rows.groupBy("file", "sheet").agg(F.min(F.struct("row", F.transform("cells", lambda c: F.trim(c["v"])).alias("names"))).alias("h"))
    heads = heads.select("file", "sheet", F.col("h.row").alias("first"), F.col("h.names").alias("names"))
    body = rows.join(heads, ["file", "sheet"]).where("row > first")
    named = body.select("file", "sheet", "row", F.explode(F.filter(F.arrays_zip("names", "cells"), lambda z: z["names"].isNotNull() & z["cells"].isNotNull())).alias("z"))
    kinds = named.groupBy(F.col("z.names").alias("name")).agg(F.collect_set("z.cells.k").alias("kinds"), F.min("z.names").alias("n"))
    order = heads.select(F.posexplode("names").alias("at", "name")).where("name IS NOT NULL").groupBy("name").agg(F.min("at").alias("at"))
    columns = [(r["name"], r["kinds"]) for r in kinds.join(order, "name").orderBy("at", "name").collect()]  # as many as there are columns

    def value(name: str, kinds: list[str]) -> Column:
        at = F.array_position("names", name)
        text = F.when(at > 0, F.get("cells", (at - 1).cast("int"))["v"])
        return (text.try_cast(TYPES[kinds[0]]) if typed and len(kinds) == 1 and kinds[0] in TYPES else text).alias(name)

    return body.select("file", "sheet", "row", *[value(n, k) for n, k in columns])


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(value: str) -> str:
    return f'<is><t xml:space="preserve">{escape(CONTROLS.sub("", value))}</t></is>'


def _cell(at: str, value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.datetime):
        return f'<c r="{at}" s="2"><v>{(value.replace(tzinfo=None) - DAY_ZERO) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c r="{at}" s="1"><v>{(datetime.datetime(value.year, value.month, value.day) - DAY_ZERO).days}</v></c>'
    if isinstance(value, str):
        return f'<c r="{at}" t="inlineStr">{_text(value)}</c>'
    return f'<c r="{at}"><v>{value}</v></c>'


def _sheet_rows(df: DataFrame, header: list[str]) -> Iterator[str]:
    """The XML of the rows, made in the tasks, in order, batch by batch."""
    names, places = df.columns, [_name(i) for i in range(len(header))]
    plain = (T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    df = df.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields])

    def lines(rows: Iterator) -> Iterator[str]:
        """Cells without the row number, which tasks cannot know: it goes in for the mark."""
        for r in rows:
            yield "".join(_cell(f"{places[i]}\0", v) for i, v in enumerate(r))

    yield "".join(_cell(f"{places[i]}\0", n) for i, n in enumerate(names))
    yield from df.rdd.mapPartitions(lines).toLocalIterator(prefetchPartitions=True)


class _Out(io.RawIOBase):
    """A file of any store, written from its start to its end."""

    def __init__(self, spark: SparkSession, path: str):
        p, fs = store._at(spark, path)
        self.stream, self.at, self.held = fs.create(p, True), 0, bytearray()

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at

    def write(self, data) -> int:
        self.held += data
        self.at += len(data)
        if len(self.held) > 1 << 20:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(self.held)
            self.held = bytearray()

    def finish(self) -> None:
        self.flush()
        self.stream.close()


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
NAMESPACE = MAIN[1:-1]
OFFICE = LINK[1:].split("}")[0]


def write(tables: dict[str, DataFrame], path: str, most_rows: int = MOST_ROWS) -> list[str]:
    """A workbook with a sheet per table, named and typed; returns the names of its sheets.
    A table of more than ``most_rows`` rows, the header among them, goes on in further
    sheets, each with the header."""
    spark = next(iter(tables.values())).sparkSession
    out, sheets = _Out(spark, path), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            rows = _sheet_rows(df, df.columns)
            header = next(rows)
            left, piece = next(rows, None), 1
            while True:
                label = re.sub(r"[\[\]:*?/\\]", "_", name)[:26] + (f" {piece}" if piece > 1 else "")
                sheets.append(label)
                with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as f:
                    f.write(f'{HEAD}<worksheet xmlns="{NAMESPACE}"><sheetData><row r="1">{header.replace(chr(0), "1")}</row>'.encode())
                    n = 1
                    while left is not None and n < most_rows:
                        n += 1
                        f.write(f'<row r="{n}">{left.replace(chr(0), str(n))}</row>'.encode())
                        left = next(rows, None)
                    f.write(b"</sheetData></worksheet>")
                if left is None:
                    break
                piece += 1
        ids = range(1, len(sheets) + 1)
        rel = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{rel}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{rel}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{rel}.worksheet+xml"/>' for i in ids) + "</Types>")
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{NAMESPACE}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(ids, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + f'<Relationship Id="rId0" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{NAMESPACE}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
    out.finish()
    return sheets
