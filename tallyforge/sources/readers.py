"""Reading tables, record files and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# --- fixed values: first bytes and content types of the files that are accepted ---
MAGIC = {"pdf": "25504446", "xlsx": "504B0304", "xls": "D0CF11E0"}
TYPES = {
    "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "csv": "text/csv",
}
# --- end of fixed values ---


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _name(pattern: str) -> Column:
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def sheets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Delimited sheets with their file's name in ``sheet``; rows and columns that are all
    empty drop out."""
    df = spark.read.csv(path, header=True, **options).dropna("all")
    return without_empty_columns(df).withColumn("sheet", _name(r"([^/]+)\.[^.]*$"))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """The columns that hold any value: one pass counts all of them."""
    if not df.columns:
        return df
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[i]])


def headerless(spark: SparkSession, path: str, columns: int = 100) -> DataFrame:
    """Delimited text without a header: columns c0, c1, ...; cells that a line lacks are null,
    lines with more than ``columns`` cells drop out."""
    schema = ", ".join(f"c{i} string" for i in range(columns)) + ", _corrupt_record string"
    read = spark.read.csv(path, header=False, schema=schema, mode="PERMISSIVE", enforceSchema=True, columnNameOfCorruptRecord="_corrupt_record")
    # a line is marked if it has too few cells as well: what is wrong is told by a filled last cell
    wide = F.col("_corrupt_record").isNotNull() & F.col(f"c{columns - 1}").isNotNull()
    return read.where(~wide).drop("_corrupt_record").dropna("all")


def records(spark: SparkSession, path, containers=("claims", "invoices", "data")) -> DataFrame:
    """JSON files that hold a list of records, or an object with the list in one of
    ``containers``, the first that it has; each record with its file's name in
    ``SOURCE_FILE``.  Files of every kind may be mixed; files that are gone are skipped."""
    df = spark.read.option("ignoreMissingFiles", True).json(path, multiLine=True)
    named = df.withColumn("SOURCE_FILE", _name(r"([^/]+)$"))
    found = [c for c in containers if c in df.columns and isinstance(df.schema[c].dataType, ArrayType)]
    if not found:
        return named
    rest, parts = named, []
    for c in found:
        e = rest.where(F.col(c).isNotNull()).select("SOURCE_FILE", F.explode(c).alias("r"))
        parts.append(e.select("r.*", "SOURCE_FILE") if isinstance(df.schema[c].dataType.elementType, StructType) else e.select(F.col("r").alias("value"), "SOURCE_FILE"))
        rest = rest.where(F.col(c).isNull())
    plain = rest.drop(*found)
    if len(plain.columns) > 1:
        parts.append(plain.dropna("all", subset=[c for c in plain.columns if c != "SOURCE_FILE"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def content_type(content: Column) -> Column:
    """The type by the first bytes; text without control characters counts as text/csv."""
    magic = F.upper(F.hex(F.substring(content, 1, 4)))
    out = F.when(~F.hex(F.substring(content, 1, 1000)).rlike(r"^(?:..)*?0[0-8]"), F.lit(TYPES["csv"]))
    for ext, first in MAGIC.items():
        out = F.when(magic == first, TYPES[ext]).otherwise(out)
    return out


def validated(found: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """Files with their hash, their type by content, and the first reason against them, null
    if there is none."""
    ext = extension(F.col("path"))
    magic = F.upper(F.hex(F.substring("content", 1, 4)))
    allowed = F.try_element_at(F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv]), ext)
    reason = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(~ext.isin(*MAGIC, "csv"), "type")
        .when(allowed.isNotNull() & (magic != allowed), "content is not what the name says")
        .when((ext == "csv") & ~content_type(F.col("content")).eqNullSafe(F.lit(TYPES["csv"])), "content is not what the name says")
    )
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"), content_type(F.col("content")).alias("type"), reason.alias("rejected"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns: the name itself if present, else the first alias, without regard to
    case; missing ones are null.  Of columns with one name the first counts."""
    lower: dict[str, str] = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    pick = {n: next((lower[a.lower()] for a in [n, *names] if a.lower() in lower), None) for n, names in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in pick.items()])


def reindexed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Fixed columns in fixed order and type: missing ones null, others dropped."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in any of the columns."""
    return df.dropna("all", subset=columns)


def at_least(df: DataFrame, cells: int) -> DataFrame:
    """Rows with so many cells that are not null."""
    return df.dropna(thresh=cells)
