"""Lines of text to rows, and sequences within a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import scan


def to_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def join_continuations(lines: DataFrame, doc: str, order: str, text: str, starts: Column) -> DataFrame:
    """Lines that start no row are appended to the row before; what stands before the first
    row of a document drops out."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("__run", F.count_if(starts).over(w)).where("__run > 0")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs.groupBy(doc, F.col("__run").alias("row")).agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text))


def dated_row(line: Column) -> Column:
    """(date, description, amount text) of ``MM/DD description amount``; null if it is no such line."""
    pattern = r"^\s*(\d{1,2}/\d{1,2})\s+(.*?)\s+(-?\(?\$?[\d,]*\.\d{2}\)?-?)\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("date"), part(2).alias("description"), part(3).alias("amount")))


def repeated_triples(lines: DataFrame, text: str, keep: list[str], pattern: str = r"(\d{3,})\s+(\d{1,2}/\d{1,2})\s+([\d,]*\.\d{2})") -> DataFrame:
    """Every ``number date amount`` of a line as a row."""
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "number"), (2, "date"), (3, "amount"))])
    return lines.select(*keep, F.posexplode(found).alias("n", "t")).select(*keep, "n", "t.number", "t.date", "t.amount")


def section(text: Column, start: str, ends: list[str]) -> Column:
    """From the first match of ``start`` to the earliest match of an end after it, or the
    end of the text; null if there is no start."""
    begin = F.regexp_instr(text, F.lit(start))
    rest = F.substring(text, begin, F.length(text))
    after = F.substring(rest, 2, F.length(rest))
    stops = [F.nullif(F.regexp_instr(after, F.lit(e)), F.lit(0)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0]
    return F.when(begin > 0, F.when(stop.isNotNull(), F.substring(rest, F.lit(1), stop)).otherwise(rest))


def headers_apart(marks: DataFrame, doc: str, at: str, gap: int, crowded: int = 4096) -> DataFrame:
    """Header positions at least ``gap`` + 1 after the last one that was taken.

    What is taken depends on what was: the marks of a document are folded in order, if they
    are at most ``crowded``.  The marks of larger ones are not gathered.  There each mark
    points at the first one more than ``gap`` behind it; what is taken is the chain of
    pointers from the first mark, and doubling the pointers marks it in rounds that grow
    with the logarithm of its length.  Each round is a written table.
    """
    marks = marks.select(doc, at).where(F.col(at).isNotNull()).distinct()
    sized = marks.groupBy(doc).agg(F.count("*").alias("n"))
    g = marks.join(sized.where(F.col("n") <= crowded).select(doc), doc, "left_semi").groupBy(doc).agg(F.array_sort(F.collect_list(at)).alias("a"))
    fold = F.aggregate("a", F.slice("a", 1, 0), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.array_append(kept, x)).otherwise(kept))
    few = g.select(doc, F.explode(fold).alias(at))
    most = sized.agg(F.max("n")).first()[0] or 0
    if most <= crowded:
        return few
    many = marks.join(sized.where(F.col("n") > crowded).select(doc), doc, "left_semi")
    return few.unionByName(_chained(many, doc, at, gap, most))


def _chained(marks: DataFrame, doc: str, at: str, gap: int, most: int) -> DataFrame:
    # the first mark behind each position + gap: a scan from the end, marks before positions at a tie
    both = marks.select(doc, F.col(at).alias("p"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema[at].dataType).alias("from"))
    both = both.unionByName(marks.select(doc, (F.col(at) + gap + 1).alias("p"), F.lit(0).alias("side"), F.col(at).alias("from")))
    back = both.withColumn("__p", -F.col("p")).withColumn("__side", -F.col("side"))
    found = scan.running(back, doc, ["__p", "__side"], {"to": ("last", F.when(F.col("side") == 1, F.col("p")))}, crowded=scan.CROWDED)
    jumps = shared.written(found.where("side = 0 AND to IS NOT NULL").select(doc, "from", "to"), "jumps")
    taken = shared.written(marks.groupBy(doc).agg(F.min(at).alias(at)), "taken")
    for _ in range(max(1, int(most)).bit_length()):
        # the chain so far and as much again; then jumps of twice the length
        more = taken.join(jumps.withColumnRenamed("from", at), [doc, at]).select(doc, F.col("to").alias(at))
        if more.isEmpty():
            break
        taken = shared.written(taken.unionByName(more).distinct(), "taken")
        then = jumps.select(doc, F.col("from").alias("to"), F.col("to").alias("__to"))
        jumps = shared.written(jumps.join(then, [doc, "to"]).select(doc, "from", F.col("__to").alias("to")), "jumps")
    return taken


def new_starts(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(part).orderBy(*order)
    return rows.withColumn("__b", F.lag(value).over(w)).where(~F.col("__b").eqNullSafe(F.col(value)) | F.col("__b").isNull()).drop("__b")


def first_rows(rows: DataFrame, part: str, order: list[str], most: Column) -> DataFrame:
    """At most as many rows of each part as expected."""
    w = Window.partitionBy(part).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def batches(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Ids of each part in batches."""
    w = Window.partitionBy(part).orderBy(order)
    b = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return b.groupBy(part, "batch").agg(F.array_sort(F.collect_list(order)).alias("ids"))


def logical_page(text: Column, physical: Column) -> Column:
    """The page number that the page states (``Page 3 of 9``, else ``Page 3``), else its place."""
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int")
    return F.coalesce(number(r"(?i)page\s+(\d+)\s+of\s+\d+"), number(r"(?i)page\s+(\d+)"), physical.cast("int"))


def year_order(year: Column) -> list[Column]:
    """Sort keys: numeric years first, by number, then text."""
    n = year.try_cast("int")
    return [n.isNull(), n, year]


def explode_years(rows: DataFrame, years: str, order: list[str]) -> DataFrame:
    """A row per year of a comma-separated list; of each year the first record in order."""
    e = rows.withColumn("year", F.explode(F.split(years, r"\s*,\s*"))).withColumn("year", F.trim("year"))
    w = Window.partitionBy("year").orderBy(*order)
    return e.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cascade_match(left: DataFrame, right: DataFrame, key: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(key, match, rule): each row of ``left`` with the least ``id`` of ``right`` that the
    first rule with any match gives.  A rule is a name and a key expression on either side;
    rows that one rule has matched do not reach the next.

    The rules' answers are one table, with the keys that both sides have; rows are joined to
    it rule by rule, and those that have no key to ask for are dealt by their own."""
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), lk.cast("string").alias("__k")) for i, (_, lk, _) in enumerate(rules)]))
    asked = left.select(asked.alias("a")).select("a.*").where("__k <> ''").distinct()
    known = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), rk.cast("string").alias("__k"), F.col("id")) for i, (_, _, rk) in enumerate(rules)]))
    known = right.select(known.alias("a")).select("a.*").where("__k <> ''").groupBy("i", "__k").agg(F.min("id").alias("match"))
    answers = shared.written(known.join(asked, ["i", "__k"], "left_semi"), "matches")
    rest = left.select(F.col(key), *[lk.cast("string").alias(f"__k{i}") for i, (_, lk, _) in enumerate(rules)])
    rest = rest.withColumns({"match": F.lit(None).cast(answers.schema["match"].dataType), "rule": F.lit(None).cast("string")})
    for i, (name, _, _) in enumerate(rules):
        k = F.when(F.col("match").isNull() & (F.col(f"__k{i}") != ""), F.col(f"__k{i}")).otherwise(F.concat(F.lit("\0"), F.xxhash64(key).cast("string")))
        of = answers.where(F.col("i") == i).select(F.col("__k"), F.col("match").alias("__m"))
        rest = rest.withColumn("__k", k).join(of, "__k", "left")
        rest = rest.withColumn("rule", F.when(F.col("__m").isNotNull(), F.lit(name)).otherwise(F.col("rule"))).withColumn("match", F.coalesce("match", "__m")).drop("__k", "__m", f"__k{i}")
    return rest.where("match IS NOT NULL").select(key, "match", "rule")


def absent(rows: DataFrame, known: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows that ``known`` lacks by the given key expressions, which both sides have."""
    k = known.select(*[c.alias(f"__{n}") for n, c in keys.items()]).distinct()
    r = rows.withColumns({f"__{n}": c for n, c in keys.items()})
    cond = reduce(lambda a, b: a & b, [r[f"__{n}"].eqNullSafe(k[f"__{n}"]) for n in keys])
    return r.join(k, cond, "left_anti").select(*rows.columns)


def append_absent(rows: DataFrame, more: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` and those of ``more`` whose keys they lack, of rows of equal keys the first;
    keys of rows without the first key are not looked at."""
    known = rows.where(F.col(keys[0]).isNotNull())
    new = absent(more, known, {k: F.col(k) for k in keys})
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.unionByName(new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), allowMissingColumns=True)


def fallback(rows: DataFrame, second: DataFrame, first: str, last: str) -> DataFrame:
    """``rows`` and those of a second reading whose ``FIRST_LAST`` name no row with a last name has."""
    name = F.concat_ws("_", F.upper(F.coalesce(first, F.lit("NONE"))), F.upper(F.coalesce(last, F.lit("NONE"))))
    return rows.unionByName(absent(second, rows.where(F.coalesce(last, F.lit("")) != ""), {"name": name}), allowMissingColumns=True)


def cells(line: Column) -> Column:
    """The trimmed cells between a line's bars; a bar at either end bounds no cell."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
