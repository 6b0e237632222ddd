"""Workers' compensation applications: nested records to tables, and merges of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(docs: DataFrame, key: str, arrays: list[str], structs: list[str], maps: list[str]) -> dict[str, DataFrame]:
    """A table per part: array elements as rows, structs as columns, maps as (question, answer)."""
    out = {a: docs.select(key, F.explode(a).alias("x")).select(key, "x.*") for a in arrays}
    out |= {s: docs.select(key, f"{s}.*") for s in structs}
    return out | {m: docs.select(key, F.explode(m).alias("question", "answer")) for m in maps}


def any_yes(answers: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Y if any part of the application says Y."""
    return answers.groupBy(*keys).agg(F.when(F.max((F.upper(F.trim(F.coalesce(answer, F.lit("")))).isin("Y", "YES")).cast("int")) == 1, "Y").otherwise("N").alias(answer))


def longest(parts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The longest value over all parts; the earliest of equally long ones."""
    return parts.where(F.col(text).isNotNull()).groupBy(key).agg(F.max_by(text, F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"))).alias(text))


def fill_later(parts: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's first value that is neither empty nor N/A, in order of the parts."""
    real = lambda c: F.when(~F.upper(F.trim(c)).isin("", "N/A", "NA"), F.col(c))
    return parts.groupBy(key).agg(*[F.min_by(real(c), F.when(real(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def dedupe_rating(rows: DataFrame, keys: list[str], payroll: str, order: list[str]) -> DataFrame:
    """Of each key the distinct payrolls above zero, or one row without payroll if there is
    no other."""
    p = F.round(F.coalesce(F.col(payroll), F.lit(0)), 2)
    r = rows.withColumn("__p", F.when(p > 0, p)).withColumn("__any", F.max(F.col("__p").isNotNull().cast("int")).over(Window.partitionBy(*keys)))
    r = r.where((F.col("__any") == 0) | F.col("__p").isNotNull())
    return r.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))).where("__n = 1").drop("__p", "__any", "__n")


def total_premium(calculated: Column, ratings: Column, field: str) -> Column:
    """The calculated premium, else the sum over the rating rows."""
    s = F.aggregate(ratings, F.lit(0.0), lambda a, x: a + F.coalesce(x[field].try_cast("double"), F.lit(0.0)))
    return F.coalesce(F.nullif(calculated.try_cast("double"), F.lit(0.0)), s)


def stitch(rows: DataFrame, part: str, order: str, code: str, amount: str) -> DataFrame:
    """An amount on a row of its own goes to the row before that has a code and no amount."""
    w = Window.partitionBy(part).orderBy(order)
    orphan = lambda c, a: c.isNull() & a.isNotNull()
    c, a = F.col(code), F.col(amount)
    r = rows.withColumn("__after", F.when(orphan(F.lead(code).over(w), F.lead(amount).over(w)), F.lead(amount).over(w))).withColumn("__open", F.coalesce(F.lag(c.isNotNull() & a.isNull()).over(w), F.lit(False)))
    r = r.withColumn(amount, F.when(c.isNotNull() & a.isNull(), F.col("__after")).otherwise(a))
    return r.where(~(c.isNull() & F.col("__open"))).drop("__after", "__open")


def stitched_lines(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Lines with amounts that stand alone put into their rating row: the next line if it is
    one, else the row that they follow, alone or with other amounts.  An amount goes before
    the rate of 0.000, or to the end."""
    orphan, rating = F.col(line).rlike(r"^\s*\$?[\d,]+\s*$"), F.trim(line).rlike(r"^.*?\b\d{4}\b.*?\b[A-Z]{2}\b")
    w = Window.partitionBy(doc).orderBy(pos)
    r = lines.select(doc, pos, line, orphan.alias("o"), (rating & ~orphan).alias("r"))
    r = r.withColumn("next", F.when(F.lead("r").over(w), F.lead(pos).over(w)))
    r = r.withColumn("before", F.last(F.when(~F.col("o"), F.struct(F.col(pos).alias("p"), F.col("r").alias("r"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    goes = F.when(F.col("o"), F.coalesce("next", F.when(F.col("before.r"), F.col("before.p"))))
    r = r.withColumn("to", F.coalesce(goes, F.col(pos)))
    g = r.groupBy(doc, F.col("to").alias(pos)).agg(F.max(F.when(F.col("to") == F.col(pos), F.col(line))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("to") != F.col(pos), F.struct(pos, F.trim(line).alias("x"))))).alias("more"))
    amounts = F.array_join(F.transform("more", lambda x: x["x"]), "    ")
    at = F.locate("0.000", F.col("own"))
    merged = F.when(at > 0, F.concat(F.left("own", at - 1), amounts, F.lit("    "), F.substring("own", at, F.length("own")))).otherwise(F.concat(F.rtrim("own"), F.lit("    "), amounts))
    return g.select(doc, pos, F.when(F.size("more") > 0, merged).otherwise(F.col("own")).alias(line))
