"""Cleaning, matching and choosing among claim records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_corporate, no_sentinel, zero_stripped
from . import scan


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order.

    Spark drops all but one row a key before it shuffles for this window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best_version(df: DataFrame, key: str, order: list[str], score: str, date: str, details: list[str], crowded: int = scan.CROWDED) -> DataFrame:
    """One record per key, as if its copies were merged one by one in order.

    A copy takes over if its score is better than all before it and it has a date or none
    before it has, or if it alone has a date.  The loser fills the winner's empty details.
    So a detail comes from the last copy that took over and has it, else from the first of
    the others that has it; what takes over follows from the best score and the number of
    dates before it.  Nothing is gathered, whatever the number of copies.
    """
    seen = {"__best": ("max", F.col(score)), "__dated": ("count", F.col(date))}
    r = scan.running(df, key, order, seen, inclusive=False, crowded=crowded)
    better, new, none = F.coalesce(F.col(score) > F.col("__best"), F.lit(False)), F.col(date).isNotNull(), F.col("__dated") == 0
    r = r.withColumn("__takes", (better & (new | none)) | (none & new))
    at = F.struct(*order)
    has = lambda c, takes: F.when(F.col(c).isNotNull() & (F.col("__takes") == takes), at)
    # the first copy holds until one takes over; like those that lose later it fills what is missing, in order
    pick = lambda c: F.coalesce(F.max_by(c, has(c, True)), F.min_by(c, has(c, False))).alias(c)
    return r.groupBy(key).agg(F.count("*").alias("copies"), *[pick(c) for c in [date, *details]], F.max(score).alias("best_score"))


def missing_from(master: DataFrame, found: DataFrame, key: str, zero_insensitive: bool = False) -> DataFrame:
    """Keys of ``master`` that ``found`` lacks; zeros in front may be ignored."""
    k = zero_stripped(F.col(key)) if zero_insensitive else F.col(key)
    return master.select(key, k.alias("__k")).distinct().join(found.select(k.alias("__k")), "__k", "left_anti").drop("__k")


def listed(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the master list, zeros in front ignored."""
    return df.withColumn("__k", zero_stripped(F.col(key))).join(master.select(zero_stripped(F.col(key)).alias("__k")), "__k", "left_semi").drop("__k")


def phantom(name: Column, amounts: list[Column], description: Column) -> Column:
    """True for header lines taken for claims: a company's or no name, no money and no
    description of over ten characters."""
    money = F.lit(False)
    for a in amounts:
        money = money | (F.coalesce(a.cast("double"), F.lit(0.0)) > 0)
    d = F.trim(F.lower(F.coalesce(description, F.lit(""))))
    described = ~d.isin("", "null", "none", "n/a", "unknown") & (F.length(d) > 10)
    return (is_corporate(name) | no_sentinel(F.coalesce(name, F.lit(""))).isNull()) & ~money & ~described


def math_check(parts: list[Column], reported: Column, tolerance: float) -> Column:
    """(diff, valid) of a reported total against its parts."""
    diff = F.round(F.abs(sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))) - F.coalesce(reported, F.lit(0))), 2)
    return F.struct(diff.cast("double").alias("diff"), (diff < tolerance).alias("valid"))


def nearest_before(events: DataFrame, anchors: DataFrame, part: str, at: str, value: str, crowded: int = scan.CROWDED) -> DataFrame:
    """As-of join: every event with the value of the last anchor at or before it in its part.

    One union and one scan instead of a range join; anchors come before events at a tie."""
    both = events.select("*", F.lit(None).cast(anchors.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        anchors.select(part, at, F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    return scan.running(both, part, [at, "__side"], {value: ("last", F.col("__v"))}, crowded=crowded).where("__side = 1").drop("__v", "__side")


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, columns: list[str]) -> DataFrame:
    """The rows with columns of ``table`` by key; null where it has none."""
    t = table.select(F.col(table_key).alias("__k"), *columns)
    return rows.join(t, F.col(key) == F.col("__k"), "left").drop("__k")


def math_valid(rows: DataFrame, parts: list[Column], reported: Column, tolerance: float = 0.1) -> DataFrame:
    """Rows whose parts add up to the reported total, to the tolerance."""
    return rows.where(math_check(parts, reported, tolerance)["diff"] <= tolerance)


def quality_score(rows: DataFrame, valid: Column) -> DataFrame:
    """How many rows are valid, of how many, in percent to one place."""
    return rows.agg(F.count("*").alias("claims"), F.count_if(valid).alias("valid"), F.round(F.try_divide(F.count_if(valid) * 100, F.count("*")), 1).alias("score"))
