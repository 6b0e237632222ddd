"""Prefix scans over parts of any size: a running aggregate of each row's part up to the row.

A window does this in one task a part.  Where a part has more than ``crowded`` rows, all
parts are cut into ranges of the order instead: the bounds are quantiles of the leading
order column over the whole table, so no part has more than a ``1/blocks`` share of the
table in one range (rows of one bound together).  Each range is scanned by itself, what
it hands on is aggregated before the shuffle, the few hand-overs of a part are scanned,
and each row adds what its range was handed.  The result is that of the window.

The leading order column is a number, a date or a timestamp; ``order`` must be total for
the result to be defined.  Null parts are a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CROWDED = 1_000_000
BLOCKS = 256


def is_crowded(rows: DataFrame, part: str, crowded: int) -> bool:
    return not rows.groupBy(part).count().where(F.col("count") > crowded).isEmpty()


def cut(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` with ``__block``, the range of ``key`` they lie in; nulls are in the first."""
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    bounds = rows.agg(F.percentile_approx(key, shares).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    kind = rows.schema[key].dataType
    table = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds)).bit_length()))])
    # binary search: how many bounds are not above the key
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= F.col(key)), at + s).otherwise(at))
    return rows.withColumn("__block", found)


def _over(kind: str, value: Column, w) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"max": F.max, "sum": F.sum, "count": F.count}[kind](value).over(w)


def _handed(kind: str, value: Column, at: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), at))
    return {"max": F.max, "sum": F.sum, "count": F.count}[kind](value)


def _joined(kind: str, before: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, before)
    if kind == "max":
        return F.greatest(local, before)
    total = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
    return total if kind == "count" else F.when(local.isNotNull() | before.isNotNull(), total)


def with_carries(rows: DataFrame, carries: DataFrame, part: str) -> DataFrame:
    """``rows`` with the columns of ``carries`` for their part and ``__block``."""
    c = carries.withColumnsRenamed({part: "__part", "__block": "__at"})
    return rows.join(c, rows[f"`{part}`"].eqNullSafe(c["__part"]) & (rows["__block"] == c["__at"]), "left").drop("__part", "__at")


def running(
    rows: DataFrame, part: str, order: list[str], wanted: dict[str, tuple[str, Column]], inclusive: bool = True, crowded: int = CROWDED, blocks: int = BLOCKS
) -> DataFrame:
    """``rows`` with a column for each entry of ``wanted``, name to (``last`` value that is not
    null, ``max``, ``sum`` or ``count``; expression), over the rows of the part up to each row,
    or before it if not ``inclusive``."""
    end = 0 if inclusive else -1
    if not is_crowded(rows, part, crowded):
        w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumns({n: _over(k, v, w) for n, (k, v) in wanted.items()})
    r = cut(rows, order[0], blocks)
    handed = r.groupBy(part, "__block").agg(*[_handed(k, v, F.struct(*order)).alias(f"__{n}") for n, (k, v) in wanted.items()])
    before = Window.partitionBy(part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    again = {"last": "last", "max": "max", "sum": "sum", "count": "sum"}
    carries = handed.select(part, "__block", *[_over(again[k], F.col(f"__{n}"), before).alias(f"__{n}") for n, (k, _) in wanted.items()])
    w = Window.partitionBy(part, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = r.withColumns({n: _over(k, v, w) for n, (k, v) in wanted.items()})
    out = with_carries(local, carries, part)
    kinds = {n: local.schema[n].dataType for n in wanted}
    return out.withColumns({n: _joined(k, F.col(f"__{n}"), F.col(n)).cast(kinds[n]) for n, (k, _) in wanted.items()}).drop("__block", *[f"__{n}" for n in wanted])


def since_anchor(rows: DataFrame, part: str, order: list[str], anchor: Column, value: Column, crowded: int = CROWDED, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with ``anchor``, the last one that is not null before the row in its part, and
    ``since``, the sum of ``value`` over the rows behind that anchor and before the row, or
    from the part's start where there is none.  Rows with an anchor add nothing."""
    r = rows.withColumn("__anchor", anchor).withColumn("__value", F.when(anchor.isNull(), value))
    split = is_crowded(rows, part, crowded)
    r, group = (cut(r, order[0], blocks), [part, "__block"]) if split else (r, [part])
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__run", F.count("__anchor").over(before)).withColumn("anchor", F.last("__anchor", ignorenulls=True).over(before))
    of_run = Window.partitionBy(*group, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("since", F.coalesce(F.sum("__value").over(of_run), F.lit(0)))
    if split:
        # what a range hands on: its last anchor, and the sum behind that or over all of it
        tail = r.withColumn("__run", F.col("__run") + F.col("__anchor").isNotNull().cast("int")).groupBy(*group, "__run").agg(F.sum("__value").alias("s"), F.max_by("__anchor", F.when(F.col("__anchor").isNotNull(), F.struct(*order))).alias("a"))
        tail = tail.groupBy(*group).agg(F.max_by("s", "__run").alias("s"), F.max_by("a", "__run").alias("a"), F.max("__run").alias("n"))
        upto = Window.partitionBy(part).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(part).orderBy("__block")
        tail = tail.withColumn("g", F.count_if(F.col("n") > 0).over(upto))
        tail = tail.withColumn("s", F.sum("s").over(Window.partitionBy(part, "g").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)))
        carries = tail.select(part, "__block", F.last("a", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("__a"), F.lag("s").over(earlier).alias("__s"))
        kind = r.schema["since"].dataType
        r = with_carries(r, carries, part)
        more = F.when(F.col("__run") == 0, F.coalesce("__s", F.lit(0))).otherwise(F.lit(0))
        r = r.withColumn("since", (F.col("since") + more).cast(kind)).withColumn("anchor", F.coalesce("anchor", "__a")).drop("__a", "__s", "__block")
    return r.drop("__anchor", "__value", "__run")
