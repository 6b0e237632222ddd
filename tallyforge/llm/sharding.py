"""Sharding by sampled splitters.

Rows are put in the order of a key (hash of the text, id), so equal texts lie side by
side.  A size-weighted sample of keys gives quantile boundaries, the boundaries cut the
table into ranges, and ranges that the exact totals show to be overfull, in rows or in
bytes, are sampled again and subdivided.  Exact running sums, one range per window, then
place the shard borders to within one row of equal bytes.

The sample is bounded by a parameter, the driver gets no more than the numbers of the
overfull ranges, and no window over rows holds more than one range: a group of equal texts of any size is cut by id, and
repeated rows by the row number they got when the key table was written.

Null text has no bytes and the hash of the empty text.  Ties of (text, id) are rows that
differ in nothing the result shows.  An empty table gives an empty result.  The result
has the id and the sharding columns only, so other columns of the input cannot clash.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unit_hash

ROW_BYTES = 16
#: Ranges number the square root of the rows up to here; from then on they hold more rows.
MAX_RANGES = 1 << 15


def _key(k: Column, doc: Column, row: Column) -> Column:
    return F.struct(k.alias("k"), doc.alias("doc"), row.alias("row"))


def _range_of(key: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((16 * MAX_RANGES).bit_length()))])

    def step(lo: Column, s: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, lo + s - F.lit(1)) <= key, F.lit(False)), lo + s).otherwise(lo)

    return F.aggregate(steps, F.lit(0), step)


def _cut(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.withColumn("bounds", bounds.scalar()).withColumn("range", _range_of(F.col("key"), F.col("bounds"))).drop("bounds")


def _quantiles(rows: DataFrame, weight: Column, rate: float, every: int, seed: int) -> DataFrame:
    """Every ``every``-th of the sorted keys that are drawn ``weight * rate`` times each."""
    times = F.floor(weight * F.lit(rate) + unit_hash(F.col("key"), F.lit(seed))).cast("int")
    drawn = rows.select("key", times.alias("n")).where("n > 0").select(F.explode(F.expr("array_repeat(key, n)")).alias("key"))
    at = F.filter(F.sort_array(F.collect_list("key")), lambda _, i: i % F.lit(every) == F.lit(every // 2))
    return drawn.agg(at.alias("bounds"))


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", draws_per_range: int = 16, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard and slot.

    ``slot`` counts from 0 within the shard in key order.  Ranges number the square
    root of the rows, at least 16 a shard and at most ``MAX_RANGES``; the sample holds
    ``draws_per_range`` keys for each.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _key(F.xxhash64(text), F.col(f"`{id_col}`"), F.monotonically_increasing_id()).alias("key"),
        ),
        "shard-keys",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(MAX_RANGES, max(16 * shards, math.isqrt(n))))
    weight = F.col("size") / F.lit(max(total, 1))
    bounds = staged(_quantiles(rows, weight, ranges * draws_per_range, draws_per_range, seed), "shard-bounds")
    for again in itertools.count(1):  # ranges are sampled again until none is overfull
        cut = _cut(rows, bounds)
        most_rows, most_bytes = 3 * n / ranges, 3 * total / ranges
        totals = cut.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("one"))
        over = [r["range"] for r in totals.where((F.col("n") > 1) & ((F.col("n") > most_rows) | (F.col("b") > most_bytes + F.col("one")))).collect()]
        if not over:
            break
        # by rows, where short texts crowd a range: each of its rows counts alike
        more = _quantiles(cut.where(F.col("range").isin(over)), weight + F.lit(1.0 / max(n, 1)), ranges * draws_per_range / 2, draws_per_range // 2, seed + again)
        bounds = staged(bounds.unionByName(more).agg(F.sort_array(F.flatten(F.collect_list("bounds"))).alias("bounds")), "shard-bounds")

    cut = _cut(rows, bounds)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("range")
        .agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        .select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes0"))
    )
    inside = Window.partitionBy("range").orderBy("key")
    at = F.col("bytes0") + F.sum("size").over(inside) - F.col("size") / F.lit(2.0)
    placed = staged(
        cut.join(F.broadcast(starts), "range").select(  # one row per range, of which there are some 3 x MAX_RANGES at most
            "doc_id", "size", "text_crc32",
            (F.col("rows0") + F.row_number().over(inside) - 1).alias("rank"),
            F.least(F.floor(at * F.lit(shards) / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int").alias("shard"),
        ),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))  # one row per shard


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    return shard_by_bytes(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
