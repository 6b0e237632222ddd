"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: every source gets its weight's share of all words, but no more than ``cap``
   times what it has; what is over goes to the others by weight (water filling).
2. Each source's rows are put in a random but repeatable order, repeated in passes, and
   the words up to the target are drawn.  The drawn words are cut into blocks.
3. A binary tree over the output shards splits the exact block counts of all sources:
   at each node the left half's counts are one multivariate-hypergeometric draw, so the
   quotas of the leaves add up to the blocks there are.
4. A source's blocks are put in an order that depends on seed and source, and each shard
   takes its quota of them, one run after the other.  So blocks are disjoint and each
   shard has exactly its quotas.  It orders its rows by a hash: the local shuffle.

Running sums are taken per (source, bucket), with the square root of a source's rows as
its number of buckets, so a source with a third of all rows is no single task.  The
quota tree has one array entry per source; more than ``MAX_SOURCES`` sources are an error.

A null source is a source, the last one.  Null text has no words; rows without words are
never drawn.  Repeated rows count each.  An empty table gives an empty result.  The plan
has the columns named in ``mix_plan`` only; ``mixed`` keeps the input's columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged, unit_hash, words

#: Rounds of the keyed permutation of a source's blocks.
ROUNDS = 32
#: The quota tree holds a number per source in one row.
MAX_SOURCES = 20_000


def water_fill(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target.

    Sources are ranked by code point, nulls last; weights repeat along the ranks.
    The table has a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.get(table, F.col("rank") % F.lit(len(weights))))
    # sources reach their cap in the order of cap / weight
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.lit(cap) * F.sum("source_size").over(upto), F.lit(0))).cast("double")
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).cast("double"),
    )
    full = F.col("level") * F.col("weight") > (F.lit(cap) * F.col("source_size")).cast("double")
    # the level of the first source that stays below its cap is everyone's
    s = s.withColumn("level", F.min(F.when(~full, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("rank"), F.col("level")))).over(whole)["level"])
    top = (F.lit(cap) * F.col("source_size")).cast("double")
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > top), top).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "n_rows", "rank", "weight", target.alias("target"))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``population`` are among the ``marked``: inversion of ``u``.

    Outcomes are gone through from the mode up, then from the mode down, with weights
    relative to the mode's; those beyond 12 deviations have no weight a double can show.
    """
    n, k, d = (c.cast("double") for c in (population, marked, draws))
    least = F.greatest(F.lit(0).cast("long"), draws - (population - marked))
    most = F.least(draws, marked)
    mode = F.least(most, F.greatest(least, F.floor((d + 1) * (k + 1) / (n + 2))))
    p = k / F.greatest(n, F.lit(1.0))
    reach = F.ceil(F.lit(12.0) * F.sqrt(d * p * (F.lit(1.0) - p)) + F.lit(30.0))

    def up(x: Column) -> Column:  # weight of x over that of x - 1
        x = x.cast("double")
        return (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))

    def down(x: Column) -> Column:  # weight of x over that of x + 1
        x = x.cast("double")
        return (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))

    def walk(path: Column, ratio, goal: Column) -> Column:
        """(sum of weights, outcome at which the sum first reaches ``goal``)."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("hit"))
        return F.aggregate(
            path, start,
            lambda a, x: let(
                a["w"] * ratio(x),
                lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.coalesce(a["hit"], F.when(a["sum"] + w >= goal, x)).alias("hit")),
            ),
        )

    none = F.array().cast("array<bigint>")

    def chosen(m: Column) -> Column:
        ups = F.when(m < most, F.sequence(m + 1, F.least(most, m + reach))).otherwise(none)
        downs = F.when(m > least, F.sequence(m - 1, F.greatest(least, m - reach))).otherwise(none)
        never = F.lit(float("inf"))
        return let(
            F.struct(walk(ups, up, never)["sum"].alias("up"), walk(downs, down, never)["sum"].alias("down")),
            lambda s: let(
                u * (F.lit(1.0) + s["up"] + s["down"]) - F.lit(1.0),
                lambda g: F.when(g <= 0, m)
                .when(g <= s["up"], F.coalesce(walk(ups, up, g)["hit"], m))
                .otherwise(F.coalesce(walk(downs, down, g - s["up"])["hit"], m)),
            ),
        )

    return F.when(marked >= population, draws).when((marked <= 0) | (draws <= 0), F.lit(0).cast("long")).otherwise(let(mode.cast("long"), chosen))


def split_tree(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``blocks`` (rank, n_blocks) to (shard, rank, quota), level by level.

    The shards' totals differ by one block at most.
    """
    nodes = blocks.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "n_blocks"))), lambda x: x["n_blocks"].cast("long")).alias("counts")
    ).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    nodes = nodes.withColumn("grand", F.col("all"))
    width = shards
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

        def share(shard: Column) -> Column:  # blocks of the shards below this one
            return F.floor(F.col("grand") * shard / F.lit(shards)).cast("long")

        start = F.struct(F.col("all").alias("pop"), (share(mid) - share(F.col("lo"))).alias("draws"), F.array().cast("array<bigint>").alias("out"))

        def draw(a: Column, c: Column) -> Column:
            u = unit_hash(F.lit(seed), F.col("lo"), F.col("hi"), F.size(a["out"]))
            return let(
                hypergeometric(a["pop"], c, a["draws"], u),
                lambda k: F.struct((a["pop"] - c).alias("pop"), (a["draws"] - k).alias("draws"), F.array_append(a["out"], k).alias("out")),
            )

        left = F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("counts", start, draw)["out"]).otherwise(F.col("counts"))
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.select("lo", "hi", "counts", "grand", mid.alias("mid"), F.explode(F.array(left)).alias("left"))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        halves = F.when(
            F.col("hi") - F.col("lo") > 1,
            F.array(
                F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts")),
                F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("counts")),
            ),
        ).otherwise(F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("counts").alias("counts"))))
        nodes = nodes.select("grand", F.explode(halves).alias("n")).select("grand", "n.*").withColumn("all", total(F.col("counts")))
        width = (width + 1) // 2
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("rank", "quota"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` among the ``n`` numbers from 0 in an order that depends on the key.

    Swap or not: each round pairs the numbers by a keyed sum and swaps some of the pairs,
    so every round is a permutation, whatever ``n`` is.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, other)), F.lit(2)) == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    shards: int = 32,
    block_words: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and draws.

    ``draws`` has an entry (pass, block, shard, place) for each time the row is taken:
    all of its words each time.  Shards order their rows by ``place``.  ``carry`` names
    columns that go along in the struct ``row``.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    ).withColumn("h", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    rows = staged(rows, "mix-rows")
    per = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, cap)
    per = staged(per.withColumn("n_blocks", F.when(F.col("target") > 0, F.floor(F.col("target") / F.lit(block_words)) + 1).otherwise(F.lit(0))).coalesce(1), "mix-sources")

    if per.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: merge the small ones first")
    quotas = split_tree(per.select("rank", "n_blocks"), shards, seed)
    ends = quotas.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
    ends = ends.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    known = staged(per.join(ends, "rank").coalesce(1), "mix-quotas")  # one row per source; broadcast only if small

    in_bucket = F.floor(unit_hash(F.col("h")) * F.ceil(F.sqrt(F.col("n_rows").cast("double")))).cast("int")
    placed = rows.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", in_bucket)
    totals = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words0"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(totals, ["rank", "bucket"]).withColumn("start", F.col("words0") + F.sum("size").over(inside) - F.col("size"))

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - passes * F.col("source_size")
    last = (F.col("start") + F.col("size") / F.lit(2.0) < rest).cast("int")
    times = F.when(F.col("size") > 0, passes + last).otherwise(F.lit(0))

    def one(i: Column) -> Column:
        block = F.floor((i * F.col("source_size") + F.col("start")) / F.lit(block_words)).cast("long")
        block = F.least(block, F.col("n_blocks") - 1)
        shard = let(permuted(block, F.col("n_blocks"), F.lit(seed), F.col("rank")), lambda at: F.size(F.filter(F.col("ends"), lambda e: e <= at)))
        return F.struct(i.alias("pass"), block.alias("block"), shard.alias("shard"), F.xxhash64(F.col("h"), i, F.lit(seed)).alias("place"))

    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), one)).otherwise(F.array().cast("array<struct<pass:int,block:bigint,shard:int,place:bigint>>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"), *(["row"] if carry else []))


def mixed(docs: DataFrame, shard_col: str | None = None, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is drawn, in the order
    of output shard and place in it.  Tasks are ranges of that order, as many as Spark
    needs, so a shard of any size is written by several.  ``shard_col`` names a column
    for the shard, to partition files by."""
    plan = mix_plan(docs, carry=docs.columns, **options)
    shard, place = "__shard", "__place"
    out = plan.select("row", F.explode("draws").alias("draw")).select("row.*", F.col("draw.shard").alias(shard), F.col("draw.place").alias(place))
    out = out.repartitionByRange(shard, place).sortWithinPartitions(shard, place).drop(place)
    return out.withColumnRenamed(shard, shard_col) if shard_col else out.drop(shard)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the draws themselves: pass, block, shard and place."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, _: n + F.col("size"))
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")
