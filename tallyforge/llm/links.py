"""Connected components and bucket resolution as joins and aggregations.

Neither gathers a bucket or a component: a group of any size is handled by minima and
maxima per key, which Spark combines before shuffling, and by joins of written tables,
which it can split when they are skewed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged

#: A bucket of so many ids is small: those not joined by then meet in pairs.
SMALL = 32
#: Tokens are counted in so many hash slots.
SLOTS = 1 << 20
#: So many ids of a large bucket are compared with all others by sketch.
CENTRES = 8


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a leaf with one centre, or a centre."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of the component, for every id in ``links`` (a, b).

    Alternates large and small stars until each component is a star around its least id,
    which takes a number of rounds logarithmic in the longest path.  Each round is written out.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        while not _stars(edges):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = scratch.staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            large = scratch.staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            lowest = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = scratch.staged(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        return staged(leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()), "labels")


def joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` after ``new`` links: only the components that they touch are worked on."""
    if new.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    told = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(told).select(F.col("id").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label"))  # a hot label's side can be split
    first = moved.select(F.col("label").alias("id"), F.col("to").alias("label")).join(labels.select("id"), "id", "left_anti")
    return staged(old.unionByName(first), "labels")


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def renamed(rows: DataFrame) -> DataFrame:
    """``rows`` with a 2 behind the names of all columns but ``key``."""
    return rows.select("key", *[F.col(c).alias(f"{c}2") for c in rows.columns if c != "key"])


def close_pairs(members: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ids of different components among which are all whose ``tokens``, sets
    of numbers, have a Jaccard similarity of ``threshold`` or more.  ``members`` has (id, label),
    a row for each id however many buckets it is in, ``sets`` (id, tokens).

    Tokens are put in order, the rarest first, by the lesser count of two hash slots, which are so
    few that they go to the sets: any order loses nothing, as long as it is one for all sets.  Of two such sets the smaller has, within its
    first ``n - 2t/(1+t) n + 1`` tokens, one that is within the first ``m - t m + 1`` of the
    larger; what follows these two must suffice for the overlap that is needed.  Tokens that
    most sets share, as those of a template do, come last and join nothing.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = [F.pmod(F.xxhash64("w", F.lit(k)), F.lit(SLOTS)).cast("int").alias(f"slot{k}") for k in (0, 1)]
    first = lambda share: F.col("size") - F.ceil(F.col("size") * F.lit(share) - F.lit(1e-6)) + 1
    with Scratch(members.sparkSession) as early:
        sets = members.join(sets, "id").select("id", "label", F.size("tokens").alias("size"), "tokens")
        sets = early.bucketed(sets.repartition(parts, "id"), "sets", "id")  # sets are put in order where they lie
        each = sets.select("id", "label", "size", F.explode("tokens").alias("w")).select("id", "label", "size", "w", *slots)
        counted = each
        for k in (0, 1):
            common = early.staged(each.groupBy(f"slot{k}").agg(F.count("*").cast("int").alias(f"df{k}")), "frequencies")
            counted = counted.join(F.broadcast(common), f"slot{k}")
        rare = F.struct(F.least("df0", "df1").alias("df"), "w")
        ordered = counted.groupBy("id", "label", "size").agg(F.sort_array(F.collect_list(rare)).alias("ws"))
        heads = ordered.select("id", "label", "size", first(2 * threshold / (1 + threshold)).alias("short"), F.slice("ws", F.lit(1), first(threshold).cast("int")).alias("ws"))
        heads = heads.select("id", "label", "size", "short", F.posexplode("ws").alias("at", "w"))
        # in a slot of its own a token joins nothing
        heads = scratch.staged(heads.where("w.df > 1").select("id", "label", "size", "short", "at", F.col("w.w").alias("w")), "heads")
    a, b = heads.where("at < short").alias("a"), heads.alias("b")
    enough = F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size")) - F.lit(1e-6)
    fits = (F.col("a.label") != F.col("b.label")) & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") != F.col("b.id"))))
    fits &= F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= enough
    fits &= F.col("a.size") >= F.col("b.size") * F.lit(threshold) - F.lit(1e-6)
    return a.join(b, (F.col("a.w") == F.col("b.w")) & fits).select(*pair("a.id", "b.id")).distinct()


def resolve(
    nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], threshold: float, small: int = SMALL,
    sketches: Callable[[], DataFrame] | None = None, may_link: Callable[[Column, Column], Column] | None = None, paired: int | None = None, rounds: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between ids of one bucket that ``verify`` confirms, so many that they
    make the components that all such links would make; and those components (id, label),
    for every id with a link.  ``nodes`` has (id, keys) with a key or null for each band;
    equal keys make a bucket; it is not read after ``verify`` was first called.  ``tokens``
    gives (id, tokens), the sets that are compared, for a table of ids.

    ``sketches`` gives (id, sketch) for every id that ``verify`` was asked for, and ``may_link``
    whether two sketches leave a link possible, which is the same either way round.  Such
    comparisons need no text, so in buckets of up to ``paired`` ids (default: ``small``) they
    tell which ids have anything to meet; of larger buckets than ``small`` pairs are made in
    step 3, but for those with the least id of an equal sketch and with ``CENTRES`` ids of the
    bucket, whose sketches leave a link possible: in step 2, so that close groups are joined before.

    Keys are dealt into ``rounds`` by their remainder, and the buckets of one round are found
    after those of another: so much less of them is on disk at a time.

    1. Every bucket compares its ids with one of them, its centre: the least id, or in a
       bucket of more than ``small`` ids the one whose buckets are largest, since a text
       that many were copied from shares most buckets with them.
    2. A bucket whose ids are then in one component is done.  In one of up to ``small`` ids,
       those of different components meet in pairs, at most ``small / 2`` for each id.
    3. The ids of the larger buckets that are not done meet by their rarest tokens, exactly:
       ``close_pairs``.  Of buckets of up to ``paired`` ids only those take part whose sketch
       leaves a link to one of another component possible.

    So comparisons grow with the number of ids, whatever the size of a bucket, unless many
    texts of different components share their rarest tokens too.
    """
    paired = max(paired or small, small)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(nodes.sparkSession) as scratch:
        early = Scratch(nodes.sparkSession)  # what goes before large buckets are worked on
        bands = nodes.select("id", F.explode("keys").alias("key")).where("key IS NOT NULL")

        def met(k: int) -> DataFrame:
            """(id, key, n, c): the members of the buckets of round ``k``, with their number and least id."""
            some = bands.where(F.pmod("key", F.lit(rounds)) == k) if rounds > 1 else bands
            sizes = early.staged(some.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("c")).where("n > 1"), "sizes")
            return early.staged(some.join(sizes.hint("shuffle_hash"), "key"), "members")  # no sort of all keys

        members = functools.reduce(DataFrame.unionByName, [met(k) for k in range(rounds)])
        large = members.where(F.col("n") > small)
        pairs = members.where((F.col("n") <= small) & (F.col("id") != F.col("c"))).select(*pair("c", "id"))
        some_large = not large.isEmpty()
        if some_large:
            score = large.groupBy("id").agg(F.sum("n").alias("score"))
            scored = early.staged(large.select("id", "key").join(score, "id"), "scored")
            hubs = early.staged(scored.groupBy("key").agg(F.max(F.struct("score", "id"))["id"].alias("c")), "hubs")
            pairs = pairs.unionByName(scored.join(hubs, "key").where("id <> c").select(*pair("c", "id")))
        found = [scratch.staged(verify(pairs.distinct()), "verified")]
        labels = components(found[0])

        def unsettled(rows: DataFrame, scratch: Scratch) -> DataFrame:
            """The rows of buckets with more than one component, with labels."""
            told = scratch.staged(rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "told")
            mixed = told.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
            return scratch.staged(told.join(scratch.staged(mixed, "mixed"), "key"), "unsettled")

        known = sketches() if sketches is not None else None
        few = unsettled(members.where(F.col("n").between(3, small)).select("key", "id"), early)
        fits = F.expr("label <> label2 AND id < id2")
        if known is not None:
            few = early.bucketed(few.join(known, "id").repartition(parts, "key"), "sketched", "key")  # both sides of the join lie as they are
            fits &= may_link(F.col("sketch"), F.col("sketch2"))
        pairs = few.join(renamed(few), "key").where(fits).select(*pair("id", "id2"))
        large = scratch.staged(large.select("key", "n", "id"), "large")
        if known is not None and some_large:
            told = large.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(known, "id")
            told = early.staged(told.withColumn("hash", F.xxhash64("id")).withColumn("of", F.xxhash64("sketch")), "large-sketched")
            alike = told.groupBy("key", "of").agg(F.min(F.struct("id", "label")).alias("c"))
            pairs = pairs.unionByName(told.join(alike, ["key", "of"]).where("label <> c.label").select(*pair("id", "c.id")))
            centres = told.groupBy("key", F.pmod("hash", F.lit(CENTRES)).alias("nth")).agg(F.min(F.struct("hash", "id", "label")).alias("c"))
            centres = centres.select("key", F.col("c.id").alias("id"), F.col("c.label").alias("label")).join(known, "id")
            meets = (F.col("key") == F.col("key2")) & F.expr("label <> label2") & may_link(F.col("sketch"), F.col("sketch2"))
            pairs = pairs.unionByName(told.join(renamed(centres).withColumnRenamed("key", "key2"), meets).select(*pair("id", "id2")))
        found.append(scratch.staged(verify(early.staged(pairs.distinct(), "pairs")), "verified"))
        labels = joined(labels, found[-1])
        early.clear()
        if some_large:
            rest = unsettled(large, scratch)
            crowded = rest.where(F.col("n") > paired).select("id", "label")
            if known is not None:  # one partner is enough: no row is made for each
                told = rest.where(F.col("n") <= paired).select("key", "id", "label").join(known, "id")
                told = scratch.bucketed(told.repartition(parts, "key"), "sketched", "key")
                other = renamed(told).withColumnRenamed("key", "key2")
                meets = (F.col("key") == F.col("key2")) & F.expr("label <> label2") & may_link(F.col("sketch"), F.col("sketch2"))
                crowded = crowded.unionByName(told.join(other, meets, "left_semi").select("id", "label"))
            crowded = scratch.staged(crowded.distinct(), "crowded")
            if not crowded.isEmpty():
                sets = tokens(crowded.select("id"))
                found.append(scratch.staged(verify(close_pairs(crowded, sets, threshold, scratch)), "verified"))
                labels = joined(labels, found[-1])
        return staged(functools.reduce(DataFrame.unionByName, found).distinct(), "links-found"), labels
