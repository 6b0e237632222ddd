"""Merkle manifest: a tree of hashes over all rows, a proof for each, and its check.

Rows are leaves, grouped by language; within a group they ascend by id.  Ranks come from
histograms of the ids' digits, not from a sort of the table: counts per (group, id) are
summed up digit by digit, and on the way down each bucket adds the counts of its smaller
siblings, of which it has at most ``2**RADIX_BITS``.  A rank in base 8 is then the leaf's
place in a trie: nodes are keyed by (group, leading digits), and the longest prefixes are
reduced first, eight children to a node, until a group has one node, its subroot.  The
subroots are the leaves of a last tree of the same kind.

Proofs go down the trie the same way: a node hands its children the hashes beside its
own path.  Leaves travel inside their parents, so a proof is never shuffled per row.

Nulls are hashed as ``-``; a null id is less than all ids, and a null language is the
first group.  Rows of equal ids are ordered by their leaf, equal leaves by a frozen row
number: their ranks are found by more digits of the same kind, so no copy group is
gathered.  An empty table has an empty result.  Columns other than the five hashed ones
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, Scratch, dense_positions, staged

RADIX_BITS = 10
FANOUT_BITS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def joined(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on ``names``, nulls equal; the columns of ``right`` but those follow."""
    return left.alias("l").join(right.alias("r"), functools.reduce(Column.__and__, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in names])).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in names])


def digit_ranks(rows: DataFrame, group: Sequence[str], key: str, scratch: Scratch) -> DataFrame:
    """(group, key, n, before, total) for each key of each group: the rows that have it,
    the rows of its group with lesser keys (null is least), the rows of its group."""
    counts = scratch.staged(rows.groupBy(*group, key).agg(F.count("*").alias("n")), "digits")
    low, high = counts.agg(F.min(key), F.max(key)).first()
    levels, bits = [counts], 0
    while low is not None and (high >> bits) - (low >> bits) >= 1 << RADIX_BITS:
        bits += RADIX_BITS
        up = levels[-1].groupBy(*group, F.shiftright(key, RADIX_BITS).alias(key)).agg(F.sum("n").alias("n"))
        levels.append(scratch.staged(up, "digits"))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = Window.partitionBy(*group)
    told = levels.pop().select(*group, key, "n", before(top).alias("before"), F.sum("n").over(top).alias("total"))
    while levels:
        digits = levels.pop().withColumn("parent", F.shiftright(key, RADIX_BITS))
        digits = digits.withColumn("before", before(Window.partitionBy(*group, "parent")))
        above = told.select(*group, F.col(key).alias("parent"), F.col("before").alias("base"), "total")
        told = joined(digits, above, [*group, "parent"]).select(*group, key, "n", (F.col("before") + F.col("base")).alias("before"), "total")
    return told


def ranked(rows: DataFrame, group: Sequence[str], keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, their rank in their group by ``keys``, and ``n``, its size.
    A key after the first is looked at for rows only that tie in those before it; the
    last must tell all rows apart."""
    rest, done, group = rows.withColumn("pos", F.lit(0).cast("long")), [], list(group)
    for i, key in enumerate(keys):
        told = joined(rest, digit_ranks(rest, group, key, scratch).withColumnRenamed("n", "ties"), [*group, key])
        told = told.withColumn("pos", F.col("pos") + F.col("before"))
        told = scratch.staged((told.withColumnRenamed("total", "n") if i == 0 else told.drop("total")).drop("before"), "ranked")
        done.append(told.where("ties = 1").drop("ties"))
        rest, group = told.where("ties > 1").drop("ties"), [*group, key]
        if rest.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done)


def grown(nodes: DataFrame, group: str, carried: Sequence[str], scratch: Scratch) -> list[DataFrame]:
    """The levels above ``nodes`` (group, pos, n, h, and ``carried``), each (group, pos, n,
    kids, h): longest prefixes first, until each group has one node.  ``kids`` has h and,
    on the first level, what is carried."""
    levels, below = [], nodes
    while not below.where("n > 1").isEmpty():
        kept = ["h", *carried] if not levels else ["h"]
        up = below.where("n > 1").groupBy(group, "n", F.shiftright("pos", FANOUT_BITS).alias("up"))
        up = up.agg(F.sort_array(F.collect_list(F.struct("pos", *kept))).alias("kids"))
        size = F.shiftright(F.col("n") + F.lit((1 << FANOUT_BITS) - 1), FANOUT_BITS)
        up = up.select(group, F.col("up").alias("pos"), size.alias("n"), "kids", F.sha2(F.array_join("kids.h", ""), 256).alias("h"))
        levels.append(below := scratch.staged(up, "trie"))
    return levels


def beside(kids: Column, i: Column) -> Column:
    """The hashes before and after the ``i``-th child."""
    return F.struct(
        F.array_join(F.slice(kids, F.lit(1), i), "").alias("l"),
        F.array_join(F.slice(kids, i + F.lit(2), F.lit(1 << FANOUT_BITS)), "").alias("r"),
    )


def paths(levels: list[DataFrame], tops: DataFrame, group: str, carried: Sequence[str], scratch: Scratch) -> DataFrame:
    """(group, h, carried, and the columns of ``tops``) for each node below ``levels``, where
    ``path``, the pairs of hashes beside each node on the way up, begins with its own.
    ``tops`` has (group, path, ...) of each group's top node."""
    others, above = [c for c in tops.columns if c not in (group, "path")], None
    for k in reversed(range(len(levels))):
        level = levels[k].select(group, "pos", "n", "kids")
        here = joined(level.where("n = 1"), tops, [group]).drop("n")
        if above is not None:
            here = here.unionByName(joined(level.where("n > 1").drop("n"), above, [group, "pos"]))
        kid = here.select(group, "kids", "path", *others, F.posexplode("kids").alias("i", "kid"))
        kid = kid.withColumn("path", F.concat(F.array(beside(F.col("kids.h"), F.col("i"))), "path"))
        kid = kid.select(group, F.col("kid.pos").alias("pos"), "path", *others, *([F.col(f"kid.{c}") for c in ["h", *carried]] if k == 0 else []))
        above = scratch.staged(kid, "paths") if k else kid
    return above.drop("pos")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, tampered) for each row of ``docs``.

    ``path`` is the row's proof: the hashes left and right of each node from the leaf to
    the root.  ``tampered`` is the leaf with this text in place of the row's, null where
    it is the same; None checks nothing.
    """
    with Scratch(docs.sparkSession) as scratch:
        values = {c: F.col(f"`{c}`") for c in HASHED}
        other = F.lit(None).cast("string") if tampered is None else leaf(*(values | {"text": tampered}).values())
        rows = docs.select("doc_id", "lang", leaf(*values.values()).alias("h"), other.alias("tampered"), F.monotonically_increasing_id().alias("row"))
        rows = rows.withColumn("tampered", F.when(F.col("tampered") != F.col("h"), F.col("tampered")))
        rows = scratch.staged(rows.withColumn("id", F.col("doc_id").cast("long")).withColumn("head", F.conv(F.substring("h", 1, 15), 16, 10).cast("long")), "leaves")
        carried = ["doc_id", "tampered"]
        leaves = scratch.staged(ranked(rows, ["lang"], ["id", "head", "row"], scratch).select("lang", "pos", "n", "h", *carried), "leaves")
        levels = grown(leaves, "lang", carried, scratch)
        lone = leaves.where("n = 1")

        subroots = functools.reduce(DataFrame.unionByName, [x.where("n = 1").select("lang", "h") for x in [leaves, *levels]])
        tops = scratch.staged(dense_positions(subroots, [F.col("lang")], "pos", scratch).withColumn("all", F.lit(0)), "subroots")
        tops = tops.withColumn("n", F.lit(tops.count()))
        crown = grown(tops, "all", ["lang"], scratch)
        root = (crown[-1] if crown else tops).where("n = 1").select("all", F.col("h").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path"))
        under = paths(crown, root, "all", ["lang"], scratch) if crown else joined(tops, root, ["all"])
        tops = scratch.staged(under.select("lang", F.col("h").alias("subroot"), "root", "path"), "tops")

        alone = joined(lone, tops, ["lang"]).select("lang", "path", "subroot", "root", "h", *carried)
        out = paths(levels, tops, "lang", carried, scratch).unionByName(alone) if levels else alone
        return staged(out.select("doc_id", "lang", F.col("h").alias("leaf"), "subroot", "root", "path", "tampered"), "manifest")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to, past the hashes of ``path``."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def proof(path: Column) -> Column:
    """All hashes of ``path``, from the leaf up, each level left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def digest(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked after one third of the texts were lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(3) == F.lit(0)
    told = manifest(docs, F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    out = told.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELD_SQL = "coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
ORACLE_SQL = f"""WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({' || '.join(FIELD_SQL.format(c=c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS h,
         CASE WHEN doc_id IS NOT NULL AND {CRC_SQL.format(s='CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({' || '.join(FIELD_SQL.format(c=c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {FIELD_SQL.format(c="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other FROM documents
), l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), t AS (SELECT 0 AS lv, lang, pos, n, h FROM l
  UNION ALL SELECT lv + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lv, lang, pos // 8, n
), s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), c AS (SELECT 0 AS lv, pos, n, h FROM s
  UNION ALL SELECT lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM c WHERE n > 1 GROUP BY lv, pos // 8, n
), b AS (SELECT lv, lang, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lv, lang, pos // 8 ORDER BY pos)
), e AS (SELECT lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM c WHERE n > 1 WINDOW w AS (PARTITION BY lv, pos // 8 ORDER BY pos)
), p AS (SELECT l.lang, l.pos, b.lv, b.l, b.r FROM l JOIN b ON l.lang IS NOT DISTINCT FROM b.lang AND b.pos = l.pos >> CAST(3 * b.lv AS BIGINT)
  UNION ALL SELECT l.lang, l.pos, 100 + e.lv, e.l, e.r FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN e ON e.pos = s.pos >> CAST(3 * e.lv AS BIGINT)
), q AS (SELECT lang, pos, sha256(string_agg(l || r, '' ORDER BY lv)) AS proof, list({{'l': l, 'h': '', 'r': r}} ORDER BY lv) AS path FROM p GROUP BY lang, pos
), o AS (SELECT doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM c WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend({{'l': '', 'h': coalesce(other, l.h), 'r': ''}}, coalesce(path, [])), lambda a, x: {{'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}}).h AS folded_root
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN q ON l.lang IS NOT DISTINCT FROM q.lang AND l.pos = q.pos)
SELECT *, folded_root = root AS verified FROM o"""
