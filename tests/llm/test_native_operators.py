"""Sharding, mixing, quality rules and fuzzy lines."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from brute import WORD, similar, union
from pyspark.sql import functions as F

from tallyforge.llm import fuzzy_lines, mixing, quality_cascade, sharding


def test_shards_are_even_and_slots_gapless(docs, rows):
    got = sharding.digest(docs, 5).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))


def test_shards_of_many_equal_texts(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = Counter()
    for r in sharding.shard_by_bytes(copies, 10).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 2 * 30


def test_water_filling(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1, 1), (None, 100, 1)], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(s, (5, 2, 1), 3).collect()}
    assert abs(sum(got.values()) - 1111) < 1e-6 and got["a"] == 30 and got["c"] == 3 and got[None] == 300 and abs(got["b"] - 778) < 1e-6


def test_mix_comes_near_targets(docs, rows):
    got = mixing.digest(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.digest(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    source = {d: s for d, _, _, s, *_ in rows}
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        k = source[r["doc_id"]]
        taken[k] += r["taken"]
        target[k] = r["target"]
        most[k] = max(most[k], r["size"])
    assert all(abs(taken[k] - target[k]) <= most[k] for k in target)


def test_split_tree_keeps_block_counts(spark):
    blocks = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 64)], "rank int, n_blocks long")
    got = mixing.split_tree(blocks, 7, 1).collect()
    per_rank, per_shard = Counter(), Counter()
    for r in got:
        per_rank[r["rank"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
        assert r["quota"] >= 0
    assert dict(per_rank) == {0: 100, 1: 7, 2: 0, 3: 64} and set(per_shard.values()) <= {24, 25}


def test_blocks_are_permuted_and_shards_have_their_quotas(spark):
    for n in (1, 2, 3, 7, 33, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1)).alias("at")).collect()
        assert sorted(r["at"] for r in got) == list(range(n))
    got = [r["at"] for r in spark.range(100).select(mixing.permuted(F.col("id"), F.lit(100).cast("long"), F.lit(3), F.lit(1)).alias("at")).collect()]
    assert len({(b - a) % 100 for a, b in zip(got, got[1:])}) > 40  # no shift, no progression
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    blocks = {}
    for r in mixing.mix_plan(docs, shards=5, block_words=16).collect():
        for d in r["draws"]:
            blocks.setdefault(r["source"], {}).setdefault(d["block"], set()).add(d["shard"])
    assert all(len(s) == 1 for b in blocks.values() for s in b.values())  # a block goes to one shard
    share = [sum(len([1 for s in b.values() if k in s]) for b in blocks.values()) for k in range(5)]
    assert max(share) - min(share) <= 2 + 3  # equal totals, but for a last block of a source that no row lies in


def test_hypergeometric_distribution(spark):
    n = 20000
    u = (F.col("id") + F.lit(0.5)) / n
    got = spark.range(n).select(mixing.hypergeometric(F.lit(20).cast("long"), F.lit(8).cast("long"), F.lit(5).cast("long"), u).alias("k")).groupBy("k").count().collect()
    from math import comb

    for r in got:
        assert abs(r["count"] / n - comb(8, r["k"]) * comb(12, 5 - r["k"]) / comb(20, 5)) < 1e-3


def test_mixture_rows(docs):
    m = mixing.mixed(docs, shards=4)
    assert m.columns == docs.columns and m.count() > 0


def test_cascade_agrees_with_sql(docs, rows):
    got = quality_cascade.digest(docs).toPandas().sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    want = con.sql(quality_cascade.ORACLE_SQL).df().sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    for c in got.columns:
        assert got[c].fillna(-1).astype(float).tolist() == want[c].fillna(-1).astype(float).tolist(), c


def test_order_of_rules_changes_no_verdict(docs):
    a = {r["doc_id"]: r["rejected_by"] is None for r in quality_cascade.cascade(docs).collect()}
    b = {r["doc_id"]: r["rejected_by"] is None for r in quality_cascade.cascade(docs, rules=quality_cascade.RULES[::-1], keep_features=True).collect()}
    assert a == b


def test_rules_behind_the_first_that_rejects_are_not_evaluated(spark):
    from tallyforge.llm.quality_cascade import RULES, Rule, verdict, work

    trap = Rule("trap", ("n_words",), lambda f: F.when(f["n_words"] < 20, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.lit(False)))
    df = spark.createDataFrame([("one two",), (" ".join(f"w{i}" for i in range(50)),)], "text string")
    assert [r["v"] for r in df.select(verdict(F.col("text"), [RULES[0], trap])["rejected_by"].alias("v")).collect()] == ["too_few_words", None]
    with pytest.raises(Exception, match="evaluated"):
        df.select(verdict(F.col("text"), [trap, RULES[0]])["rejected_by"].alias("v")).collect()
    figures = {r.name: (1.0 + k, 0.2) for k, r in enumerate(RULES)}
    assert work(quality_cascade.order_rules(RULES, figures), figures) < work(RULES[::-1], figures)


def test_a_filter_on_long_texts_keeps_the_words_cut_once(spark):
    import time

    long = " ".join(f"w{i}" for i in range(20000))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long + " " + long)], "doc_id int, text string")
    kept = quality_cascade.cascade(df).where("rejected_by IS NULL").drop("rejected_by")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim") + plan.count("split(lambda") == 1
    began = time.perf_counter()
    assert [r["doc_id"] for r in kept.collect()] == [1] and time.perf_counter() - began < 30


def test_late_rules(spark):
    rows = [(1, "abc " * 10 + "123 " * 30, "few_letters"), (2, "\n".join(f"- item {i} of the list here" for i in range(12)), "bullets"), (3, "\n".join(f"line number {i} breaks off ..." for i in range(12)), "cut_off"), (4, "\n".join(f"a plain line of number {i} ends." for i in range(12)), None)]
    got = spark.createDataFrame(rows, "doc_id int, text string, want string").withColumn("v", quality_cascade.verdict(F.col("text"), quality_cascade.RULES[2:])["rejected_by"])
    assert all(r["v"] == r["want"] for r in got.collect())


def test_rules_are_ordered_by_rejection_per_cost():
    r = quality_cascade.RULES[:3]
    figures = {r[0].name: (1.0, 0.1), r[1].name: (1.0, 0.5), r[2].name: (10.0, 0.6)}
    assert [x.name for x in quality_cascade.order_rules(r, figures)] == [r[1].name, r[0].name, r[2].name]


def test_fuzzy_lines_against_brute_force(docs, rows):
    lines = [(d, k, x) for d, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    lines = sorted(set(lines), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first = {}
    for i, (_, _, x) in enumerate(lines):
        first.setdefault(x, i)
    texts = list(first)
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} if len(x) > 8 else {x} for x in texts]
    label = union(len(texts), similar(sets, 0.8))
    lead = {}
    for i, (_, _, x) in enumerate(lines):
        lead.setdefault(label[texts.index(x)], i)
    want = {(d, k) for i, (d, k, x) in enumerate(lines) if lead[label[texts.index(x)]] != i}
    got = {(r["doc_id"], k) for r in fuzzy_lines.digest(docs).collect() for k in r["removed"]}
    assert got == want
    out = fuzzy_lines.deduplicated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_fuzzy_lines_without_spaces_and_short_lines(spark):
    rng = random.Random(8)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    lines = []
    for _ in range(20):
        x, u = han(100), "https://" + hexa(150)
        lines += [x, han(1) + x[1:], "a " + u, "b " + u]
    for n in (*range(8, 27), 35, 42, 63):  # one character is appended, until the similarity is just the threshold
        for _ in range(10):
            x = hexa(n)
            lines += [x + hexa(k) for k in range(max(1, n // 4))]
    rng.shuffle(lines)
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} if len(x) > 8 else {x} for x in lines]
    label = union(len(lines), similar(sets, 0.8))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r["doc_id"] for r in fuzzy_lines.digest(docs).collect() if r["n_removed"]}
    assert gone == {i for i in range(len(lines)) if label[i] != i}


def test_sketches_let_no_similar_line_go(spark):
    """Pairs at the threshold and far below it, with repeated shingles and characters of two
    units: the bits lose none of the first, whatever the length, and let most others go."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \U0001f600" if n % 2 else "abcdefgh ") for _ in range(n))
    rows, near = [], {}
    for i in range(300):
        x = text(rng.randrange(8, 400)) * rng.choice((1, 1, 2))
        y = x + text(max(1, len(x) // 6)) if i % 2 else x[: len(x) // 2] + text(len(x) // 2)
        rows += [(2 * i, x), (2 * i + 1, y)]
        a, b = ({t[j : j + 8] for j in range(max(1, len(t) - 7))} for t in (x, y))
        near[i] = len(a & b) >= 0.8 * len(a | b)
    signed = fuzzy_lines.signatures(spark.createDataFrame(rows, "h long, line string"), 8).select("id", F.struct("size", "bits", "minima").alias("s"))
    pairs = signed.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("i"), F.col("s").alias("a")).join(signed.where("id % 2 = 1").select(((F.col("id") - 1) / 2).cast("long").alias("i"), F.col("s").alias("b")), "i")
    got = {r["i"]: r["stay"] for r in pairs.select("i", fuzzy_lines.few_differ(F.col("a"), F.col("b"), 0.8).alias("stay")).collect()}
    assert len(got) == 300 and sum(near.values()) > 80 and all(got[i] for i in near if near[i])
    assert sum(not x for x in got.values()) > 50


def test_pairs_of_large_families_are_not_made_one_by_one(spark):
    """Versions of one text, each with an eighth of its own, lie just below the threshold: they
    share buckets, sketches tell few of them apart, and pairs must not grow with their square."""
    from tallyforge.llm import links

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    base, n, asked = text(600), 200, []
    lines = [base[: 8 * (k % 40)] + text(70) + base[8 * (k % 40) + 70 :] for k in range(n)]
    lines += [x + "!" for x in lines[:3]]
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    sets = {k: {x[j : j + 8] for j in range(len(x) - 7)} for k, x in enumerate(lines)}
    want = {(a, b) for a, b in similar([sets[k] for k in sorted(sets)], 0.8)}
    signed = fuzzy_lines.signatures(texts, 8).cache()

    def verify(pairs):
        asked.append(sorted((r["a"], r["b"]) for r in pairs.collect()))
        return spark.createDataFrame([x for x in asked[-1] if x in want], "a long, b long")

    tokens = lambda ids: texts.join(ids.withColumnRenamed("id", "h"), "h").select(F.col("h").alias("id"), fuzzy_lines.shingle_set(F.col("line"), 8).alias("tokens"))
    sketches = lambda: signed.select("id", F.struct("size", "bits", "minima").alias("sketch"))
    found, labels = links.resolve(signed.select("id", "keys"), verify, tokens, 0.8, paired=512, sketches=sketches, may_link=lambda a, b: fuzzy_lines.few_differ(a, b, 0.8))
    label = union(len(lines), sorted(want))
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert all(got.get(k, k) == label[k] for k in range(len(lines)))
    # a centre for each band, and pairs of small buckets (3585 in all; 16692 when larger buckets made pairs too)
    assert sum(map(len, asked)) < n * (fuzzy_lines.GROUPS + links.SMALL // 2)


def test_lines_of_equal_and_null_ids_are_removed_by_row(spark):
    rows = [(None, "alpha line one\nbeta line two"), (None, "gamma line three\nalpha line one"), (5, "delta line four\nbeta line two"), (5, "epsilon line five\nzeta line six"), (6, "eta line seven"), (6, "eta line seven"), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in fuzzy_lines.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    want = [(None, rows[0][1]), (None, "gamma line three"), (5, "delta line four"), rows[3], (6, "eta line seven"), (6, ""), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("run", [sharding.digest, mixing.digest, quality_cascade.digest, fuzzy_lines.digest])
def test_empty_table(none, run):
    assert run(none).count() == 0
