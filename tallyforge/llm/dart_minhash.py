"""Near-duplicate documents by DartMinHash.

A document is a weighted set of hashed word shingles.  Every shingle owns a region of
the (weight, rank) plane into which hashing throws the same darts wherever it occurs;
a document keeps the darts below its weights and, for each of ``k`` coordinates, the
one of least rank.  Two documents share a coordinate's dart with the probability of
their weighted Jaccard similarity, so bands of coordinates give the candidates.  The
darts of all documents of a batch are thrown together in numpy.

Candidates are verified exactly, on the shingle sets of whole texts, and linked documents
form classes.  Documents with equal texts are one class; they are collapsed to the least
id before the search, so a group of copies costs one candidate.  Buckets are resolved by
``links.resolve``: no list of all pairs, no cap, and no loss but that of the bands.

With ``weights="set"`` each distinct shingle weighs 1 and the similarity is the plain
Jaccard similarity of the shingle sets; with ``"count"`` it weighs as often as it occurs.

Null text is empty text.  A text with fewer words than a shingle has its word sequence as
its one shingle; texts without words are linked to equal texts only.  Rows with a null id
or an id that repeats are grouped by text like any others; ``deduplicated`` tells them
apart by row.  An empty table gives an empty result.  The result has the columns named in
``near_duplicates``; others are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from .common import Scratch, numbered, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The lowest rank cell is [0, 2**LOW).
LOW = -14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes in text order, shingles per text)."""
    cut = [WORD.findall(t) for t in texts]
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for ws in cut for w in ws], np.int64)
    import xxhash

    of_word = np.array([xxhash.xxh64_intdigest(w.encode()) for w in index], np.uint64)
    h = of_word[flat] if len(flat) else np.zeros(0, np.uint64)
    n = np.array([len(ws) for ws in cut], np.int64)
    begin = np.cumsum(n) - n
    acc = np.zeros(len(h), np.uint64)
    size = np.minimum(n, words)  # a short text is one shingle of all its words
    left = np.repeat(size, n)
    for k in range(words):
        moved = np.concatenate((h[k:], np.zeros(min(k, len(h)), np.uint64)))
        acc = np.where(k < left, mix(acc * GOLD + moved + np.uint64(k + 1)), acc)
    count = np.where(n > 0, np.maximum(1, n - words + 1), 0)
    place = np.arange(len(h)) - np.repeat(begin, n)
    return acc[place < np.repeat(count, n)], count


def weighted(hashes: np.ndarray, counts: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with its weight, by document."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(d)))
    return d[at], h[at], n.astype(float) if weights == "count" else np.ones(len(at))


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers with the given mean, by inversion."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    logs = np.cumsum([-mean, *(math.log(mean / i) for i in range(1, top))])
    return np.searchsorted(np.cumsum(np.exp(logs)), u)


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def darts(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, level: np.ndarray, k: int, seed: int) -> tuple:
    """(document, coordinate, rank, dart) of all darts with rank below 2**level and weight
    below the shingle's.  Ranks and weights are cut into dyadic cells that depend on
    neither the document nor the level, so equal shingles get equal darts."""
    found = []
    slices = int(math.log2(weight.max(initial=1)))  # slice s covers weights [2**s - 1, 2**(s + 1) - 1)
    for s in range(slices + 1):
        has = weight > 2.0**s - 1
        for cell in range(LOW, int(level.max(initial=LOW)) + 1):  # [2**(cell - 1), 2**cell), the lowest from 0
            m = np.flatnonzero(has & (level >= cell))
            if not len(m):
                continue
            lo = 0.0 if cell == LOW else 2.0 ** (cell - 1)
            area = (2.0**cell - lo) * 2.0**s * k
            base = mix(shingle[m] + np.uint64(int(GOLD) * ((seed * 64 + s) * 128 + cell + 64) % (1 << 64)))
            n = poisson(unit(base), area)
            some = np.flatnonzero(n)
            rep = np.repeat(some, n[some])
            number = np.arange(len(rep)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            dart = mix(base[rep] + GOLD * (number + 1).astype(np.uint64))
            other = mix(dart)
            third = mix(other)
            keep = 2.0**s - 1 + unit(other) * 2.0**s < weight[m[rep]]
            rank = lo + unit(third) * (2.0**cell - lo)
            found.append((doc[m[rep]][keep], (dart[keep] % np.uint64(k)).astype(np.int64), rank[keep], dart[keep]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.uint64))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def signatures(hashes: np.ndarray, counts: np.ndarray, k: int, weights: str = "set", seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a shingle, their k darts).  Rank limits double for the few documents
    of which a coordinate was missed."""
    d, h, w = weighted(hashes, counts, weights)
    out = np.zeros((len(counts), k), np.uint64)
    total = np.bincount(d, w, len(counts))
    todo = np.flatnonzero(total > 0)
    level = np.full(len(counts), LOW)
    level[todo] = np.maximum(LOW, np.ceil(np.log2((math.log(k) + 2) / total[todo]))).astype(int)
    have = todo
    while len(todo):
        wanted = np.zeros(len(counts), bool)
        wanted[todo] = True
        m = wanted[d]
        dd, coord, rank, dart = darts(d[m], h[m], w[m], level[d[m]], k, seed)
        order = np.lexsort((rank, dd * k + coord))
        slot = (dd * k + coord)[order]
        first = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
        slot, best = slot[first], dart[order][first]
        filled = np.bincount(slot // k, minlength=len(counts))
        out.reshape(-1)[slot] = best
        todo = todo[filled[todo] < k]
        level[todo] += 1
    return have, out[have]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates, with its number in it."""
    n, k = sig.shape
    part = sig.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * GOLD, (n, k // rows)).copy()
    for r in range(rows):
        key = mix(key * GOLD + part[:, :, r])
    return key.view(np.int64)


def sign(docs: DataFrame, words: int, bands: int, rows: int, weights: str) -> DataFrame:
    """(id, row, copy, size, keys): ``copy`` tells texts apart, ``size`` is the set's weight,
    ``keys`` has one entry per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                hashes, counts = shingles([t or "" for t in part.column("text").to_pylist()], words)
                have, sig = signatures(hashes, counts, bands * rows, weights)
                sizes = np.zeros(len(part), np.int64)
                sizes[have] = bands
                flat = pa.array(band_keys(sig, rows).reshape(-1))
                weight = np.zeros(len(part))
                owner, _, w = weighted(hashes, counts, weights)
                np.add.at(weight, owner, w)
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), part.column("copy"), pa.array(weight), keys], names=["id", "row", "copy", "size", "keys"])

    return docs.select("id", "row", "copy", "text").mapInArrow(run, "id long, row long, copy binary, size double, keys array<long>")


def jaccard_at_least(threshold: float, words: int, weights: str):
    """Whether two texts are as similar, exactly, on whole texts; a pandas-free Arrow UDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 100):
                part = b.slice(at, 100)
                both = [t or "" for c in ("ta", "tb") for t in part.column(c).to_pylist()]
                texts = {t: k for k, t in enumerate(dict.fromkeys(both))}
                d, h, w = weighted(*shingles(list(texts), words), weights)
                cuts = np.searchsorted(d, np.arange(len(texts) + 1)).tolist()
                ok = []
                for x, y in zip(both[: len(part)], both[len(part) :], strict=True):
                    (i, j), (p, q) = ((cuts[texts[t]], cuts[texts[t] + 1]) for t in (x, y))
                    _, ia, ib = np.intersect1d(h[i:j], h[p:q], assume_unique=True, return_indices=True)
                    shared = np.minimum(w[i:j][ia], w[p:q][ib]).sum()
                    total = w[i:j].sum() + w[p:q].sum() - shared
                    ok.append(bool(total) and shared >= threshold * total - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok, pa.bool_())), part.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def shingle_sets(words: int, weights: str):
    """The distinct shingles of texts; one that weighs w is w tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                d, h, w = weighted(*shingles(part.column("text").to_pylist(), words), weights)
                w = w.astype(np.int64)
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                tokens = np.repeat(h, w) + GOLD * nth.astype(np.uint64)
                ends = np.cumsum(np.bincount(np.repeat(d, w), minlength=len(part)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("n"), lists], names=["id", "tokens"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 26, rows: int = 5, weights: str = "set"
) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the least id of its class), n_links (of
    its text to other texts, as verified) and is_representative.

    With the default bands a pair at the threshold is missed with probability 4e-5.
    """
    of_row = _classes(docs.withColumn("__row", F.lit(0).cast("long")), id_col, text_col, words, threshold, bands, rows, weights)
    return of_row.select("id", "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("is_representative"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, bands: int = 26, rows: int = 5, weights: str = "set") -> DataFrame:
    """(id, row, class_id, first, n_links) for ``docs`` with ``__row``; ``first`` is the class's
    row of least id, an id before none, then of least row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("__row").alias("row"), F.unhex(F.md5(text)).alias("copy"), text.alias("text"))
    signed = staged(sign(slim, words, bands, rows, weights), "darts")
    # a text stands for its copies; texts get numbers of their own, since ids may be null
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    texts = signed.groupBy("copy").agg(first.alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    texts = staged(texts.withColumn("n", F.monotonically_increasing_id()), "texts")
    with Scratch(docs.sparkSession) as scratch:
        verify, sets = _verifier(slim, texts, threshold, words, weights, scratch)
        found, labels = links.resolve(texts.select(F.col("n").alias("id"), "keys"), verify, sets, threshold)
    degree = found.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("n_links"))
    of_text = texts.select("n", "copy", "first").join(labels.withColumnRenamed("id", "n"), "n", "left").join(degree, "n", "left")
    of_text = of_text.select("copy", "first", F.coalesce("label", "n").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = of_text.groupBy("label").agg(F.min("first").alias("first"))
    of_text = of_text.drop("first").join(least, "label").select("copy", "first", "n_links")
    return signed.select("id", "row", "copy").join(of_text, "copy").select("id", "row", F.col("first.id").alias("class_id"), "first", "n_links")


def _verifier(slim: DataFrame, texts: DataFrame, threshold: float, words: int, weights: str, scratch: Scratch):
    """(verify, sets): the first joins candidates with their texts and compares them, the second
    gives the shingle sets of ids.  The texts of all ids that are ever asked for are written
    once, on the first call of ``verify``."""
    store: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not store:
            pairs = scratch.staged(pairs, "candidates")
            ids = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
            wanted = texts.select("n", "copy", F.col("first.id").alias("least"), "size").join(ids, "n", "left_semi")
            found = slim.join(wanted, (slim["copy"] == wanted["copy"]) & slim["id"].eqNullSafe(wanted["least"]))
            store.append(scratch.staged(found.groupBy("n").agg(F.first("text").alias("text"), F.first("size").alias("size")), "bodies"))
        body = store[0]
        side = lambda c: body.select(F.col("n").alias(c), F.col("text").alias(f"t{c}"), F.col("size").alias(f"s{c}"))
        near = F.least("sa", "sb") >= F.greatest("sa", "sb") * F.lit(threshold - 1e-9)  # sets of too different weights cannot be similar enough
        full = pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "ta", "tb")  # a hot id's text meets each of its partners: a join that Spark can split
        return full.mapInArrow(jaccard_at_least(threshold, words, weights), "a long, b long")

    def sets(ids: DataFrame) -> DataFrame:
        return store[0].join(ids.withColumnRenamed("id", "n"), "n", "left_semi").select("n", "text").mapInArrow(shingle_sets(words, weights), "id long, tokens array<long>")

    return verify, sets


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, of equal ids one."""
    rows = numbered(docs, id_col, "__row")
    first = _classes(rows, id_col, text_col, **options).where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")))
    keep = staged(first.select(F.col("id").alias("__id"), F.col("row").alias("__n")), "kept-rows")
    return rows.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__n")), "left_semi").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and is_representative; the links counted are those that were tested,
    enough to join each class, so their number is left out."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "is_representative")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), u AS (SELECT t, min(doc_id) AS n, any_value(ws) AS ws FROM d GROUP BY t
), s AS (
  SELECT DISTINCT n, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM u
), c AS (SELECT n, count(*) AS k FROM s GROUP BY n
), p AS (SELECT a.n AS a, b.n AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.n < b.n GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN c x ON a = x.n JOIN c y ON b = y.n WHERE m >= 0.8 * (x.k + y.k - m) - 1e-9
), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT n, n AS m FROM u UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a
), k AS (SELECT n, min(m) AS class_id FROM r GROUP BY n)
SELECT doc_id, class_id, doc_id = class_id AS is_representative FROM d JOIN u USING (t) JOIN k USING (n)
"""
