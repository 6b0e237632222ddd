"""Exact substring dedup with enhanced suffix arrays over anchored contexts.

A suffix array of a corpus does not fit a task, so suffixes are first brought together:

1. Winnowing.  Every string of ``length`` bytes picks the least hash among its ``k``-byte
   substrings as its anchor.  Equal strings pick equal anchors at equal offsets, so equal
   strings meet in the group of their anchor's hash, wherever they are.
2. Anchors whose hash is unique in the corpus drop out.  The rest have a context: the
   bytes of all strings that picked them.  Contexts that are equal as a whole are
   repeated as a whole and need no comparison, whatever their number.
3. In groups with different contexts, one context of each kind goes into an enhanced
   suffix array (suffixes, longest common prefixes, left neighbours), built for many
   groups at once.  A stack scan finds its common-prefix intervals; those with more than
   one left neighbour are the maximal repeats, reported with all their occurrences.
4. Groups with more than ``hot`` kinds of contexts are never gathered.  They are dealt anew
   by deeper context: a context's strings are halved by where the anchor lies in them, and
   either half goes by all bytes that its strings have in common.  Its parts go through
   steps 2 and 3, and what is still crowded is halved again, until a part holds one string.

Repeats are found on the input, overlaps included, and never cross documents.  Null text
is empty.  Rows are told apart by 128 bits of hash of id and text: equal rows are repeats
of one another.  Which contexts are equal as a whole is told by 128 bits too, 64 of the
anchor and 64 of the context.  ``repeats`` gives spans, ``repeat_groups`` the maximal repeats
with all their occurrences.  An empty table gives an empty result.  The functions have the
columns they name; others are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BASE = 0x9E3779B97F4A7C15 | 1
SLOTS = 1 << 20
BYTE_STEPS = np.array([1 << (8 * i) for i in range(8)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any slices of a byte array, from running sums modulo 2**64."""

    def __init__(self) -> None:
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)))) for b in (BASE, inverse))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.up[: len(data)])))

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((sums[hi] - sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(document, anchor, first string, last string, anchor hash, context hash) of the
    documents laid end to end; positions are within ``data``."""
    width = length - k + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    sums = hasher.sums(data)
    at = np.arange(len(data) - k + 1)
    h = hasher.of(sums, at, at + k)
    best, span = at, 1  # the leftmost least hash among span k-grams
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[b] < h[a], b, a)
        span *= 2
    if span < width:
        gap = width - span
        a, b = best[: len(best) - gap], best[gap:]
        best = np.where(h[b] < h[a], b, a)
    begins = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - begins)[: len(best)]
    i = np.flatnonzero(np.arange(len(best)) + length <= ends[doc])
    if not len(i):
        return none
    p, d = best[i], doc[i]
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
    last = np.append(first[1:], len(i)) - 1
    p, d, lo, hi = p[first], d[first], i[first], i[last]
    shape = (p - lo).astype(np.uint64) * np.uint64(1 << 20) + (p - hi).astype(np.uint64)
    return d, p, lo, hi, h[p].view(np.int64), _mix(hasher.of(sums, lo, hi + length) + shape).view(np.int64)


def suffix_array(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes data[starts:stops], sorted by group, then bytes; lcp[i]
    is the common prefix of the i-th and the one before, 0 across groups.

    Ranks are refined eight bytes at a time; only suffixes that still tie take part.
    """
    n = len(starts)
    wide = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8")[:, 0].astype(np.uint64)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, np.int64)
    g = group[order]
    tie = np.append(False, g[1:] == g[:-1])  # with the suffix before
    depth = 0
    while tie.any():
        live = np.flatnonzero(tie | np.append(tie[1:], False))
        bucket = np.cumsum(~tie)[live]
        at = starts[order[live]] + depth
        left = stops[order[live]] - at  # bytes left; beyond them counts as less than any byte
        shift = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        word = np.where(shift < 64, words[np.minimum(at, len(words) - 1)] >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)), np.uint64(0))
        seen = np.clip(left, 0, 8)
        by = np.lexsort((seen, word, bucket))
        order[live] = order[live][by]
        word, seen = word[by], seen[by]
        same = (word[1:] == word[:-1]) & (seen[1:] == seen[:-1]) & (seen[1:] == 8)
        differ = word[1:] ^ word[:-1]
        # the common bytes of two words: the leading zero bytes of their difference
        zeros = 8 - np.searchsorted(BYTE_STEPS, differ, side="right")
        common = np.minimum(zeros, np.minimum(seen[1:], seen[:-1]))
        inside = tie[live][1:]  # both in one bucket
        lcp[live[1:][inside]] += common[inside]
        tie[live[1:][inside]] = same[inside]
        depth += 8
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(lcp, first, last) of the common-prefix intervals of at least ``least`` bytes, by a stack scan."""
    deep = lcp >= least
    runs = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    for lo, hi in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        stack: list[list[int]] = []
        for i, v in enumerate(lcp[lo:hi].tolist(), lo):
            first = i - 1
            while stack and stack[-1][0] > v:
                top = stack.pop()
                yield top[0], top[1], i - 1
                first = top[1]
            if not stack or stack[-1][0] < v:
                stack.append([v, first])
        while stack:
            top = stack.pop()
            yield top[0], top[1], hi - 1


def maximal_repeats(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, group: np.ndarray, least: int, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The suffix order and the maximal repeats (length, first, last) in it.

    ``left`` is each suffix's left neighbour, or a negative number of its own where there
    is none; an interval is a maximal repeat if not all of its left neighbours are equal.
    """
    order, lcp = suffix_array(data, starts, stops, group)
    before = left[order]
    changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
    return order, [x for x in intervals(lcp, least) if changes[x[2]] > changes[x[1]]]


def repeats_in(contexts: list[bytes], offsets: list[int], groups: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context the spans (from, to) that maximal repeats within its group cover.
    ``offsets``: how many strings start in it, from its first byte on."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    n = np.array(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + within
    left = np.where(within > 0, data[starts - 1].astype(np.int64), -1 - owner)
    order, found = maximal_repeats(data, starts, (begin + sizes)[owner], np.array(groups)[owner], length, left)
    reach = np.zeros(len(owner), np.int64)
    for size, first, last in sorted(found):  # the longest repeat that starts at a suffix is set last
        reach[order[first : last + 1]] = size
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for s in np.flatnonzero(reach).tolist():
        spans, lo, hi = out[owner[s]], int(within[s]), int(within[s] + reach[s])
        if spans and spans[-1][1] >= lo:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return out


def groups_in(contexts: list[bytes], offsets: list[int], groups: list[int], length: int) -> Iterator[tuple[int, int, int, str]]:
    """(context, from, to, hash of the bytes) of every occurrence of every maximal repeat."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    n = np.array(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + within
    left = np.where(within > 0, data[starts - 1].astype(np.int64), -1 - owner)
    order, found = maximal_repeats(data, starts, (begin + sizes)[owner], np.array(groups)[owner], length, left)
    for size, first, last in found:
        at = order[first : last + 1]
        lo = int(starts[at[0]])
        known = hashlib.md5(data[lo : lo + size].tobytes()).hexdigest()
        for s in at.tolist():
            yield int(owner[s]), int(within[s]), int(within[s]) + size, known


ANCHOR_TYPE = "row binary, p int, lo int, hi int, fp long, kind long"


def _anchor_table(rows: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids = b.column("row")
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):  # about 2 MB at a time
                till, size = at, 0
                while till < len(texts) and size < 2_000_000:
                    size += len(texts[till])
                    till += 1
                part = texts[at:till]
                ends = np.cumsum([len(t) for t in part])
                d, p, lo, hi, fp, kind = anchors(np.frombuffer(b"".join(part), np.uint8), ends, length, k, hasher)
                base = np.concatenate(([0], ends))[d] if len(d) else d
                cols = [ids.take(pa.array(d + at)), *(pa.array((x - base).astype(np.int32)) for x in (p, lo, hi)), pa.array(fp), pa.array(kind)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "p", "lo", "hi", "fp", "kind"])
                at = till

    return rows.mapInArrow(run, ANCHOR_TYPE)


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(fp, row, p, lo, hi, context) of the anchors in ``wanted`` (fp, row, p, lo, hi)."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("fp", "p", "lo", "hi")).alias("at"))  # bounded by a text's length
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).alias("slot")
    slots = wanted.select(slot).distinct()  # SLOTS rows at most
    near = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    cut = near.dropDuplicates(["row"]).join(asked, "row").select("row", "text", F.explode("at").alias("a"))
    return cut.select("a.fp", "row", "a.p", "a.lo", "a.hi", F.expr(f"substring(text, a.lo + 1, a.hi - a.lo + {length})").alias("context"))


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans (row, lo, hi) among the contexts of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def spans(some: list[dict]) -> pa.RecordBatch:
            index: dict[int, int] = {}
            marks = repeats_in([r["context"] for r in some], [r["hi"] - r["lo"] + 1 for r in some], [index.setdefault(r["fp"], len(index)) for r in some], length)
            flat = [(r["row"], r["lo"] + lo, r["lo"] + hi) for r, m in zip(some, marks, strict=True) for lo, hi in m]
            cols = list(zip(*flat, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["row", "lo", "hi"])

        for b in batches:
            for k in range(0, len(b), 2000):
                held += b.slice(k, 2000).to_pylist()
                last = held[-1]["fp"]
                whole = [r for r in held if r["fp"] != last]  # groups lie together; the last may go on
                if len(whole) >= 2000:
                    yield spans(whole)
                    held = [r for r in held if r["fp"] == last]
        if held:
            yield spans(held)

    slim = contexts.select("fp", "row", "lo", "hi", "context")
    return slim.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "row binary, lo int, hi int")


def _grouped(contexts: DataFrame, length: int) -> DataFrame:
    """(fp, row, p, from, to, group): occurrences of maximal repeats among the contexts of each
    group, relative to the anchor; a context that others equal (``n`` > 1) is one as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told(some: list[dict]) -> Iterator[pa.RecordBatch]:
            index: dict[int, int] = {}
            places = [index.setdefault(r["fp"], len(index)) for r in some]
            whole = ((i, 0, len(r["context"]), hashlib.md5(r["context"]).hexdigest()) for i, r in enumerate(some) if r["n"] > 1)
            every = itertools.chain(whole, groups_in([r["context"] for r in some], [r["hi"] - r["lo"] + 1 for r in some], places, length))
            while part := list(itertools.islice(every, 20000)):
                rows = [(some[i]["fp"], some[i]["row"], some[i]["p"], some[i]["lo"] - some[i]["p"] + lo, some[i]["lo"] - some[i]["p"] + hi, g) for i, lo, hi, g in part]
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["fp", "row", "p", "from", "to", "group"])

        for b in batches:
            for k in range(0, len(b), 2000):
                held += b.slice(k, 2000).to_pylist()
                last = held[-1]["fp"]
                whole = [r for r in held if r["fp"] != last]
                if len(whole) >= 2000:
                    yield from told(whole)
                    held = [r for r in held if r["fp"] == last]
        if held:
            yield from told(held)

    slim = contexts.select("fp", "row", "p", "lo", "hi", "context", "n")
    return slim.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "fp long, row binary, p int, `from` int, `to` int, `group` string")


def _of_kind(found: DataFrame, kinds: DataFrame, members: DataFrame) -> DataFrame:
    """As ``_grouped``: what was found at one anchor of a kind, at all of that kind; ``fp`` is
    then the group that each came from, ``up``."""
    one = kinds.select("fp", "kind", F.col("one.row").alias("row"), F.col("one.p").alias("p"))
    of_kind = found.join(one, ["fp", "row", "p"]).select("fp", "kind", "from", "to", "group")
    return of_kind.join(members.select("fp", "kind", "row", "p", "up"), ["fp", "kind"]).select(F.col("up").alias("fp"), "row", "p", "from", "to", "group")


def _halved(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of crowded groups as two each: of the strings whose anchor lies ``a`` to ``b``
    bytes behind their start, those below the middle and those from it on.  The new group is
    known by the bytes that all such strings have in common, the kind by all of them."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))).alias("d")
    h = contexts.withColumnsRenamed({"lo": "from", "hi": "to"}).withColumn("d", part).drop("a", "b").select("*", "d.a", "d.b")
    h = h.withColumn("lo", F.greatest("from", F.col("p") - F.col("b") + 1)).withColumn("hi", F.least("to", F.col("p") - F.col("a"))).where("a < b AND lo <= hi")
    common = F.expr(f"substring(context, p - a - from + 1, {length} - (b - 1 - a))")
    own = F.expr(f"substring(context, lo - from + 1, hi - lo + {length})")
    carried = [c for c in ("n",) if c in contexts.columns]
    h = h.select(F.xxhash64("fp", "a", "b", common).alias("fp"), F.col("fp").alias("up"), "row", "p", "lo", "hi", "a", "b", own.alias("context"), *carried)
    return h.withColumn("kind", F.xxhash64("context", F.col("p") - F.col("lo")))


def repeats(rows: DataFrame, length: int = 200, k: int = 64, hot: int = 4096) -> DataFrame:
    """(row, lo, hi): spans of ``rows`` (row, text as bytes) that together cover exactly the
    bytes of all strings of ``length`` bytes that start at two or more places."""
    spans = lambda t: t.select("row", "lo", (F.col("hi") + length).alias("hi"))
    found = staged(_anchor_table(rows, length, k), "anchors")
    groups = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("kind").alias("k0"), F.max("kind").alias("k1")).where("n > 1")
    # written first: Spark splits a hot key's rows only in joins whose inputs come straight from a shuffle
    groups = staged(groups.select("fp", (F.col("k0") != F.col("k1")).alias("varied")), "groups")
    shared = staged(found.join(groups, "fp"), "shared")
    out = [spans(shared.where("NOT varied"))]

    varied = shared.where("varied")
    kinds = staged(varied.groupBy("fp", "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "lo", "hi")).alias("one")), "kinds")
    out.append(spans(varied.join(kinds.where("n > 1").select("fp", "kind"), ["fp", "kind"], "left_semi")))
    crowded = staged(kinds.groupBy("fp").agg((F.count("*") > hot).alias("crowded")), "crowded")
    contexts = staged(_contexts(rows, kinds.select("fp", "one.*"), length).join(crowded, "fp"), "contexts")
    width, few, many = length - k + 1, contexts.where("NOT crowded"), contexts.where("crowded")
    many = many.withColumns({"a": F.lit(0), "b": F.lit(width)})
    while True:
        out.append(_compare(few, length))
        if width == 1 or many.isEmpty():
            return functools.reduce(DataFrame.unionByName, out)
        width = -(-width // 2)
        halves = staged(_halved(many, length), "halves")
        kinds = halves.groupBy("fp", "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "lo", "hi", "a", "b", "context")).alias("one"))
        kinds = staged(kinds, "half-kinds")
        out.append(spans(halves.join(kinds.where("n > 1").select("fp", "kind"), ["fp", "kind"], "left_semi")))
        sizes = staged(kinds.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1"), "half-groups")
        left = staged(kinds.select("fp", "one.*").join(sizes, "fp"), "half-contexts")
        few, many = left.where(F.col("m") <= hot), left.where(F.col("m") > hot)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 64, hot: int = 4096) -> DataFrame:
    """(group, doc_id, lo, hi): the maximal repeats of ``length`` bytes or more with all their
    occurrences; bytes lo to hi of the texts of a group are equal.

    A repeat is maximal within the context of its anchor: a longer passage is a chain of
    overlapping repeats, one for each anchor in it.  Rows of equal id and text share a row
    of the result for each of theirs.  The result is as large as the repeats it lists.
    """
    rows = byte_rows(docs, id_col, text_col)
    found = staged(_anchor_table(rows.select("row", "text"), length, k), "anchors")
    groups = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("kind").alias("k0"), F.max("kind").alias("k1")).where("n > 1")
    groups = staged(groups.select("fp", (F.col("k0") != F.col("k1")).alias("varied")), "groups")
    shared = staged(found.join(groups, "fp"), "shared")
    alike = shared.where("NOT varied").select(F.md5(F.concat_ws(" ", "fp", "kind")).alias("group"), "row", "lo", (F.col("hi") + length).alias("hi"))
    members = shared.where("varied")
    kinds = staged(members.groupBy("fp", "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "lo", "hi")).alias("one")), "kinds")
    crowded = staged(kinds.groupBy("fp").agg((F.count("*") > hot).alias("crowded")), "crowded")
    times = kinds.select("fp", F.col("one.row").alias("row"), F.col("one.p").alias("p"), "n")
    contexts = _contexts(rows.select("row", "text"), kinds.select("fp", "one.*"), length)
    contexts = staged(contexts.join(times, ["fp", "row", "p"]).join(crowded, "fp"), "contexts")
    width, many = length - k + 1, contexts.where("crowded")
    levels, out = [(kinds, members.withColumn("up", F.col("fp")))], [_grouped(contexts.where("NOT crowded"), length)]
    many = many.withColumns({"a": F.lit(0), "b": F.lit(width)})
    while width > 1 and not many.isEmpty():
        width = -(-width // 2)
        halves = staged(_halved(many, length), "halves")
        parts = halves.groupBy("fp", "kind").agg(F.sum("n").alias("n"), F.min(F.struct("row", "p", "lo", "hi", "a", "b", "context")).alias("one"))
        parts = staged(parts, "half-kinds")
        sizes = staged(parts.groupBy("fp").agg(F.count("*").alias("m")), "half-groups")
        left = staged(parts.select("fp", "n", "one.*").join(sizes, "fp").where("m > 1 OR n > 1"), "half-contexts")
        levels.append((parts, halves))
        out.append(_grouped(left.where(F.col("m") <= hot), length))
        many = left.where(F.col("m") > hot)
    every = []
    for depth, found in enumerate(out):  # from one anchor of a kind to all, level by level up
        found = staged(found.distinct(), "found")
        for parts, those in reversed(levels[: depth + 1]):
            found = _of_kind(found, parts, those)
        every.append(found.select("group", "row", (F.col("p") + F.col("from")).alias("lo"), (F.col("p") + F.col("to")).alias("hi")))
    every = functools.reduce(DataFrame.unionByName, every)
    told = staged(alike.unionByName(every).distinct(), "occurrences")
    several = told.groupBy("group").count().where("count > 1").select("group")
    return told.join(several, "group").join(rows.select("row", "doc_id"), "row").select("group", "doc_id", "lo", "hi")


def byte_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x00")), F.lit("\x01"), text)))
    return docs.select(key.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.cast("binary").alias("text"))


OUT_TYPE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 64, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes
    left over, if ``keep_text``) and kept_sha256."""
    rows = byte_rows(docs, id_col, text_col)
    spans = repeats(rows.select("row", "text"), length, k)
    per = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # bounded by a text's length
    joined = rows.join(per, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                out = []
                for text, lo, hi in zip(*(part.column(c).to_pylist() for c in ("text", "lo", "hi")), strict=True):
                    edge = np.zeros(len(text) + 1, np.int32)
                    if lo:
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if lo else text
                    out.append((len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, cols, kinds)], names=[c.split()[0] for c in OUT_TYPE.split(", ")])

    return joined.mapInArrow(run, OUT_TYPE)


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, keep_text=False).drop("kept")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5_number(substring(h, 2 * i + 1, 400)) AS s FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
g AS (SELECT rid, i, count(*) FILTER (before IS NULL OR i - before > 200) OVER (PARTITION BY rid ORDER BY i) AS run FROM r),
x AS (SELECT rid, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY rid, run),
y AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS upto FROM x),
z AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) || any_value(substring(h, 2 * last + 1)) AS kept
      FROM y JOIN d USING (rid) JOIN (SELECT rid, max(hi) AS last FROM x GROUP BY rid) USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (rid)
"""
