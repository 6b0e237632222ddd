"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and as many ids as fit into 60 bits at the
selector's width; an id too wide for that is escaped and takes a word of its own.  A
block holds the ids of a run of documents: header, document ids, where each document's
ids end, the id count before every 1024th word, then the words.  Selectors are grouped,
so encoding and decoding are array operations; the offsets let a reader of some of the
ids start and stop inside (``read_ids``, ``token_range``).

Files are binary values, a block each, in a Parquet table in ascending document order:
Spark writes and reads them wherever it has its storage.  Texts are range-partitioned by
document id and encoded where they land; only block totals are summed across tasks.

Null text is empty text: such a document has the end id alone.  A null document id sorts
first and comes back as null.  Rows with equal ids keep together in no set order.  An
empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .wordtable import WordTable

#: Ids a word and bits an id, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 60) - 1
MAGIC, HEADER = b"S8B1", "<4sIQQI"
EVERY = 1024


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` (uint64) as Simple-8b words, and how many ids are in each: none in a word that
    follows an escape.  The last word may be padded with zeros."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = ids >= ESCAPE
    top = int(ids[~wide].max(initial=0))
    step = np.ones(n, np.int64)
    sel = np.full(n, 15, np.int8)
    at = np.arange(n)
    for s in range(14, -1, -1):
        fits = ids < (1 << WIDTHS[s])
        if top < 1 << WIDTHS[s] and not wide.any():
            run = n - at
        else:
            bad = np.where(fits, n, at)
            run = np.minimum.accumulate(bad[::-1])[::-1] - at
        # a word reaching past the end is padded, so all ids left need only fit
        full = run >= COUNTS[s]
        ok = full | (run == n - at) & fits
        sel[ok], step[ok] = s, COUNTS[s]
        if not full.any():  # narrower words would need longer runs of smaller ids
            break
    hops, i, jumps = [], 0, step.tolist()
    while i < n:
        hops.append(i)
        i += jumps[i]
    starts = np.array(hops)
    chosen = sel[starts]
    sizes = np.where(wide[starts], 2, 1)
    place = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(240, np.uint64)))
    for s in np.unique(chosen).tolist():
        here = chosen == s
        word = np.full(int(here.sum()), s << 60, np.uint64)
        if WIDTHS[s]:
            first = starts[here]
            for k in range(COUNTS[s]):
                value = padded[first + k]
                if s == 15:
                    value = np.where(wide[first], np.uint64(ESCAPE), value)
                word |= value << np.uint64(k * WIDTHS[s])
        out[place[here]] = word
    out[place[wide[starts]] + 1] = ids[starts[wide[starts]]]
    counted = np.zeros(len(out), np.int64)
    counted[place] = np.array(COUNTS)[chosen]
    return out, counted


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of ``words``."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64(ESCAPE)
    raw = np.zeros(len(words), bool)  # the word after an escape
    marks = np.flatnonzero((sel == 15) & (body == ESCAPE))
    last = -2
    for m in marks.tolist():  # an escaped id may itself look like an escape
        if m != last + 1:
            raw[m + 1], last = True, m
    sizes = np.where(raw, 0, np.array(COUNTS)[sel])
    place = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in np.unique(sel[~raw]).tolist():
        if not WIDTHS[s]:
            continue
        here = np.flatnonzero((sel == s) & ~raw)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[place[here] + k] = (body[here] >> np.uint64(k * WIDTHS[s])) & mask
    if raw.any():
        out[place[np.flatnonzero(raw) - 1]] = words[raw]
    return out[:n]


def write_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, counted = pack(ids.astype(np.uint64))
    before = (np.cumsum(counted) - counted)[::EVERY]
    # the lowest bit tells that the word belongs to the escape before: reading starts behind it
    offsets = before * 2 + (counted[::EVERY] == 0)
    body = b"".join((
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.cumsum(sizes).astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ))
    return struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(words), zlib.crc32(body)) + body


def read_ids(data: bytes, lo: int, hi: int) -> np.ndarray:
    """The ids ``lo`` to ``hi`` of a block; no words are decoded but those between the two
    offsets around them."""
    _, docs, n, n_words, _ = struct.unpack_from(HEADER, data)
    lo, hi = max(lo, 0), min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint64)
    at = struct.calcsize(HEADER) + 17 * docs
    offsets = np.frombuffer(data, "<u8", -(-n_words // EVERY), at).astype(np.int64)
    before, begin = offsets >> 1, np.arange(len(offsets)) * EVERY + (offsets & 1)
    first, last = int(np.searchsorted(before, lo, side="right")) - 1, int(np.searchsorted(before, hi))
    stop = int(begin[last]) if last < len(begin) else n_words
    words = np.frombuffer(data, "<u8", stop - int(begin[first]), at + 8 * len(offsets) + 8 * int(begin[first]))
    skipped = int(before[first])
    return unpack(words, hi - skipped)[lo - skipped :]


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, where each one's ids end, ids)."""
    magic, docs, n, _, crc = struct.unpack_from(HEADER, data)
    at = struct.calcsize(HEADER)
    if magic != MAGIC or zlib.crc32(memoryview(data)[at:]) != crc:
        raise ValueError("not a whole Simple-8b block")
    none, ids, ends = np.frombuffer(data, "u1", docs, at), np.frombuffer(data, "<i8", docs, at + docs), np.frombuffer(data, "<u8", docs, at + 9 * docs)
    return [None if z else d for z, d in zip(none.tolist(), ids.tolist(), strict=True)], ends.astype(np.int64), read_ids(data, 0, n)


#: The controls 28 to 31 count as white space for str.split, but not for tokenizers.
ODD = re.compile("[\x1c-\x1f]")
ASCII_SPACE = re.compile("[ \t-\r]+")


def pieces(text: str) -> list[str]:
    """Parts between white space: a tokenizer that drops it encodes each on its own."""
    if ODD.search(text):
        return [p for p in ASCII_SPACE.split(text) if p]
    return text.split()


def word_encoder(tokenizer_path: str, at_once: int = 500) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of words, end to end, and ids per word.  Words are encoded many to a text, and
    told apart by where the ids' characters begin, since each call has its price."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    tok.no_truncation()
    tok.no_padding()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            begins = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    return encode


@functools.cache
def word_table(tokenizer_path: str) -> WordTable:
    """One table for all tasks of a worker process."""
    return WordTable(word_encoder(tokenizer_path))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 256) -> DataFrame:
    """The written files: part, block, inside (ids before it in its part), n_docs, n_ids and
    data; blocks ascend by (part, block)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, inside = word_table(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for k in range(0, len(b), block_docs):
                some = b.slice(k, block_docs)
                ids, sizes = table.ids([pieces(t or "") for t in some.column("text").to_pylist()])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                data = write_block(some.column("doc_id").to_pylist(), sizes, ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "inside": pa.array([inside], pa.int64()), "n_docs": pa.array([len(some)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
                block, inside = block + 1, inside + len(ids)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(placed.mapInArrow(encode, "part int, block int, inside long, n_docs long, n_ids long, data binary"), "tokens")


def located(files: DataFrame) -> DataFrame:
    """``files`` with start: ids in all blocks before.  Only the parts' totals are summed, a
    row for each task that wrote, and go to the blocks as a broadcast."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("inside"))


def token_range(files: DataFrame, first: int, count: int) -> DataFrame:
    """(start, ids): the ids ``first`` to ``first + count`` of all files laid end to end, a
    piece for each block they lie in; ids are little-endian unsigned 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                lo = max(first - start, 0)
                ids = read_ids(data.as_py(), lo, first + count - start).astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"start": pa.array([start + lo], pa.int64()), "ids": pa.array([ids], pa.binary())})

    inside = located(files).where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first))
    return inside.select("start", "data").mapInArrow(cut, "start long, ids binary")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned
    32-bit) of each document in the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                docs, ends, ids = read_block(data.as_py())
                begin = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                parts = [raw[4 * lo : 4 * hi] for lo, hi in zip(begin.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(begin + start, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(map(bytes, parts), pa.binary())] if with_ids else [])], names=names)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return located(files).select("start", "data").mapInArrow(decode, kinds)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path), with_ids=False)
