"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut by the tokenizer's pattern.  The distinct pieces that a task has not met
yet are encoded together: their symbols lie in one flat array, a round finds the rank of
every neighbouring pair by binary search over the sorted pair keys, and merges in each
piece all pairs of its lowest rank.  Pieces without a mergeable pair drop out.

Null text is empty text and has no ids.  Rows are independent, so repeated rows, ties
and empty tables need no special case; ``encode_column`` keeps the input's columns but
replaces those it writes.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtable import WordTable

# --- fixed values: white space of Unicode and the tokenizer's pattern ---
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
# --- end of fixed values ---
#: Runs that the pattern never joins: what a chunk holds depends on the chunk alone.
CHUNK = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NEVER = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte: itself if printable, else the next code from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = byte_letters()
        self.size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of = {c: b for b, c in letters.items()}
        table = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_ends = np.cumsum([len(t) for t in table])
        self.piece, self.chunk = regex.compile(PIECE), regex.compile(CHUNK)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: merge rounds over all of them at once."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        live = np.arange(len(words))
        if not len(sym):
            return [np.zeros(0, np.int64) for _ in words]
        inside = np.append(owner[1:] == owner[:-1], False)
        rank = np.full(len(sym), NEVER)
        at = np.flatnonzero(inside)
        rank[at] = self._ranks(sym[at], sym[at + 1])
        while len(sym):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(heads, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, heads), counts)
            done = best == NEVER
            if done.any():
                mine = owner[done]
                cuts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                for w, ids in zip(mine[cuts].tolist(), np.split(sym[done], cuts[1:]), strict=True):
                    out[w] = ids
                sym, owner, rank, best = sym[~done], owner[~done], rank[~done], best[~done]
                if not len(sym):
                    break
            hit = rank == best
            # of overlapping pairs (aaa) every second one from the left is merged
            starts = hit & ~np.append(False, hit[:-1])
            run = np.cumsum(starts)
            place = np.arange(len(hit))
            hit &= (place - place[starts][np.maximum(run - 1, 0)]) % 2 == 0 if starts.any() else hit
            spots = np.flatnonzero(hit)
            sym[spots] = self.made[rank[spots]]
            keep = np.ones(len(sym), bool)
            keep[spots + 1] = False
            new = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            touched = np.unique(np.concatenate((new[spots], np.maximum(new[spots] - 1, 0))))
            rank[touched] = NEVER
            pair = touched[touched < len(sym) - 1]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[pair] = self._ranks(sym[pair], sym[pair + 1])
        return [np.zeros(0, np.int64) if x is None else x for x in out]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and ids per chunk."""
        out: list[np.ndarray | None] = [np.array([self.special[c]]) if c in self.special else None for c in chunks]
        todo = [k for k, x in enumerate(out) if x is None]
        cut = [self.piece.findall(chunks[k]) for k in todo]
        distinct = list(dict.fromkeys(p for c in cut for p in c))
        ids = {}
        for at in range(0, len(distinct), 5000):  # arrays that stay in the cache
            ids |= zip(distinct[at : at + 5000], self.merge([p.encode() for p in distinct[at : at + 5000]]), strict=False)
        for k, c in zip(todo, cut, strict=True):
            out[k] = ids[c[0]] if len(c) == 1 else np.concatenate([ids[p] for p in c]) if c else np.zeros(0, np.int64)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def chunks(self, text: str) -> list[str]:
        if self.special_cut is None or not any(s in text for s in self.special):
            return self.chunk.findall(text)
        return [c for part in self.special_cut.split(text) for c in ([part] if part in self.special else self.chunk.findall(part))]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of several id runs laid end to end, as UTF-8."""
        hi = self.byte_ends[ids]
        n = hi - np.append(0, self.byte_ends)[ids]
        ends = np.cumsum(n)
        raw = self.bytes[np.repeat(hi - ends, n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.append(0, ends)[np.cumsum(np.append(0, sizes))].tolist()
        parts = [raw[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return [p.decode("utf-8", "replace").encode() for p in parts]


@functools.cache
def loaded(tokenizer_path: str) -> tuple[ByteBPE, WordTable]:
    """The vocabulary and one table for all tasks of a worker process."""
    bpe = ByteBPE(tokenizer_path)
    return bpe, WordTable(bpe.encode_chunks)


TYPE = "n_tokens long, ids binary"


def encode_column(docs: DataFrame, tokenizer_path: str, text_col: str = "text", rows: int = 256, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_tokens and ids (little-endian unsigned 32-bit)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = loaded(tokenizer_path)
        for b in batches:
            for k in range(0, len(b), rows):
                some = b.slice(k, rows)
                column = some.column("text") if apart else some.column("row").field(text_col)
                ids, sizes = table.ids([bpe.chunks(t or "") for t in column.to_pylist()])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                parts = [raw[4 * lo : 4 * hi] for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["row", "n_tokens", "ids"])

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids")]
    apart = text_col not in names  # a text that is kept goes to the workers once
    kept = [F.col(f"`{c}`") for c in names] or [F.lit(None).cast("string").alias("none")]
    packed = docs.select(F.struct(*kept).alias("row"), *([F.col(f"`{text_col}`").alias("text")] if apart else []))
    return packed.mapInArrow(encode, f"row {packed.schema['row'].dataType.simpleString()}, {TYPE}").select("row.*", "n_tokens", "ids")


DIGEST_TYPE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def decoded_digest(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text they decode to."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(tokenizer_path)
        for b in batches:
            for k in range(0, len(b), 256):
                some = b.slice(k, 256)
                raws = some.column("ids").to_pylist()
                texts = bpe.decode(np.frombuffer(b"".join(raws), "<u4").astype(np.int64), some.column("n_tokens").to_numpy())
                hashes = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (raws, texts)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_tokens"), *(pa.array(h, pa.string()) for h in hashes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids").mapInArrow(decode, DIGEST_TYPE)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return decoded_digest(encode_column(docs, tokenizer_path, keep=["doc_id"]), tokenizer_path)


def decode_column(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (with n_tokens and ids) with the column ``decoded``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(tokenizer_path)
        for b in batches:
            for k in range(0, len(b), 256):
                some = b.slice(k, 256)
                ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), "<u4").astype(np.int64)
                texts = bpe.decode(ids, some.column("n_tokens").to_numpy())
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array([t.decode() for t in texts], pa.string())], names=["row", "decoded"])

    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "decoded"]).alias("row"), "n_tokens", "ids")
    return packed.mapInArrow(decode, f"row {packed.schema['row'].dataType.simpleString()}, decoded string").select("row.*", "decoded")
