"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is a character n-gram model over an open alphabet: 62 characters, digits and all
other signs, which are the 64 base symbols, and every further letter or mark, and every sign
from U+3000 on, as a symbol of its own.  It is trained on trusted text.
N-grams are counted in the tasks and summed by Spark; continuation counts, discounts and
context totals are joins and aggregations over count tables that are sharded by n-gram
or context.  A document is kept if its perplexity is at most its language's threshold:
a quantile over all trusted documents of that language, times a margin.

Of base symbols the model has at most 64**order n-grams, whatever the corpus, so these go to
the tasks as a whole and are scored where documents lie: joining them with the tables by a
shuffle would move several times the corpus to the same result.  N-grams with a further letter
have no such bound: those of a document, each once with its number, are joined with the
sharded tables of all orders, and their logarithms added to the document's.

All trusted documents are counted, and all of them set the thresholds: for these they are
dealt by hash of id into ``held_out`` parts, and each part is scored under the model of the
others.  Documents are scored where they lie and their scores joined with the trusted ids;
only counting moves texts, once, and of those that are not trusted few: a broadcast table of
hash slots, bounded, tells most of them before.  Verdicts are of the model of all.  Null or empty text has no perplexity and is not
kept.  A null language is a language.  A language without trusted documents uses the
threshold over all trusted documents; without any, nothing is rejected.  Repeated rows
are scored alike, an empty table gives an empty result, and columns other than those
named are ignored.

Letters that no trusted text has count as other signs.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, may_be_among, staged
from .merkle import digit_ranks

#: Base symbols: these characters, then digits and all other signs.  Further letters follow by code.
SYMBOLS = "\n abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß.,;:!?'-|"
DIGIT, OTHER = len(SYMBOLS), len(SYMBOLS) + 1
HELD_OUT = 2
#: Quantiles are exact to so small a part of a perplexity.
STEP = 1e-6
SIZE = 64
ORDER = 4
#: Bits of a symbol.  A context is one number, which the symbol behind it stands beside.
BITS = 21
#: Hash slots of trusted ids, 64 a row.  Where they are full they keep nothing back.
SLOTS = 1 << 24


def symbol_table(letters: np.ndarray | None = None) -> np.ndarray:
    """The symbol of each code point; of further letters only ``letters`` (symbols) are told apart, if given."""
    own = np.arange(0x110000, dtype=np.int32) + SIZE
    table = np.where(own - SIZE < 0x3000, np.int32(OTHER), own)
    for code in range(0x3000):
        if unicodedata.category(chr(code))[0] in "LM":
            table[code] = own[code]
        elif chr(code).isdigit():
            table[code] = DIGIT
        elif chr(code).isspace():
            table[code] = 1
    for i, c in enumerate(SYMBOLS):
        table[ord(c)] = i
    if letters is not None:
        known = np.zeros(0x110000 + SIZE, bool)
        known[:SIZE] = known[letters] = True
        table = np.where(known[table], table, np.int32(OTHER))
    return table


def grams(texts: list[str], table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and symbol of the n-gram that ends at each symbol, symbols per text).  Texts start after line ends."""
    pad = "\n" * (order - 1)
    sym = table[np.frombuffer("".join(pad + t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = np.array([len(t.lower()) for t in texts], np.int64)
    ctx = np.zeros(len(sym), np.int64)
    for k in range(order - 1):
        ctx[order - 1 :] = (ctx[order - 1 :] << BITS) + sym[k : len(sym) - order + 1 + k]
    begin = np.cumsum(n + order - 1) - n
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return ctx[at], sym[at], n


def packed(ctx: np.ndarray, sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One number below SIZE**order for each n-gram of base symbols, -1 for the others."""
    code, base = sym.astype(np.int32), sym < SIZE
    for k in range(order - 1):
        one = (ctx >> (BITS * k)) & ((1 << BITS) - 1)
        base &= one < SIZE
        code += (one & (SIZE - 1)).astype(np.int32) << (6 * (k + 1))
    return np.where(base, code, -1)


def unpacked(code: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    ctx = np.zeros(len(code), np.int64)
    for k in range(order - 1):
        ctx += ((code.astype(np.int64) >> (6 * (k + 1))) & (SIZE - 1)) << (BITS * k)
    return ctx, (code & (SIZE - 1)).astype(np.int32)


def tallied(of: np.ndarray, ctx: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(of, ctx, sym, number) of the different triples."""
    order = np.lexsort((sym, ctx, of))
    of, ctx, sym = of[order], ctx[order], sym[order]
    first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(ctx) != 0) | (np.diff(sym) != 0))[: len(of)])
    return of[first], ctx[first], sym[first], np.diff(np.append(first, len(of)))


def count_grams(texts: DataFrame, parts: int = 1) -> DataFrame:
    """(part, ctx, sym, c) over the columns ``text`` and ``part``, a number below ``parts``."""

    def rows(part: np.ndarray, ctx: np.ndarray, sym: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(ctx), pa.array(sym), pa.array(c)], names=["part", "ctx", "sym", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = symbol_table(), SIZE**ORDER
        total = np.zeros(parts * size, np.int64)
        for b in batches:
            for k in range(0, len(b), 200):
                some = b.slice(k, 200)
                ctx, sym, n = grams([t or "" for t in some.column("text").to_pylist()], table)
                part, code = np.repeat(some.column("part").to_numpy(), n).astype(np.int64), packed(ctx, sym)
                base = code >= 0
                np.add.at(total, code[base] + part[base] * size, 1)
                if not base.all():
                    yield rows(*tallied(part[~base], ctx[~base], sym[~base]))
        seen = np.flatnonzero(total)
        yield rows(seen // size, *unpacked(seen % size), total[seen])

    return texts.select("text", F.col("part").cast("int")).mapInArrow(run, "part int, ctx long, sym int, c long").groupBy("part", "ctx", "sym").agg(F.sum("c").alias("c"))


class Model(NamedTuple):
    """Of each order from 1 up: packed n-grams of base symbols and their alpha, packed contexts
    and their gamma; the further letters; with such, for each order a table of all n-grams."""

    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    letters: np.ndarray
    tables: list[DataFrame]


def discounted(counts: DataFrame) -> DataFrame:
    """(ctx, sym, alpha, gamma): the discounted share of each n-gram in its context, and the
    context's share for the lower order, with modified Kneser-Ney discounts."""
    n = counts.agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.coalesce(F.lit(i) - F.lit(i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.75)) for i in (1, 2, 3)]
    levels = n.select(*[F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), x)).alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)]).first()
    c = F.col("c")
    cut = counts.withColumn("d", F.when(c == 1, levels["d1"]).when(c == 2, levels["d2"]).otherwise(levels["d3"]))
    of_ctx = cut.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
    return cut.join(of_ctx, "ctx").select("ctx", "sym", ((c - F.col("d")) / F.col("total")).alias("alpha"), (F.col("mass") / F.col("total")).alias("gamma"))


def train(texts: DataFrame) -> Model:
    """The model of the column ``text``."""
    return model_of(count_grams(texts.withColumn("part", F.lit(0))))


def of_base(order: int) -> Column:
    """Whether the context of an n-gram has base symbols only."""
    return functools.reduce(Column.__and__, [F.shiftright("ctx", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) < SIZE for k in range(order - 1)], F.lit(True))


def model_of(counts: DataFrame) -> Model:
    """``train`` for texts that are counted, in whatever parts."""
    counts = staged(counts.groupBy("ctx", "sym").agg(F.sum("c").alias("c")), "ngrams")
    letters = np.array(sorted(r["sym"] for r in counts.where(F.col("sym") >= SIZE).select("sym").distinct().collect()), np.int32)  # code points: bounded
    orders, tables = [], []
    for order in range(ORDER, 0, -1):
        shares = discounted(counts)
        if len(letters):
            shares = staged(shares, "shares")
            tables.append(shares)
        base = shares.where(of_base(order))
        own = base.where(F.col("sym") < SIZE).toPandas()  # at most SIZE**order rows
        ends = base.select("ctx", "gamma").distinct().toPandas() if len(letters) else own  # a context may have further letters behind it alone
        code = packed(own["ctx"].to_numpy(), own["sym"].to_numpy(), order)
        orders.append((code, own["alpha"].to_numpy(), packed(ends["ctx"].to_numpy(), np.zeros(len(ends), np.int32), order) >> 6, ends["gamma"].to_numpy()))
        # the next lower order counts in how many different n-grams its own are the end
        counts = staged(counts.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << BITS * max(0, order - 2)) - 1)).alias("ctx"), "sym").agg(F.count("*").alias("c")), "ngrams") if order > 1 else counts
    return Model(orders[::-1], letters, tables[::-1])


def log_probabilities(model: Model) -> np.ndarray:
    """log p of every n-gram's last symbol after the others, of base symbols: 64**order values."""
    p = np.full(1, 1.0 / (SIZE + len(model.letters)), np.float32)
    for order, (gram, alpha, ctx, gamma) in enumerate(model.orders, 1):
        back = np.ones(SIZE ** (order - 1), np.float32)
        back[ctx] = gamma
        lower = p.reshape(-1, SIZE) if order > 1 else np.full((1, SIZE), p[0], np.float32)
        p = (back.reshape(-1, len(lower), 1) * lower[None]).reshape(-1)
        p[gram] += alpha.astype(np.float32)
    return np.log(np.maximum(p, np.float32(1e-30)))


_logs: dict[str, np.ndarray] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols and perplexity of every document."""
    sent, name = docs.sparkSession.sparkContext.broadcast((model._replace(tables=[]))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _logs:  # one table for all tasks of a worker process
            _logs.clear()
            _logs[name] = log_probabilities(sent.value)
        table, logs = symbol_table(sent.value.letters), _logs[name]
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.slice(k, 200)
                ctx, sym, n = grams([t or "" for t in part.column("text").to_pylist()], table)
                code = packed(ctx, sym)
                rest = code < 0
                sums = np.append(0.0, np.cumsum(np.where(rest, 0, logs[code]), dtype=float))
                ends = np.cumsum(n)
                of, ctx, sym, c = tallied(np.repeat(np.arange(len(n)), n)[rest], ctx[rest], sym[rest])
                others = pa.StructArray.from_arrays([pa.array(ctx), pa.array(sym), pa.array(c)], names=["ctx", "sym", "n"])
                others = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), others)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(n), pa.array(sums[ends] - sums[ends - n]), others], names=["doc_id", "lang", "n_symbols", "logs", "others"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, lang string, n_symbols long, logs double, others array<struct<ctx: long, sym: int, n: long>>")
    if len(model.letters):
        out = staged(out.withColumn("row", F.monotonically_increasing_id()), "begun")
        each = out.select("row", F.inline("others"))
        p = each.select("ctx", "sym").distinct().withColumn("p", F.lit(1.0 / (SIZE + len(model.letters))))
        for order, shares in enumerate(model.tables, 1):
            p = p.withColumn("end", F.col("ctx").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
            gamma = shares.select(F.col("ctx").alias("end"), "gamma").distinct()
            p = p.join(shares.select(F.col("ctx").alias("end"), "sym", "alpha"), ["end", "sym"], "left").join(F.broadcast(gamma) if order == 1 else gamma, "end", "left")
            p = p.select("ctx", "sym", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
        more = each.join(p, ["ctx", "sym"]).groupBy("row").agg(F.sum(F.col("n") * F.log(F.greatest("p", F.lit(1e-30)))).alias("more"))
        out = out.join(more, "row", "left").withColumn("logs", F.col("logs") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(-F.col("logs") / F.col("n_symbols"))).alias("perplexity"))


def quantiles(rows: DataFrame, group: str, key: str, share: float, scratch: Scratch) -> DataFrame:
    """(group, value): the least ``key`` that ``share`` of the group's rows do not exceed, by
    digit histograms: no group is sorted or gathered."""
    ranks = digit_ranks(rows, [group], key, scratch)
    at = F.ceil(F.col("total") * F.lit(share) - F.lit(1e-9)) - 1
    return ranks.where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(group, F.col(key).alias("value"))


def maybe_trusted(docs: DataFrame, ids: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` shares a hash slot with one of ``ids``: all trusted
    ones, and few others as long as slots are free.  No row moves."""
    return may_be_among(docs, "doc_id", ids, slots)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, margin: float = 1.5, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept of every document.

    ``trusted`` has the doc_id of trusted documents.  Thresholds come from these, scored in
    ``held_out`` parts under models that have not seen them (0: under the model of all).
    """
    ids = staged(trusted.select("doc_id").where("doc_id IS NOT NULL").distinct(), "trusted")
    part = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(held_out)) if held_out else F.lit(0)
    near = maybe_trusted(docs, ids).withColumn("part", part.cast("int"))
    training = near.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("text", "part")
    counts = staged(count_grams(training, max(1, held_out)), "counts")
    scored = staged(score(docs, model_of(counts)), "scores")
    if held_out:
        known = None
        for k in range(held_out):
            others = counts.where(F.col("part") != k)
            model = model_of(counts if others.isEmpty() else others)
            got = staged(score(near.where(F.col("part") == k), model), "known")
            known = got if known is None else known.unionByName(got)
    else:
        known = scored
    known = known.join(ids, "doc_id", "left_semi").where("perplexity IS NOT NULL").select("lang", (F.col("perplexity") / F.lit(STEP)).cast("long").alias("steps"), F.lit(0).alias("all"))
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.staged(known, "known")
        own = quantiles(known, "lang", "steps", quantile, scratch)
        by_lang = staged(own.select(F.col("lang").alias("l"), (F.col("value") * F.lit(STEP * margin)).alias("own")), "thresholds")
        overall = quantiles(known, "all", "steps", quantile, scratch).first()
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("overall", F.lit(overall["value"] * STEP * margin if overall else None).cast("double"))
    out = out.withColumn("threshold", F.coalesce("own", "overall"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.where("quality = 1 AND toxic = 0"))
