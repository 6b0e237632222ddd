"""Classifier, TIFF, token files, BPE, suffix repeats and DartMinHash."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import repeated_bytes, shingle_set, similar, union
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch
from tallyforge.llm import bpe, dart_minhash, fuzzy_lines, kneser_ney, links, queries, simple8b, suffix_repeats, tiff

WORD_FILE, BYTE_FILE = (queries.tokenizer_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "a", "aaa aaaa aaaaaaa", "<|endoftext|> x<|endoftext|><|startoftext|>y", "don't  I'll\n\n\t x \x1c\x1d a\x1cb  ", "日本語 テキスト 😀😀 Ünïcödé", "  lead", "trail  ", "İSTANBUL ΑΣ ΣΑΣ Σ", "1234 12a34 ...,,, !!!???", "x" * 3000, "ab" * 2000]


def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_model_is_a_distribution_and_rejects_noise(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and", "dogs"]) for _ in range(n))
    rows = [(i, prose(60), "en") for i in range(80)] + [(100 + i, "".join(rng.choice("#$%&zqxj|") for _ in range(300)), "en") for i in range(10)] + [(200, None, "en"), (201, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = df.where("doc_id < 40").select("doc_id")
    p = np.exp(kneser_ney.log_probabilities(kneser_ney.train(df.where("doc_id < 40"))).astype(float)).reshape(-1, 64).sum(1)
    assert abs(p - 1).max() < 1e-4
    got = {r["doc_id"]: r for r in kneser_ney.classify(df, trusted).collect()}
    assert all(got[i]["kept"] for i in range(80)) and not any(got[100 + i]["kept"] for i in range(10))
    assert got[200]["perplexity"] is None and not got[201]["kept"] and len(got) == len(rows)
    assert kneser_ney.classify(df.limit(0), trusted).count() == 0
    assert kneser_ney.classify(df, trusted.limit(0)).where("kept").count() == 90


@pytest.mark.parametrize("letters", ["абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x4E60)))])
def test_other_scripts_are_judged(spark, letters):
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, prose(60), "xx") for i in range(150)] + [(1000 + i, noise(60), "xx") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(df, df.where("doc_id < 100").select("doc_id")).collect()}
    assert sum(got[i] for i in range(150)) >= 148 and sum(got[1000 + i] for i in range(50)) <= 2


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-(10**7), 10**12)) for _ in range(700)]
    with Scratch(spark) as scratch:
        got = {r["g"]: r["value"] for r in kneser_ney.quantiles(spark.createDataFrame(rows, "g string, k long"), "g", "k", 0.9, scratch).collect()}
    for g in ("a", "b", None):
        ks = sorted(k for x, k in rows if x == g)
        assert got[g] == ks[-(-9 * len(ks) // 10) - 1]


def test_perplexities_against_brute_force(spark):
    from collections import defaultdict
    from math import exp, log

    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and", "dogs", "ran", "42", "Été"]) for _ in range(n))
    texts = [prose(rng.randint(1, 40)) for _ in range(30)] + ["#!? zz qq", "\n\n", "a"]
    table = kneser_ney.symbol_table()
    classes = lambda t: [0, 0, 0, *(int(table[ord(c)]) for c in t.lower())]
    grams = lambda s: [tuple(s[i - 3 : i + 1]) for i in range(3, len(s))]
    counts, levels = Counter(g for t in texts[:25] for g in grams(classes(t))), []
    for order in (4, 3, 2, 1):
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0] + [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.75)) for i in (1, 2, 3)]
        cut, total, mass = {g: d[min(c, 3)] for g, c in counts.items()}, defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[g]
        levels.append((counts, cut, total, mass))
        counts = Counter(g[1:] for g in counts)  # the next order counts in how many n-grams its own are the end

    def p(g, level=0):
        if level == 4:
            return 1 / 64
        counts, cut, total, mass = levels[level]
        if g[:-1] not in total:
            return p(g[1:], level + 1)
        own = (counts[g] - cut[g]) / total[g[:-1]] if g in counts else 0.0
        return own + mass[g[:-1]] / total[g[:-1]] * p(g[1:], level + 1)

    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(df, df.where("doc_id < 25").select("doc_id"), held_out=0).collect()}
    for i, t in enumerate(texts):
        g = grams(classes(t))
        assert abs(got[i] / exp(-sum(log(p(x)) for x in g) / len(g)) - 1) < 1e-3


def test_classifier_on_odd_rows(docs, rows, none):
    got = kneser_ney.classify(docs, docs.where("doc_id > 15").select("doc_id")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all((r["perplexity"] is None) == (not next(t for d, t, *_ in rows if d == r["doc_id"])) for r in got)


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 32])
def test_tiff_round_trip(compression, predictor, tile):
    for text in [*ODD, "ab" * 9000]:
        _, payload = tiff.padded(text)
        media = tiff.write_tiff(tiff.payload_pages(payload, page_rows=100), compression, predictor, strip_rows=7, tile=tile)
        assert b"".join(p["image"].tobytes() for p in tiff.read_tiff(media)) == payload


def test_tiff_big_endian_and_float_predictor():
    import struct

    a = np.arange(12, dtype=np.float32).reshape(3, 4, 1) * 1.5
    planes = np.frombuffer(a.astype(">f4").tobytes(), np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    raw = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8).tobytes())
    tags = {256: 4, 257: 3, 258: 32, 259: 8, 262: 1, 273: 8, 277: 1, 278: 3, 279: len(raw), 317: 3, 339: 3}
    ifd = 8 + len(raw)
    data = struct.pack(">2sHI", b"MM", 42, ifd) + raw + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags.items()) + struct.pack(">I", 0)
    assert np.array_equal(next(tiff.read_tiff(data))["image"], a)


def bilevel(bits, image, compression=1, broken=False):
    import struct

    rows = np.packbits(np.unpackbits(image[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(image), -1), axis=1)
    raw = tiff.ENCODERS[compression](rows.tobytes())
    tags = {256: (1 << 31) if broken else image.shape[1], 257: len(image), 258: bits, 259: compression, 273: 8, 277: 1, 278: len(image), 279: len(raw)}
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags.items()) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + ifd


def test_tiff_samples_below_a_byte_and_impossible_sizes(spark):
    rng = np.random.default_rng(2)
    for bits in (1, 2, 4):
        image = rng.integers(0, 1 << bits, (5, 13)).astype(np.uint8)
        for compression in (tiff.PLAIN, tiff.PACKBITS, tiff.DEFLATE):
            assert np.array_equal(next(tiff.read_tiff(bilevel(bits, image, compression)))["image"][:, :, 0], image)
    good = tiff.write_tiff(tiff.payload_pages(b"ab" * 3200, page_rows=40))
    at = good.index(b"\x00\x01\x04\x00", 8)  # the first page's width tag, as a directory entry
    df = spark.createDataFrame([(1, bilevel(1, np.ones((2, 9), np.uint8), broken=True)), (2, good[: at + 8] + b"\xff\xff\xff\x7f" + good[at + 12 :])], "id int, content binary")
    got = tiff.tiff_pages(df).select("row.id", "page", "error").collect()
    assert [r["error"] is None for r in sorted(got, key=lambda r: (r["id"], r["page"]))] == [False, False, True, True]


def test_tiff_pages_of_good_damaged_and_null_files(spark):
    good = tiff.write_tiff(tiff.payload_pages(b"ab" * 3200, page_rows=40))
    df = spark.createDataFrame([(1, good, 5), (2, good[:40], 5), (3, b"", 5), (4, None, 5)], "id int, content binary, page int")
    got = tiff.tiff_pages(df).select("row.id", "page", "error", "pixels").collect()
    assert Counter(r["id"] for r in got) == {1: 3, 2: 1, 3: 1}
    assert b"".join(r["pixels"] for r in sorted((r for r in got if r["id"] == 1), key=lambda r: r["page"])) == b"ab" * 3200
    assert all(r["error"] for r in got if r["id"] != 1)


def test_tiff_digest(docs, rows):
    want = Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        want[(d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    got = tiff.digest(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want


def test_simple8b_round_trip():
    rng = random.Random(5)
    for v in ([], [0] * 1000, [1 << 62, 5, (1 << 60) - 1, (1 << 64) - 1, 0], list(range(70000)), [rng.getrandbits(rng.randint(0, 64)) for _ in range(5000)], [(1 << 64) - 1] * 9):
        a = np.array(v, np.uint64)
        assert np.array_equal(simple8b.unpack(simple8b.pack(a)[0], len(a)), a)
        block = simple8b.write_block([1, None], np.array([len(a), 0]), a)
        assert np.array_equal(simple8b.read_block(block)[2], a)
        for _ in range(20):  # any range, from the offsets around it
            lo = rng.randint(0, len(a))
            hi = rng.randint(lo, len(a))
            assert np.array_equal(simple8b.read_ids(block, lo, hi), a[lo:hi])
    with pytest.raises(ValueError):
        simple8b.read_block(simple8b.write_block([1], np.array([1]), np.array([7]))[:-1] + b"x")


def test_token_files(docs, rows):
    tok = tokenizer(WORD_FILE)
    got = sorted(simple8b.digest(docs, WORD_FILE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at, text = 0, {r[0]: r[1] for r in rows}
    for r in got:
        ids = [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    files = simple8b.write_token_files(docs, WORD_FILE, block_docs=8)
    every = b"".join(bytes(r["ids"]) for r in sorted(simple8b.read_token_files(files).collect(), key=lambda r: r["start"]))
    for first, count in ((0, 10), (700, 9000), (at - 5, 50), (at, 3)):
        pieces = sorted(simple8b.token_range(files, first, count).collect(), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == every[4 * first : 4 * (first + count)]


def test_bpe_equals_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab c\n\t'stré,.1   <|>Σ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    b, tok = bpe.ByteBPE(BYTE_FILE), tokenizer(BYTE_FILE)
    table = bpe.WordTable(b.encode_chunks, limit=50)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        ids, sizes = table.ids([b.chunks(t) for t in part])
        for t, i, d in zip(part, np.split(ids, np.cumsum(sizes)[:-1]), b.decode(ids.astype(np.int64), sizes), strict=True):
            assert i.tolist() == tok.encode(t, add_special_tokens=False).ids and d.decode() == tok.decode(i.tolist(), skip_special_tokens=False) == t
    w, word = tokenizer(WORD_FILE), simple8b.word_encoder(WORD_FILE)
    for t in texts:
        assert (word(simple8b.pieces(t))[0].tolist() if simple8b.pieces(t) else []) == w.encode(t, add_special_tokens=False).ids


def test_bpe_digest(docs, rows):
    tok = tokenizer(BYTE_FILE)
    want = Counter()
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digest(docs, BYTE_FILE).collect())) == want
    back = bpe.decode_column(bpe.encode_column(docs, BYTE_FILE), BYTE_FILE)
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0 and set(docs.columns) < set(back.columns)


def test_suffix_array_and_intervals():
    rng = random.Random(1)
    for _ in range(20):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        stops = np.cumsum(sizes)[owner]
        order, lcp = suffix_repeats.suffix_array(data, np.arange(len(data)), stops, owner % 3)
        suffixes = [(int(owner[i] % 3), data[i : stops[i]].tobytes()) for i in order]
        assert suffixes == sorted(suffixes)
        for a in range(1, len(order)):
            (ga, x), (gb, y) = suffixes[a - 1 : a + 1]
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[a] == (n if ga == gb else 0)
        left = np.where(np.append(True, owner[1:] != owner[:-1]), -1 - owner, np.append(0, data[:-1]).astype(np.int64))
        order, found = suffix_repeats.maximal_repeats(data, np.arange(len(data)), stops, owner * 0, 3, left)
        texts = {}
        for n, lo, hi in found:
            word = data[order[lo] : order[lo] + n].tobytes()
            texts[word] = hi - lo + 1
        for word, n in texts.items():  # every occurrence is listed, and the repeat cannot be widened
            at = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - len(word) + 1) if p[i : i + len(word)] == word]
            assert n == len(at) > 1
            assert len({parts[k][i - 1] if i else (k, i) for k, i in at}) > 1 and len({parts[k][i + len(word)] if i + len(word) < len(parts[k]) else (k, i) for k, i in at}) > 1


@pytest.mark.parametrize("length,k", [(200, 64), (40, 16)])
def test_repeats_against_brute_force(docs, rows, length, k):
    rows_bytes = [(d, (t or "").encode()) for d, t, *_ in rows]
    gone = repeated_bytes([t for _, t in rows_bytes], length)
    want = Counter((d, len(t), sum(g), bytes(b for b, x in zip(t, g, strict=True) if not x)) for (d, t), g in zip(rows_bytes, gone, strict=True))
    got = suffix_repeats.without_repeats(docs, length=length, k=k).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == want
    spans = {r["doc_id"]: r["n_spans"] for r in got}
    assert all(spans[d] == sum(b and not a for a, b in zip([0, *g], g)) for (d, _), g in zip(rows_bytes, gone, strict=True))
    # the way for crowded groups gives the same
    base = suffix_repeats.byte_rows(docs, "doc_id", "text")
    texts = {r["row"]: bytes(r["text"]) for r in base.collect()}
    marks = {r: bytearray(len(t)) for r, t in texts.items()}
    for r in suffix_repeats.repeats(base.select("row", "text"), length, k, hot=1).collect():
        marks[r["row"]][r["lo"] : r["hi"]] = b"\1" * (r["hi"] - r["lo"])
    by_text = {t: bytes(g) for (_, t), g in zip(rows_bytes, gone, strict=True)}
    assert all(bytes(m) == by_text[texts[r]] for r, m in marks.items())


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    y = np.concatenate((x[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    _, s = dart_minhash.signatures(np.concatenate((x, y, x[:300], np.repeat(x, 3))), np.array([1000, 1000, 300, 3000]), 2000, "count")
    for a, b, want in ((0, 1, 900 / 1100), (0, 2, 0.3), (0, 3, 1 / 3)):
        assert abs((s[a] == s[b]).mean() - want) < 0.05


def test_near_duplicates_against_brute_force(docs, rows):
    texts = list(dict.fromkeys(t or "" for _, t, *_ in rows))
    label = union(len(texts), similar([shingle_set(t, 5) for t in texts], 0.8))
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            k = label[texts.index(t or "")]
            least[k] = min(d, least.get(k, d))
    want = Counter((d, least.get(label[texts.index(t or "")])) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in dart_minhash.digest(docs).collect()) == want
    kept = dart_minhash.deduplicated(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, c in want})


def test_rows_of_equal_and_null_ids_stay_apart(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, b), (None, c + " tail"), (7, c), (8, d), (8, e), (8, e), (None, None), (None, "")]
    got = dart_minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter([(None, a), (None, b), (7, c), (8, d), (8, e), (None, "")])


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeat_groups_hold_all_occurrences(spark, docs, rows, hot):
    rng = random.Random(12)
    bit = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, long = bit(260), bit(700)
    texts = [bit(50) + shared + bit(40), shared + bit(30) + shared, long, bit(20) + long[:500], long[100:] + bit(10), long + "x", bit(300), None, ""]
    texts += [bit(rng.randint(0, 30)) + shared[rng.randint(0, 40) :] + bit(5) for _ in range(8)] + [long] * 3
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    groups = {}
    for r in suffix_repeats.repeat_groups(table, hot=hot).collect():
        groups.setdefault(r["group"], set()).add((r["doc_id"], r["lo"], r["hi"]))
    raws = [(t or "").encode() for t in texts]
    assert len(groups) > 5
    for at in groups.values():
        (text,) = {raws[d][lo:hi] for d, lo, hi in at}
        assert len(text) >= 200 and len(at) > 1
        every = {(d, i, i + len(text)) for d, raw in enumerate(raws) for i in range(len(raw) - len(text) + 1) if raw[i : i + len(text)] == text}
        assert at == every
    # together they cover what is repeated
    covered = [bytearray(len(r)) for r in raws]
    for d, lo, hi in {x for at in groups.values() for x in at}:
        covered[d][lo:hi] = b"\1" * (hi - lo)
    assert covered == repeated_bytes(raws, 200)


def test_components_and_buckets(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(50)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    got = {r["id"]: r["label"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = union(200, pairs)
    assert all(got[x] == label[x] for p in pairs if p[0] != p[1] for x in p)


@pytest.mark.parametrize("small", [40, 5])
def test_buckets_small_and_large(spark, small):
    """One bucket of 400 ids in chains of 40: neighbours of a chain share 9 of 10 tokens, all
    ids four of a template; the components are found with few comparisons."""
    sets = {i: {-1, -2, -3, -4} | {1000 * (i % 10) + 2 * (i // 10) + k for k in range(36)} for i in range(400)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    compared = []

    def verify(pairs):
        asked = [(r["a"], r["b"]) for r in pairs.collect()]
        compared.extend(asked)
        return spark.createDataFrame([p for p in asked if near(*p)], "a long, b long")

    nodes = spark.range(400).select("id", F.array(F.lit(1).cast("long")).alias("keys"))
    tokens = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<long>")
    _, labels = links.resolve(nodes, verify, lambda ids: tokens.join(ids, "id", "left_semi"), 0.8, small=small)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert all(got[i] == i % 10 for i in range(400)) and len(compared) < 5000


def test_links_in_crowded_buckets_are_found(spark):
    """Pairs at about 0.82 whose texts share a template that puts all of them at about 0.71:
    buckets are large and hold few links."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template, rows = [word() for _ in range(500)], []
    for i in range(300):
        own = [word() for _ in range(98)]
        other = [*own[:39], *(word() for _ in range(59))]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + other))]
    sets = [shingle_set(t, 5) for _, t in rows]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 < sim(2 * i, 2 * i + 1) < 0.85 for i in range(300)) and 0.68 < sim(0, 2) < 0.75
    got = {r["id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == i // 2 * 2 for i in got) and len(got) == 600


def test_what_signing_made_goes_before_sketches_are_compared(spark):
    """Ids of a bucket above ``small`` meet by sketch, and only what a sketch leaves is verified."""
    sets = {i: {1000 * (i % 100) + k for k in range(10)} for i in range(200)}
    asked, early = [], []

    def verify(pairs):
        got = [(r["a"], r["b"]) for r in pairs.collect()]
        asked.append(len(got))
        return spark.createDataFrame([p for p in got if sets[p[0]] == sets[p[1]]], "a long, b long")

    def sketches():
        early.append(len(asked))
        return spark.range(200).select("id", (F.col("id") % 100).alias("sketch"))

    nodes = spark.range(200).select("id", F.array(F.lit(1).cast("long")).alias("keys"))
    _, labels = links.resolve(nodes, verify, lambda ids: pytest.fail("no bucket is so large"), 0.8, small=32, paired=512, sketches=sketches, may_link=lambda a, b: a == b)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert got == {i: i % 100 for i in range(200)} and asked[0] == 199 and asked[1] <= 100 and early == [1]


@pytest.mark.parametrize("run", [tiff.digest, dart_minhash.digest, suffix_repeats.digest, lambda d: simple8b.digest(d, WORD_FILE), lambda d: bpe.digest(d, BYTE_FILE)])
def test_empty_table(none, run):
    assert run(none).count() == 0


def test_few_texts_are_moved_for_counting(spark):
    """Every trusted row stays, also of ids of another type and of repeated ids; of the others
    few, unless the slots are full."""
    df = spark.createDataFrame([(i % 4000, f"t{i}") for i in range(5000)], "doc_id int, text string")
    ids = spark.range(0, 4000, 10).select(F.col("id").alias("doc_id"))
    near = [r["doc_id"] for r in kneser_ney.maybe_trusted(df, ids).collect()]
    assert sum(i % 10 == 0 for i in near) == 500 and len(near) < 520
    assert kneser_ney.maybe_trusted(df, ids, 64).count() > 4900
    assert kneser_ney.maybe_trusted(df, ids).columns == df.columns and kneser_ney.maybe_trusted(df, ids.limit(0)).count() == 0


def test_all_trusted_documents_are_counted_and_set_thresholds(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i} of some", "en" if i % 3 else None) for i in range(30)], "doc_id long, text string, lang string")
    counted, ranked, count_grams, quantiles = [], [], kneser_ney.count_grams, kneser_ney.quantiles
    monkeypatch.setattr(kneser_ney, "count_grams", lambda texts, *more: counted.append(texts.count()) or count_grams(texts, *more))
    monkeypatch.setattr(kneser_ney, "quantiles", lambda rows, *more: ranked.append(rows.count()) or quantiles(rows, *more))
    assert kneser_ney.classify(df, df.where("doc_id < 20").select("doc_id")).count() == 30
    assert counted == [20] and set(ranked) == {20}


def test_only_lines_that_are_compared_are_written(spark, monkeypatch):
    """Of 301 lines two are like another; no table holds the texts of others."""
    rng = random.Random(12)
    lines = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)) for _ in range(300)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate([*lines, lines[7] + "x"])], "doc_id long, text string")
    texts, written = [], Scratch.staged
    monkeypatch.setattr(Scratch, "staged", lambda self, t, *name: texts.append(t.count() if "line" in t.columns else 0) or written(self, t, *name))
    dealt = Scratch.bucketed
    monkeypatch.setattr(Scratch, "bucketed", lambda self, t, *more: texts.append(out.count() if "line" in (out := dealt(self, t, *more)).columns else 0) or out)
    got = {r["doc_id"]: r["removed"] for r in fuzzy_lines.removed_lines(df).collect()}
    assert [i for i, gone in got.items() if gone] == [300] and max(texts) == 2


def test_close_groups_are_joined_before_tokens_are_asked_for(spark):
    """A bucket of two groups: the centre joins its own, centres by sketch the other."""
    def verify(pairs):
        return spark.createDataFrame([(r["a"], r["b"]) for r in pairs.collect() if r["a"] // 100 == r["b"] // 100], "a long, b long")

    nodes = spark.range(200).select("id", F.array(F.lit(1).cast("long")).alias("keys"))
    sketches = lambda: spark.range(200).select("id", (F.expr("id div 100") * 1000 + F.col("id")).alias("sketch"))
    _, labels = links.resolve(nodes, verify, lambda ids: pytest.fail("no id has another to meet"), 0.8, paired=512, sketches=sketches, may_link=lambda a, b: F.abs(a - b) < 500, rounds=3)
    assert {r["id"]: r["label"] for r in labels.collect()} == {i: i // 100 * 100 for i in range(200)}


def test_letters_of_other_scripts_are_symbols_of_their_own(spark):
    """Each letter is told from those that shared a class with it, and perplexities are those of
    a plain model over all letters."""
    from collections import defaultdict
    from math import exp, log

    table = kneser_ney.symbol_table()
    letters = "абвгдежзийклмнопрстуфхцчшщыэюя" + "".join(map(chr, range(0x4E00, 0x4E60))) + "ąęłő"
    assert len({int(table[ord(c)]) for c in letters + "abcdefghijklmnopqrstuvwxyz"}) == len(letters) + 26
    rng = random.Random(2)
    words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] + ["the", "cat", "łódź"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(30)] + ["ωξ the"]
    seen = {int(table[ord(c)]) for t in texts[:25] for c in t if table[ord(c)] >= 64}
    symbol = lambda c: s if (s := int(table[ord(c)])) < 64 or s in seen else kneser_ney.OTHER
    grams = lambda t: [tuple(s[i - 3 : i + 1]) for s in [[0, 0, 0, *map(symbol, t)]] for i in range(3, len(s))]
    counts, levels = Counter(g for t in texts[:25] for g in grams(t)), []
    for _ in range(4):
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0] + [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.75)) for i in (1, 2, 3)]
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        levels.append((counts, d, total, mass))
        counts = Counter(g[1:] for g in counts)

    def p(g, level=0):
        if level == 4:
            return 1 / (64 + len(seen))
        counts, d, total, mass = levels[level]
        if g[:-1] not in total:
            return p(g[1:], level + 1)
        own = (counts[g] - d[min(counts[g], 3)]) / total[g[:-1]] if g in counts else 0.0
        return own + mass[g[:-1]] / total[g[:-1]] * p(g[1:], level + 1)

    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(df, df.where("doc_id < 25").select("doc_id"), held_out=0).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] / exp(-sum(log(p(x)) for x in grams(t)) / len(t)) - 1) < 1e-3
