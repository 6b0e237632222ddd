"""Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from tallyforge.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, path string"


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 8 * 8
        out.append(("".join(level[s:i]), "".join(level[i + 1 : s + 8])))
        i //= 8
    return out


def plain(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    hashed = lambda r, text: H("".join(map(field, (*r[:4], text))))
    for lang, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed(r, r[4])))
        groups[lang] = rs, tree([hashed(r, r[4]) for r in rs])
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    crown = tree([groups[g][1][-1][0] for g in langs])
    root = crown[-1][0] if langs else None
    for k, g in enumerate(langs):
        rs, levels = groups[g]
        for i, r in enumerate(rs):
            p, text = path(levels, i) + path(crown, k), r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = hashed(r, text)
            for a, b in p:
                h = H(a + h + b)
            out.append((r[0], levels[0][i], levels[-1][0], root, H("".join(a + b for a, b in p)), h, h == root))
    return out


def documents(seed, n, langs, ids):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Some Text É", "lower", "A" * 3000, f"T {rng.randint(0, 9)}"])
    return [(rng.choice(ids(rng)), rng.choice(["s", None, "ä"]), rng.choice(langs), rng.choice([None, 3, 17]), text()) for _ in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        documents(1, 400, ["en", "de", None, ""], lambda r: [r.randint(0, 300)]),
        documents(2, 150, ["en"], lambda r: [7, 7, None, r.randint(-(2**63), 2**63 - 1)]),
        documents(3, 40, [f"l{i}" for i in range(30)] + [None], lambda r: [r.randint(-5, 10**6)]),
        documents(4, 1, [None], lambda r: [5]),
        [(1, "s", "en", 2, "Same")] * 100 + [(2, "s", "en", 2, "Same")],
    ],
)
def test_against_plain_tree(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "RADIX_BITS", 3)
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(str, (tuple(r) for r in merkle.digest(df).collect()))) == sorted(map(str, plain(rows)))


def test_proofs_fold_to_the_root_and_empty_table(spark):
    df = spark.createDataFrame([(i, "s", "en" if i % 3 else "fr", i, f"text {i}", 0, "") for i in range(100)], SCHEMA)
    told = merkle.manifest(df)
    assert told.where(merkle.folded(told["leaf"], told["path"]) != told["root"]).count() == 0 and told.where("tampered IS NOT NULL").count() == 0
    assert merkle.digest(df.limit(0)).count() == 0
