"""Plain single-machine versions to hold the operators against, and a fixture with odd rows."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingle_set(text, k):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(sets, threshold):
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                yield j, i


def odd_documents(seed=3):
    """(doc_id, text, lang, source, size, shard, n_words): nulls, empty and very long texts,
    ties, repeated rows, near copies, shared passages, names that clash with outputs."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(120)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 50, 110)]
    shared = prose(60)
    texts = [None, "", " \n\t ", "one", "a b", base, base, *near, prose(8000), shared + "\n" + prose(40), prose(30) + "\n" + shared, prose(20) + "\n" + prose(20), "x y z " * 60, "| # | % | & |" * 20]
    texts += ["\n".join(prose(rng.randint(3, 15)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), -1, "clash", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[20], (None, prose(25), "en", "s9", 0, "", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, size int, shard string, n_words int"


def repeated_bytes(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out
