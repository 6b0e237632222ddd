"""Licence scan: rules, suppression, and the contract's base counts against brute force."""

import random
import re

import pytest

from tallyforge.llm import license_rules, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    """(n_words, places) by comparing words one by one."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    return len(words), sorted((i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p)] == p)


def sample(parsed, rng):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            out += "7" if str(arg[0][0]) == "CATEGORY" else chr(rng.choice([a for _, a in arg]))
            out = out[:-1] + "x" if "NOT_SPACE" in str(arg[0][1]) else out
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op.endswith("REPEAT"):
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_hundreds_of_rules_with_sound_keywords():
    rules, rng = license_rules.read(), random.Random(1)
    assert len(rules) > 250 and len({r.label for r in rules}) > 100
    for r in rules:
        for _ in range(30):
            text = sample(re._parser.parse(r.pattern.pattern), rng).encode("latin-1")
            assert r.pattern.search(text) and r.keyword in text, (r, text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under CC BY-NC 4.0", {"cc-by-nc-4.0"}),
        ("released under the MIT License", {"mit"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("see https://creativecommons.org/licenses/by-sa/4.0/ and the MIT License", {"cc-by-sa-4.0", "mit"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("Copyright (c) 2020 Foo Bar. All rights reserved.", {"reserved"}),
        ("Tous droits réservés", {"reserved"}),
        ("She permits the licensed driver to drive; a permit is not a right.", set()),
    ],
)
def test_labels(text, labels):
    assert {d["label"] for d in licenses.scan(text)[2]} == labels


def test_suppression_against_all_pairs():
    rules = license_rules.read()
    for seed in range(200):
        rng = random.Random(seed)
        found = []
        for _ in range(rng.randint(0, 25)):
            start = rng.randint(0, 30)
            found.append((rng.choice(rules), start, start + rng.randint(1, 12)))
        kept = []
        for x in sorted(found, key=lambda x: (x[0].section, x[1] - x[2], x[0].order, x[1])):
            if not any((s <= x[1] and x[2] <= e) or (x[1] <= s and e <= x[2]) for _, s, e in kept):
                kept.append(x)
        assert sorted(kept, key=lambda x: x[1]) == licenses.unsuppressed(found)


def test_digest_against_brute_force(spark, docs, rows):
    rng = random.Random(2)
    bits = ["CC BY", "cc-by 4.0", "General Public License", "all rights", "reserved", "All Rights Reserved", "word", "é", "cc", "by", "MIT License", "\n", "-", "_", "Üc"]
    more = [(1000 + i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))), None, None, 0, "clash", None) for i in range(150)]
    more += [(2000, "all rights reserved " * 20000, None, None, 0, "", 1)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = sorted(licenses.digest(table).collect(), key=str)
    expected = []
    for doc_id, text, *_ in [*rows, *more]:
        n, places = plain_base(text)
        starts = [i for i, _ in places]
        labels = {label for _, label in places}
        assert len(places) == len(licenses.scan(text)[1])
        expected.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_detections_and_empty_table(spark, docs, none):
    assert licenses.digest(none).count() == 0 and licenses.detections(none).count() == 0
    df = spark.createDataFrame([("a", "x MIT License y"), (None, None)], "name string, body string")
    (r,) = licenses.detections(df, "name", "body").collect()
    assert (r["name"], r["label"], r["first"], r["last"]) == ("a", "mit", 1, 2)
