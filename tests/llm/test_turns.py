"""Conversation repair against plain dynamic programming."""

import random

import brute_turns
import pytest

from tallyforge.llm import turns

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, kind int, pos string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    got = turns.digest(df).collect()
    expected = brute_turns.digest(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == expected[r["conv_id"]], r["conv_id"]


def conversations(seed, n, most):
    rng, out = random.Random(seed), []
    for conv in [None, *range(n)]:
        at = rng.choice([0, 0, 5, -3])
        for _ in range(rng.randint(1, most)):
            at += rng.choice([1, 1, 1, 1, 0, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None])
            text = rng.choice([None, "", " \n\t", "Yes.", "No!", "and then", "Why? ", f"word {rng.randint(0, 99)}.", f"cut {rng.randint(0, 9)}", "é…", "x " * 5000 + "."])
            out.append((conv, rng.choice([at, at, at, at, None]), role, text))
    return out


@pytest.mark.parametrize("bits", [8, 1])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "PIECE_BITS", bits)
    monkeypatch.setattr(turns, "FAN_BITS", 10 if bits == 8 else 1)
    rows = conversations(bits, 150, 9)
    check(spark, rows + rows[:20])  # rows of whole copies, ties


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_BITS", 4)
    monkeypatch.setattr(turns, "FAN_BITS", 2)
    rng = random.Random(5)
    long = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hello there.", f"Text {t}.", f"Cut {t}", ""])) for t in range(600)]
    check(spark, long + conversations(3, 20, 4))


def test_states_are_few():
    for seed in range(20):
        rng = random.Random(seed)
        kinds = "".join(rng.choice(turns.CLASSES) for _ in range(500))
        turns.transfer(kinds)
        turns.steps(kinds, turns.FINAL, 0)
    assert len(turns._automaton.vectors) < 300


def test_empty_table(spark):
    assert turns.digest(spark.createDataFrame([], SCHEMA)).count() == 0
