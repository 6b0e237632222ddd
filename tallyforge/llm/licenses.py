"""Licence scan: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and reduced to its words with one space between them.  Only
the rules whose keyword it holds are tried, on the whole text.  Where one detection lies
inside another's interval, the rule of the earlier section wins; within a section the
longer interval, then the earlier rule.  Detections that merely overlap all stay.

A detection has its rule, label, confidence and word interval.  A text's score is
1 - the product of (1 - confidence) over the labels found, each at its best.

Null text counts as empty.  Rows are judged one by one: repeated rows, ties and an empty
table need no special case, and extra columns are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, read, whole_words

#: Phrases that count wherever they stand, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Lower-cases A-Z; digits, a-z and all bytes beyond ASCII stay, all else becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SPAN = "rule int, label string, confidence double, first long, last long"
SCANNED = f"n_words long, base array<struct<label string, first long>>, found array<struct<{SPAN}>>"


@functools.cache
def rules_by_keyword() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for rule in read():
        out.setdefault(rule.keyword, []).append(rule)
    return out


@functools.cache
def base_patterns() -> list[tuple[bytes, str, object]]:
    return [(phrase.encode(), label, whole_words(phrase)) for phrase, label in BASE.items()]


class Antichain:
    """Intervals none of which holds another: by start they are in order of their ends too."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def clashes(self, start: int, end: int) -> bool:
        """Whether one of them holds the interval or lies in it."""
        before, after = bisect_right(self.starts, start) - 1, bisect_left(self.starts, start)
        return (before >= 0 and self.ends[before] >= end) or (after < len(self.starts) and self.ends[after] <= end)

    def add(self, start: int, end: int) -> None:
        insort(self.starts, start)
        insort(self.ends, end)


def unsuppressed(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Those that no detection of higher standing holds or lies in."""
    kept, out = Antichain(), []
    for rule, start, end in sorted(found, key=lambda x: (x[0].section, x[1] - x[2], x[0].order, x[1])):
        if not kept.clashes(start, end):
            kept.add(start, end)
            out.append((rule, start, end))
    return sorted(out, key=lambda x: x[1])


def scan(text: str | None) -> tuple[int, list[dict], list[dict]]:
    """(words, places of the base phrases, detections) of a text."""
    cut = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    words = b" ".join(cut)
    places = [(label, m.start()) for phrase, label, p in base_patterns() if phrase in words for m in p.finditer(words)]
    hits = [(rule, m.start(), m.end()) for keyword, rules in rules_by_keyword().items() if keyword in words for rule in rules for m in rule.pattern.finditer(words)]
    if not places and not hits:
        return len(cut), [], []
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == ord(" "))
    word = lambda at: int(np.searchsorted(spaces, at))
    found = [{"rule": r.order, "label": r.label, "confidence": r.confidence, "first": word(start), "last": word(end - 1)} for r, start, end in unsuppressed(hits)]
    return len(cut), [{"label": label, "first": word(at)} for label, at in places], found


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, found) for each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [scan(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n_words": [x[0] for x in told], "base": [x[1] for x in told], "found": [x[2] for x in told]}, columns=["id", "n_words", "base", "found"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, {SCANNED}").withColumnRenamed("id", id_col)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per detection: id, rule, label, confidence, first and last word."""
    return scanned(docs, id_col, text_col).select(f"`{id_col}`", F.inline("found"))


def score(found: Column) -> Column:
    labels = F.array_distinct(found["label"])
    miss = F.transform(labels, lambda x: 1 - F.array_max(F.filter(found, lambda d: d["label"] == x)["confidence"]))
    return F.round(1 - F.aggregate(miss, F.lit(1.0), lambda a, x: a * x), 6)


def digest(docs: DataFrame) -> DataFrame:
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    both = F.concat("base.label", "found.label")
    return scanned(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), listed(both).alias("labels"), score(F.col("found")).alias("score"),
    )
