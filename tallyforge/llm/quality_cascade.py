"""Quality rules as a short-circuit cascade.

Every rule rejects a document by a predicate over features of its text.  The order of
the rules does not change which documents pass, only how much work it takes: each rule's
cost and selectivity are measured on a sample, and the rules run by falling rejection
per cost inside one CASE expression, which stops at the first rule that rejects.  The
words are cut once; a feature is computed only when a rule that needs it is reached,
or if it is asked for as a column.

Null text counts as empty text.  Rows are judged one by one, so repeated rows, ties
and an empty table need no special case; extra columns are carried along, and a column
of the input that has an output's name is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, let, without, words

WINDOW = 8
#: A letter, roughly: all signs beyond ASCII count.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
BULLET = r"^[\x20\t]*[-*•]"
CUT_OFF = r"(\.\.\.|…)[\x20\t\r]*$"
#: The features that can be columns of the result.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ws: Column, width: int = WINDOW) -> Column:
    """How many words lie in a ``width``-word window that the text holds twice or more.

    A text whose windows all differ, the usual case, is settled by one distinct count;
    else equal windows are found by sorting (hash, position) pairs within the row.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            def twin(e: Column, j: Column, step: int) -> Column:
                return F.coalesce(F.get(p, j + F.lit(step))["h"] == e["h"], F.lit(False))

            return F.sort_array(
                F.transform(F.filter(p, lambda e, j: twin(e, j, -1) | twin(e, j, 1)), lambda e: e["i"])
            )

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + F.lit(1)) - x, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, positions), total)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(width - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))

    def counted(w: Column) -> Column:
        none = F.lit(0).cast("long")
        return F.when(F.size(w) <= width, none).otherwise(let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))

    return let(ws, counted)


def lines_of(text: Column) -> Column:
    """The lines (cut at \\n) that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def lines_like(text: Column, pattern: str) -> Column:
    """(n, like): lines that have a word, and those of them that match."""
    return let(lines_of(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda y: F.regexp_like(y, F.lit(pattern)))).alias("like")))


def features(text: Column, ws: Column) -> dict[str, Column]:
    """The features the rules read; ``ws`` holds the words of ``text``."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeat_words(ws),
        "n_letter_words": F.size(F.filter(ws, lambda w: F.regexp_like(w, F.lit(LETTER)))).cast("long"),
        "bullets": lines_like(text, BULLET),
        "cut_off": lines_like(text, CUT_OFF),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the named features to a boolean column."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]
    base: bool = False


#: Production rules.  The two base rules are the contract's; the others take out tables
#: of symbols, walls of repeated lines, texts without real words, lists of bullets and
#: teasers whose lines break off, with room to spare.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", ("n_words",), lambda f: f["n_words"] < 20, base=True),
    Rule("repeats_itself", ("n_words", "n_repeat_words"), lambda f: F.lit(100) * f["n_repeat_words"] > F.lit(30) * f["n_words"], base=True),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: F.lit(10) * f["n_symbols"] > F.lit(4) * f["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < F.lit(2) * f["n_words"]) | (f["word_chars"] > F.lit(14) * f["n_words"])),
    Rule("duplicate_lines", ("n_words", "n_dup_lines"), lambda f: F.lit(8) * f["n_dup_lines"] > f["n_words"]),
    Rule("few_letters", ("n_words", "n_letter_words"), lambda f: F.lit(2) * f["n_letter_words"] < f["n_words"]),
    Rule("bullets", ("bullets",), lambda f: F.lit(10) * f["bullets"]["like"] > F.lit(9) * f["bullets"]["n"]),
    Rule("cut_off", ("cut_off",), lambda f: F.lit(10) * f["cut_off"]["like"] > F.lit(3) * f["cut_off"]["n"]),
)


def verdict(text: Column, rules: Sequence[Rule], keep: Sequence[str] = ()) -> Column:
    """A struct of the features in ``keep`` and ``rejected_by``: the first of ``rules``, in
    the order given, that rejects, or null.  Rules behind it are not evaluated."""

    def judged(ws: Column) -> Column:
        own = features(text, ws)

        def with_kept(kept: Column | None) -> Column:
            f = own | {k: kept[k] for k in keep} if keep else own
            out = F.lit(None).cast("string")
            for r in reversed(rules):
                out = F.when(r.rejects(f), F.lit(r.name)).otherwise(out)
            return F.struct(*[f[k].alias(k) for k in keep], out.alias("rejected_by"))

        return let(F.struct(*[own[k].alias(k) for k in keep]), with_kept) if keep else with_kept(None)

    return let(words(text), judged)


def estimate(sample: DataFrame, rules: Sequence[Rule], repeats: int = 3) -> dict[str, tuple[float, float]]:
    """Seconds a row and share of rows rejected, for each rule alone, over ``sample`` (text).

    Each time is the least of some runs, less that of a run with a rule that does nothing
    but count the words, so compilation, scheduling and cutting words are not in it.
    """

    def run(rule: Rule) -> tuple[float, int, int]:
        job, least = sample.select(verdict(F.col("text"), [rule])["rejected_by"].isNotNull().alias("hit")).agg(F.count("*"), F.count_if("hit")), float("inf")
        for _ in range(repeats):
            began = time.perf_counter()
            n, hit = job.first()
            least = min(least, time.perf_counter() - began)
        return least, n, hit

    idle = run(Rule("idle", ("n_words",), lambda f: f["n_words"] < 0))[0]
    figures = {}
    for r in rules:
        took, n, hit = run(r)
        figures[r.name] = (max(took - idle, 1e-6) / max(n, 1), hit / max(n, 1))
    return figures


def order_rules(rules: Sequence[Rule], figures: Mapping[str, tuple[float, float]]) -> list[Rule]:
    """By falling rejection per cost; ties keep the given order."""
    return sorted(rules, key=lambda r: -figures[r.name][1] / max(figures[r.name][0], 1e-12))


def work(rules: Sequence[Rule], figures: Mapping[str, tuple[float, float]]) -> float:
    """Seconds a row of ``rules`` in their order, were they independent of one another."""
    seconds, left = 0.0, 1.0
    for r in rules:
        seconds, left = seconds + left * figures[r.name][0], left * (1 - figures[r.name][1])
    return seconds


def cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    sample_rows: int = 1000,
    seed: int = 7,
    keep_features: bool = False,
) -> DataFrame:
    """``docs`` with ``rejected_by``: the rule of the cascade that fires first, or null.

    ``sample_rows`` bounds (in expectation) the sample that costs and selectivities
    are measured on; verdicts are taken on every row and whole texts.  Which of several
    firing rules is named depends on the measured order, whether one fires does not.
    With ``keep_features`` the counts are columns of the result, computed once.
    """
    names = list(COUNTS) if keep_features else []
    base = docs.select(F.col(f"`{text_col}`").alias("text"))
    n = base.count()
    with Scratch(docs.sparkSession) as scratch:
        sample = scratch.staged(base.sample(min(1.0, sample_rows / max(n, 1)), seed).repartition(4), "cascade-sample")
        ordered = order_rules(rules, estimate(sample, rules))
    row = F.struct(*without(docs, [*names, "rejected_by"])).alias("row")
    return docs.select(row, verdict(F.col(f"`{text_col}`"), ordered, names).alias("v")).select("row.*", *[F.col(f"v.{k}") for k in (*names, "rejected_by")])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    f = {k: F.col(k) for k in COUNTS}
    base = F.lit(False)
    for r in RULES:
        if r.base:
            base = base | r.rejects(f)
    return cascade(docs, keep_features=True).select("doc_id", *f, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)
), p AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM w) WHERE n > 1
), r AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM p GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter_words, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) AS n_cut_off
  FROM d LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 4 * n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 8 * n_dup_lines > n_words
            OR 2 * n_letter_words < n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_cut_off > 3 * n_lines) AS kept
FROM f
"""
