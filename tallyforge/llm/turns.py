"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``: nothing,
or an optional system turn and then user and assistant in turn.  Each row is kept (K, no
cost), given the role that is due (R, 2) or deleted (D, 3); empty turns may be inserted
anywhere (I, 2).  Blank and repeated rows must go; a kept row whose text breaks off adds 1.

Costs come from a weighted automaton with four states, made deterministic as it is used:
the vector of the states' costs to the end, less its least entry, is one state of the
deterministic automaton, and its moves by row class are cached in a transition table.
The vectors differ by bounded amounts, so the table stays small.  Rows are scanned from
the last to the first by table look-ups; then a trace in the other direction follows the
tight arcs, those on which the costs are exact, taking the least letter among them.

Rows are put in order by ranges and cut into pieces of ``2**PIECE_BITS``.  A conversation
in several pieces is joined through what each piece does to the four states: min-plus
matrices from the right, then maps of states from the left, both combined in groups of
``2**FAN_BITS`` level by level.  So no conversation is gathered, however long.  Only the
hash of a repaired conversation is taken by one task, as a hash must be; it streams the
sorted rows and holds one batch.

Rows go by turn, null turns first; equal turns by role, the first 64 characters of the
text, its hash, and a frozen row number.  Null roles and texts read as one space.  A null
conversation id is a conversation.  Conversations without rows have zeros, no edits and
the hash of nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, SPACES, Scratch, dense_positions, staged

PIECE_BITS = 8
FAN_BITS = 10
#: No cost that can occur.
BIG = 10**15
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the role that is due leads.
DUE = (USER, USER, ASSISTANT, USER)
#: Where a kept row leads, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "-": {}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua-"
SOUND, MUST_GO, BREAKS_OFF = range(3)
#: A letter for each class of rows: initial, then fault.
CLASSES = "abcdefghijkl"
#: Costs to the end of a conversation that has no rows left.
FINAL = (0, 2 * INSERT, INSERT, 0)


class Automaton:
    """The deterministic automaton, grown as its moves are asked for."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.moves: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(id of the normalised vector, what was taken off)."""
        least = min(costs)
        shape = tuple(BIG if c >= BIG else c - least for c in costs)
        if shape not in self.ids:
            self.ids[shape] = len(self.vectors)
            self.vectors.append(shape)
            self.moves.append([None] * len(CLASSES))
        return self.ids[shape], least

    def choices(self, after: int, kind: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, state, cost to the end) of what may be done with a row in state ``q``."""
        v, fault = self.vectors[after], kind % 3
        out = [("D", q, DELETE + v[q])]
        if fault != MUST_GO:
            extra = CUT_OFF if fault == BREAKS_OFF else 0
            if (to := KEPT[INITIALS[kind // 3]].get(q)) is not None:
                out.append(("K", to, extra + v[to]))
            out.append(("R", DUE[q], RETYPE + extra + v[DUE[q]]))
        return out

    def move(self, after: int, kind: int) -> tuple[int, int]:
        """(state, cost taken off) to the left of a row of class ``kind`` with ``after`` to its right."""
        if self.moves[after][kind] is None:
            done = [min(c for _, _, c in self.choices(after, kind, q)) for q in range(4)]
            costs = [min(done[q], INSERT + done[DUE[q]], 2 * INSERT + done[DUE[DUE[q]]]) for q in range(4)]
            self.moves[after][kind] = self.state(tuple(min(c, BIG) for c in costs))
        return self.moves[after][kind]

    def scan(self, kinds: list[int], right: tuple[int, ...]) -> tuple[list[int], int]:
        """(states right of each row and left of the first, total taken off)."""
        at, total = self.state(right)
        seen = [at]
        for kind in reversed(kinds):
            at, cost = self.moves[at][kind] or self.move(at, kind)
            total += cost
            seen.append(at)
        return seen[::-1], total

    def arc(self, after: int, kind: int, q: int) -> tuple[str, int]:
        """(letters up to and with the row's own, state behind it): the least tight ones."""
        key = (after, kind, q)
        if key not in self.arcs:
            left, cost = self.move(after, kind)
            exact = cost + self.vectors[left][q]
            tight = [(letter, to) for letter, to, c in self.choices(after, kind, q) if c == exact]
            if INSERT + cost + self.vectors[left][DUE[q]] == exact:
                tight.append(("I", DUE[q]))
            letter, to = min(tight)
            if letter == "I":
                rest, to = self.arc(after, kind, to)
                letter += rest
            self.arcs[key] = (letter, to)
        return self.arcs[key]


_automaton = Automaton()


def kinds_of(letters: str) -> list[int]:
    return [b - ord("a") for b in letters.encode()]


def transfer(letters: str) -> list[int]:
    """The 4 by 4 min-plus matrix of a piece, row by row: cost from a state to its left to one to its right."""
    columns = []
    for r in range(4):
        seen, total = _automaton.scan(kinds_of(letters), tuple(0 if q == r else BIG for q in range(4)))
        columns.append([min(BIG, c + total) for c in _automaton.vectors[seen[0]]])
    return [columns[r][q] for q in range(4) for r in range(4)]


def steps(letters: str, right: tuple[int, ...], q: int) -> tuple[list[str], int]:
    """(letters at each row, last state) of the cheapest edits from state ``q``."""
    kinds, out = kinds_of(letters), []
    seen, _ = _automaton.scan(kinds, right)
    for kind, after in zip(kinds, seen[1:]):
        found, q = _automaton.arcs.get((after, kind, q)) or _automaton.arc(after, kind, q)
        out.append(found)
    return out, q


def matrix_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(BIG, (a.reshape(4, 4, 1) + b.reshape(1, 4, 4)).min(1)).ravel()


def matrix_to_vector(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.minimum(BIG, (a.reshape(4, 4) + v).min(1))


def carried(parts: DataFrame, times: Callable, act: Callable, start: tuple[int, ...], backward: bool, scratch: Scratch) -> DataFrame:
    """(conv, block, carry): what the blocks before each block (behind it, if ``backward``)
    make of ``start``.  ``parts`` has (conv, block, value); ``times`` joins the values of two
    neighbours, left one first, ``act`` applies a value to a carry.  Blocks are combined
    in groups of bounded size, level by level, and their carries handed down again."""
    levels, below = [], parts.select("conv", "block", "value")
    many = parts.groupBy("conv").count().where("count > 1").select("conv")
    below = scratch.staged(below.join(many, "conv", "left_semi"), "parts")

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(value=[reduce(times, [np.asarray(k["value"]) for k in kids]) for kids in b["kids"]])

    def handed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, kids, carry in zip(b["conv"], b["kids"], b["carry"]):
                carry = np.asarray(carry)
                for k in reversed(kids) if backward else kids:
                    out.append((conv, k["block"], carry))
                    carry = act(np.asarray(k["value"]), carry)
            yield pd.DataFrame(out, columns=["conv", "block", "carry"])

    begin = F.array(*[F.lit(x).cast("long") for x in start])
    while not below.groupBy("conv").count().where("count > 1").isEmpty():
        up = below.groupBy("conv", F.shiftright("block", FAN_BITS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("kids"))
        up = up.select("conv", F.col("up").alias("block"), "kids")
        levels.append(scratch.staged(up.mapInPandas(combined, "conv string, block long, kids array<struct<block:long,value:array<long>>>, value array<long>"), "carries"))
        below = levels[-1]
    down = below.select("conv", "block", begin.alias("carry"))
    while levels:
        down = levels.pop().join(down, ["conv", "block"]).mapInPandas(handed, "conv string, block long, carry array<long>")
    return down


def classified(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (conv, turn, role, text, row) with ``fault``: 1 blank, 2 repeated, 3 breaks
    off, 0 none; ``kind``, the class letter; ``head`` and ``sha`` of the text in its place."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    narrow = rows.select("conv", "turn", "role", "row", end.alias("end"), F.left("text", F.lit(64)).alias("head"), F.sha2("text", 256).alias("sha"))
    narrow = scratch.staged(narrow, "turns")
    first = narrow.groupBy("conv", "role", "sha").agg(F.min(F.struct("turn", "row"))["row"].alias("row")).select("row", F.lit(True).alias("first"))
    fault = F.when(F.col("end") == "", 1).when(F.col("first").isNull(), 2).when(~F.col("end").isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    group = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    told = narrow.join(first, "row", "left").withColumn("fault", fault)
    what = F.when(F.col("fault") == 0, SOUND).when(F.col("fault") == 3, BREAKS_OFF).otherwise(MUST_GO)
    return told.withColumn("kind", F.substring(F.lit(CLASSES), group * 3 + what + F.lit(1), F.lit(1))).drop("first", "end")


def illegal_pairs(letters: Column) -> Column:
    """Neighbouring rows in a string of class letters whose initials are not su, ua or au."""
    initial = F.translate(letters, CLASSES, "".join(i * 3 for i in INITIALS))
    pair = F.transform(F.sequence(F.lit(1), F.length(initial) - 1), lambda i: F.substring(initial, i, F.lit(2)))
    return F.when(F.length(initial) < 2, F.lit(0)).otherwise(F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))).cast("long")


def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of pieces with their carries: per row the lines of turns inserted before it, its
    letter and new role, and the lines behind it; per piece its edits and their cost."""
    for b in batches:
        out = []
        for conv, block, kinds, last, right, left in zip(b["conv"], b["block"], b["kinds"], b["last"], b["right"], b["left"]):
            q = int(left[0])
            found, end = steps(kinds, tuple(int(x) for x in right), q)
            if last:  # what is due at the end of the conversation
                found[-1] += "I" * (FINAL[end] // INSERT)
            rows, cost = [], 0
            for letters, kind in zip(found, kinds):
                lines: tuple[list[str], list[str]] = ([], [])
                own = role = None
                for letter in letters:
                    if letter == "I":
                        q = DUE[q]
                        lines[own is not None].append(NAMES[q] + ":")
                        cost += INSERT
                        continue
                    own = letter
                    if letter == "R":
                        q = DUE[q]
                        role = NAMES[q]
                    elif letter == "K":
                        q = KEPT[INITIALS[kinds_of(kind)[0] // 3]][q]
                    broken = kinds_of(kind)[0] % 3 == BREAKS_OFF
                    cost += {"K": 0, "R": RETYPE, "D": DELETE}[letter] + (CUT_OFF if broken and letter != "D" else 0)
                rows.append({"before": "\n".join(lines[0]) or None, "edit": own, "role": role, "behind": "\n".join(lines[1]) or None})
            out.append((conv, block, "".join(found), cost, rows))
        yield pd.DataFrame(out, columns=["conv", "block", "audit", "cost", "edits"])


EDITS = "array<struct<before string, edit string, role string, behind string>>"


def repair(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(per conversation, per row) for ``rows`` of (conv, turn, role, text, row).

    The first has conv, n, gaps, blank, duplicate, truncated, illegal, cost and audit; the
    second conv, pos, line: the repaired lines at each row in order, null if there are none.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("sha"), F.col("row")]
    placed = scratch.staged(dense_positions(classified(rows, scratch), order, "pos", scratch), "placed")
    counts = placed.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == i).alias(c) for i, c in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
        F.max("pos").alias("last"),
    )
    counts = scratch.staged(counts, "counts")
    inside = F.sort_array(F.collect_list(F.struct("pos", "kind", "row")))
    pieces = placed.groupBy("conv", F.shiftright("pos", PIECE_BITS).alias("block")).agg(inside.alias("at"))
    pieces = pieces.join(counts.select("conv", F.shiftright("last", PIECE_BITS).alias("end")), "conv")
    pieces = scratch.staged(pieces.select("conv", "block", (F.col("block") == F.col("end")).alias("last"), F.array_join("at.kind", "").alias("kinds"), F.col("at.row").alias("rows"), F.col("at")[0]["pos"].alias("first")), "pieces")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conv": b["conv"], "block": b["block"], "value": [transfer(k) for k in b["kinds"]]})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            value = [[steps(k, tuple(int(x) for x in r), q)[1] for q in range(4)] for k, r in zip(b["kinds"], b["right"])]
            yield pd.DataFrame({"conv": b["conv"], "block": b["block"], "value": value})

    kinds = pieces.select("conv", "block", "kinds", "last")
    split = pieces.groupBy("conv").count().where("count > 1").select("conv")
    cut = scratch.staged(kinds.join(split, "conv", "left_semi"), "cut")
    value = "conv string, block long, value array<long>"
    right = carried(cut.mapInPandas(matrices, value), matrix_times, matrix_to_vector, FINAL, True, scratch)
    cut = scratch.staged(cut.join(right.withColumnRenamed("carry", "right"), ["conv", "block"]), "cut")
    left = carried(cut.mapInPandas(maps, value), lambda a, b: b[a], lambda a, q: a[q], (START,), False, scratch)
    cut = cut.join(left.withColumnRenamed("carry", "left"), ["conv", "block"])
    whole = kinds.join(split, "conv", "left_anti").select("*", F.array(*map(F.lit, FINAL)).cast("array<long>").alias("right"), F.array(F.lit(START)).cast("array<long>").alias("left"))
    edits = scratch.staged(whole.unionByName(cut).mapInPandas(edited, f"conv string, block long, audit string, cost long, edits {EDITS}"), "edits")

    tail = pieces.select("conv", (F.col("block") + 1).alias("block"), F.right("kinds", F.lit(1)).alias("tail"))
    pairs = pieces.join(tail, ["conv", "block"], "left").groupBy("conv").agg(F.sum(illegal_pairs(F.concat(F.coalesce("tail", F.lit("")), "kinds"))).alias("illegal"))
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "")
    found = counts.join(pairs, "conv").join(edits.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit")), "conv").drop("last")

    one = edits.join(pieces.select("conv", "block", "rows", "first"), ["conv", "block"])
    one = one.select("conv", "first", F.posexplode(F.arrays_zip("edits", "rows")).alias("i", "e"))
    one = one.select((F.col("first") + F.col("i")).alias("pos"), F.col("e.rows").alias("row"), "e.edits.before", "e.edits.edit", F.col("e.edits.role").alias("to"), "e.edits.behind")
    own = F.when(F.col("edit") != "D", F.concat(F.coalesce("to", "role"), F.lit(":"), "text"))
    line = F.nullif(F.concat_ws("\n", "before", own, "behind"), F.lit(""))
    return found, rows.join(one, "row").select("conv", "pos", line.alias("line"))


def hashes(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines of each conversation in order, joined by \\n."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = total = None
        started = False
        for b in batches:
            out = []
            for conv, line in zip(b["conv"], b["line"]):
                if conv != current:
                    if current is not None:
                        out.append((current, total.hexdigest()))
                    current, total, started = conv, hashlib.sha256(), False
                if line is not None:
                    total.update(("\n" + line if started else line).encode())
                    started = True
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if current is not None:
            yield pd.DataFrame([(current, total.hexdigest())], columns=["conv", "repaired_sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "pos").mapInPandas(hashed, "conv string, repaired_sha256 string")


def keyed(convs: DataFrame) -> DataFrame:
    """With ``conv``, a text for each conversation id that is never null."""
    return convs.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given role user by a hash of their key."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % F.lit(20)
    rows = keyed(convs).select("conv", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def digest(convs: DataFrame) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest repair and the repaired hash."""
    with Scratch(convs.sparkSession) as scratch:
        rows = scratch.staged(damaged(convs).withColumn("row", F.monotonically_increasing_id()), "damaged")
        found, lines = repair(rows, scratch)
        out = keyed(convs).select("conv", "conv_id").distinct().join(found, "conv", "left").join(hashes(lines), "conv", "left")
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names]
        nothing = hashlib.sha256(b"").hexdigest()
        return staged(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")), "repaired")


ORACLE_SQL = f"""WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL.format(s="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations
), y AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x
), z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM y
), o AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM z
), ins(q, pre, names, mid) AS (VALUES ('0', '', '', '0'), ('0', 'I', 'user:', 'u'), ('0', 'II', 'user:' || chr(10) || 'assistant:', 'a'), ('s', '', '', 's'), ('s', 'I', 'user:', 'u'), ('s', 'II', 'user:' || chr(10) || 'assistant:', 'a'),
  ('u', '', '', 'u'), ('u', 'I', 'assistant:', 'a'), ('u', 'II', 'assistant:' || chr(10) || 'user:', 'u'), ('a', '', '', 'a'), ('a', 'I', 'user:', 'u'), ('a', 'II', 'user:' || chr(10) || 'assistant:', 'a')
), ops(mid, letter, initial, too, due) AS (VALUES ('0', 'K', 's', 's', ''), ('0', 'K', 'u', 'u', ''), ('s', 'K', 'u', 'u', ''), ('u', 'K', 'a', 'a', ''), ('a', 'K', 'u', 'u', ''), ('0', 'R', '', 'u', 'user'), ('s', 'R', '', 'u', 'user'), ('u', 'R', '', 'a', 'assistant'), ('a', 'R', '', 'u', 'user'),
  ('0', 'D', '', '0', ''), ('s', 'D', '', 's', ''), ('u', 'D', '', 'u', ''), ('a', 'D', '', 'a', '')
), m AS (SELECT DISTINCT conv_id, n FROM o
), r AS (SELECT conv_id, n + 1 AS i, q, {{'cost': cost, 'audit': audit, 'lines': lines}} AS best FROM m, (VALUES ('0', 0, '', ''), ('a', 0, '', ''), ('u', 2, 'I', 'assistant:'), ('s', 4, 'II', 'user:' || chr(10) || 'assistant:')) AS f(q, cost, audit, lines)
  UNION ALL SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) FROM (
    SELECT o.conv_id, o.i, ins.q, CAST(best.cost + 2 * length(pre) + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS INTEGER) AS cost, pre || letter || best.audit AS audit,
           concat_ws(chr(10), nullif(names, ''), CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN due || ':' || text END, nullif(best.lines, '')) AS lines
    FROM r JOIN o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.i = r.i - 1 JOIN ops ON ops.too = r.q AND (letter <> 'K' OR initial = left(role, 1)) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.mid = ops.mid) GROUP BY conv_id, i, q
), g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = 1 AND r.q = '0'"""
