"""Bank statements: balance audit, duplicate transactions, order, sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_day
from ..functions.text import squeeze
from . import scan

# --- fixed values ---
CREDIT_WORDS = "deposit|credit|interest|refund|incoming|receive"
DEBIT_WORDS = "withdrawal|debit|check|payment|fee|purchase|outgoing|send"
DEPOSIT_SUMMARY_WORDS = (
    "SUMMARY", "SUM. ", "TOTAL", "BALANCE SUMMARY", "LEDGER BALANCE", "NATIONAL LOCKBOX", "PAGE ", "RECOVERED VIA", "==================", "ACCOUNT STATEMENT", "FOR THE PERIOD", "ACCOUNT NUMBER:",
    "TRANSACTIONS FOR A TOTAL", "DEPOSITS AND OTHER CREDITS", "DATE CHECK REFERENCE", "DISBURSEMENTS", "TRADE SERVICES", "ZERO BALANCE TRANSFERS", "POSTED AMOUNT DESCRIPTION", "ADJUSTMENTS", "ACCOUNT SUMMARY",
)
DEBIT_SUMMARY_WORDS = (
    "SUMMARY", "SUM. ", "TOTAL", "LEDGER BALANCE", "BEGINNING BALANCE", "PAGE ", "RECOVERED VIA", "==================", "ACCOUNT STATEMENT", "FOR THE PERIOD", "ACCOUNT NUMBER:", "TRANSACTIONS FOR A TOTAL",
    "CHECKS AND OTHER DEBITS", "DATE CHECK REFERENCE", "DISBURSEMENTS", "ZERO BALANCE TRANSFERS", "POSTED AMOUNT DESCRIPTION", "ADJUSTMENTS", "ACH DEBITS", "TRADE SERVICES", "INVESTMENTS", "NATIONAL LOCKBOX",
    "CHECK REFERENCE | DATE", "ITEMS AMOUNT", "DEPOSITS AND OTHER CREDITS", "FUNDS TRANSFER FROM ACCT", "ACCOUNT SUMMARY",
)
# --- end of fixed values ---


def signed(amount: Column, description: Column) -> Column:
    """Debits negative, credits positive, by the words of the description."""
    d, v = F.lower(F.coalesce(description, F.lit(""))), F.coalesce(amount, F.lit(0))
    return F.when(d.rlike(DEBIT_WORDS) & (v > 0), -v).when(~d.rlike(DEBIT_WORDS) & d.rlike(CREDIT_WORDS) & (v < 0), -v).otherwise(v)


def audit_balance(tx: DataFrame, part: str, order: list[str], opening: Column, tolerance: float = 0.01, turn: bool = False, crowded: int = scan.CROWDED) -> DataFrame:
    """Adds prior (the balance before), value (signed), fixed with the amount it should be, and
    a note: whether the sign alone is wrong, else the amount.

    A printed balance is an anchor: the balance before a row is the last anchor before it,
    or the opening, plus the signed amounts since.  With ``turn``, a statement is read twice,
    with the signs as they are and with all of them turned, and the reading that agrees with
    more of its anchors is taken for all its rows (as they are, at a tie); ``turned`` tells
    which it was.
    """
    v = signed(F.col("amount"), F.col("description"))
    t = scan.since_anchor(tx.withColumn("value", v), part, order, F.col("running_balance"), F.col("value"), crowded=crowded)
    base = F.coalesce("anchor", opening)
    gap = lambda way: F.abs(base + way * (F.col("since") + F.col("value")) - F.col("running_balance"))
    if turn:
        agree = lambda way: F.count_if(gap(F.lit(way)) <= tolerance)
        per = t.groupBy(F.col(part).alias("__p")).agg((agree(-1) > agree(1)).alias("turned"))
        t = t.join(per, F.col(part).eqNullSafe(F.col("__p"))).drop("__p")
        way = F.when(F.col("turned"), -1).otherwise(1)
        t = t.withColumn("value", (way * F.col("value")).cast(t.schema["value"].dataType)).withColumn("since", (way * F.col("since")).cast(t.schema["since"].dataType))
    t = t.withColumn("prior", base + F.col("since"))
    off = F.abs(F.col("prior") + F.col("value") - F.col("running_balance")) > tolerance
    t = t.withColumn("fixed", F.coalesce(off, F.lit(False)))
    swapped = F.abs(F.col("prior") - F.col("value") - F.col("running_balance")) <= tolerance
    note = F.when(F.col("fixed") & swapped, "sign reversed").when(F.col("fixed"), F.concat(F.lit("amount should be "), F.format_string("%.2f", F.abs(F.col("running_balance") - F.col("prior")).cast("double"))))
    t = t.withColumn("note", note)
    return t.withColumn("amount_due", F.when(F.col("fixed"), F.abs(F.round(F.col("running_balance") - F.col("prior"), 2))).otherwise(F.col("amount"))).drop("anchor", "since")


def summary_line(description: Column, amount: Column, most: float, words: tuple[str, ...] = DEPOSIT_SUMMARY_WORDS, by_count: bool = False) -> Column:
    """Rows that sum others: by a word, by an amount over ``most``, or, ``by_count`` (for debits
    only), by a count and an amount in the description, the amount being the row's own."""
    d = F.upper(F.coalesce(description, F.lit("")))
    named = F.lit(False)
    for w in words:
        named = named | d.contains(w)
    own = F.format_number(F.abs(amount).cast("decimal(18,2)").cast("double"), 2)
    counted = d.rlike(r"\d+\s+[\d,]+\.\d{2}") & (d.contains(own) | d.contains(F.replace(own, F.lit(","), F.lit(""))))
    return named | F.coalesce((F.abs(amount) > most) | (counted if by_count else F.lit(False)), F.lit(False))


#: Days between ``MM/DD`` dates that count as at most one day apart, round the turn of the year.
NEAR = (-365, -364, -1, 0, 1, 364, 365)
GRAM = 5


def contained(nodes: DataFrame) -> DataFrame:
    """(whole, part): nodes of equal ``key``, at most a day apart, of which one's text holds
    the other's; ``nodes`` has key, node, day and text, node by node.

    A text is looked up by its rarest ``GRAM`` letters among those of its key, a shorter one
    by itself, in the pieces of all texts; so texts of an amount that have nothing rare in
    common never meet.
    """
    def pieces(n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, n))
        return F.when(n == 0, F.array(F.lit(""))).when(F.length("text") >= n, cut).otherwise(F.array().cast("array<string>"))

    # explode multiplies rows beyond what the planner expects: the hints keep it from broadcasting them
    grams = nodes.select("key", "node", "day", F.explode(F.array_distinct(pieces(F.lit(GRAM)))).alias("piece")).hint("merge")
    often = grams.groupBy("key", "piece").agg(F.count("*").alias("df"))
    rare = grams.join(often, ["key", "piece"]).groupBy("node").agg(F.min(F.struct("df", "piece"))["piece"].alias("piece"))
    parts = nodes.join(rare, "node", "left").withColumn("piece", F.coalesce("piece", "text"))
    parts = parts.select("key", F.col("node").alias("part"), F.col("text").alias("less"), "piece", F.explode(F.array(*[F.col("day") + s for s in NEAR])).alias("day"))
    short = nodes.where(F.length("text") < GRAM).groupBy("key").agg(F.collect_set(F.length("text")).alias("lengths"))
    lengths = F.concat(F.array(F.lit(GRAM)), F.coalesce("lengths", F.array().cast("array<int>")))
    every = nodes.join(short, "key", "left").select("key", F.col("node").alias("whole"), "day", "text", F.explode(F.array_distinct(F.flatten(F.transform(lengths, pieces)))).alias("piece")).hint("merge")
    met = every.join(parts, ["key", "day", "piece"]).where((F.col("whole") != F.col("part")) & F.col("text").contains(F.col("less")))
    return met.select("whole", "part").distinct()


def drop_duplicates(tx: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Transactions without those that repeat one of equal keys, at most a day apart, whose
    description holds the other's.  Of two the longer description stays; the first, if equal.
    Rows are taken in ``order``: one that a row that stays holds is dropped; else it stays,
    and those it holds go.

    Rows of equal keys, day and text are one node.  Which nodes hold one another is found by
    ``contained``.  Of a node that meets no other, the first row stays.  The others are dealt
    by key and stretch of days and folded in order, streaming: each task keeps, for a node,
    whether it stays and how many that hold it do.  A date that is no day is near none but
    its like.
    """
    text = squeeze(F.upper(F.coalesce("description", F.lit(""))))
    day = F.coalesce(F.datediff(month_day(F.col("date")), F.lit("2000-01-01").cast("date")), F.lit(-9999))
    key = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    rows = tx.select(key.alias("key"), F.col(order).alias("__o"), day.alias("day"), text.alias("text"))
    rows = rows.withColumn("node", F.md5(F.concat_ws(" ", "key", "day", "text")))
    nodes = rows.groupBy("key", "node", "day", "text").agg(F.min("__o").alias("__o"))
    pairs = contained(nodes.where("day >= 0"))
    linked = pairs.select(F.explode(F.array("whole", "part")).alias("node")).distinct()
    alone = nodes.join(linked, "node", "left_anti").select("__o")

    # the days of a key in stretches: a year at most
    met = nodes.join(linked, "node", "left_semi")
    days = met.groupBy("key").agg(F.array_sort(F.collect_set("day")).alias("days"))
    starts = F.filter("days", lambda d, i: (i == 0) | (d - F.get("days", i - 1) > 1))
    stretch = F.size(F.filter("starts", lambda s: s <= F.col("day")))
    real = F.array_min(F.filter("days", lambda d: d >= 0))
    round_ = (F.array_max("days") - real >= 364) & (stretch == F.size("starts"))
    days = days.select("key", "days", starts.alias("starts"))
    placed = met.join(days, "key").withColumn("stretch", F.when(round_, F.size(F.filter("starts", lambda s: s <= real))).otherwise(stretch))
    holds = pairs.groupBy("whole").agg(F.collect_list("part").alias("parts")).withColumnRenamed("whole", "node")
    placed = placed.join(holds, "node", "left").select("node", F.concat_ws(" ", "key", "stretch").alias("group"), "parts")
    kind = rows.schema["__o"].dataType.simpleString()

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, stays, held, parts = None, {}, Counter(), {}

        def lost(node: str) -> None:
            for p in (node, *parts[node]):
                held[p] -= 1
            del stays[node]

        for b in batches:
            done = []
            for g, node, o, inside in zip(b["group"], b["node"], b["__o"], b["parts"]):
                if g != group:
                    done += stays.values()
                    group, stays, held, parts = g, {}, Counter(), {}
                if held[node] > 0:
                    continue
                parts[node] = [] if inside is None else list(inside)
                for p in parts[node]:
                    if p in stays:
                        lost(p)
                stays[node] = o
                for p in (node, *parts[node]):
                    held[p] += 1
            yield pd.DataFrame({"__o": pd.Series(done, dtype=b["__o"].dtype)})
        yield pd.DataFrame({"__o": list(stays.values())})

    ordered = rows.select("node", "__o").join(placed, "node").repartition("group").sortWithinPartitions("group", "__o")
    stay = alone.unionByName(ordered.select("group", "node", "__o", "parts").mapInPandas(folded, f"__o {kind}"))
    return tx.join(stay.withColumnRenamed("__o", order), order, "left_semi")


def debit_order(check_no: Column, date: Column) -> list[Column]:
    """Checks first, by number, then the rest by date."""
    digits = F.regexp_replace(check_no, r"\D", "")
    return [check_no.isNull(), F.when(check_no.isNull(), 0).otherwise(F.coalesce(digits.try_cast("long"), F.lit(999999999))), F.coalesce(date, F.lit("99/99"))]


def deposit_order(date: Column) -> list[Column]:
    """By date; what has none comes last."""
    return [F.coalesce(date, F.lit("99/99"))]


def placed(tx: DataFrame, part: str, order: list[Column | str]) -> DataFrame:
    """The rows with their place within their statement."""
    return tx.withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy(*order)))


def sums(tx: DataFrame, part: str) -> DataFrame:
    """Deposits, debits without and with a check number."""
    v, check = F.col("value"), F.col("check_no").isNotNull()
    s = lambda c: F.coalesce(F.sum(F.when(c, F.abs(v))), F.lit(0)).cast("double")
    return tx.groupBy(part).agg(s(v > 0).alias("deposits"), s((v < 0) & ~check).alias("debits"), s((v < 0) & check).alias("checks"))
