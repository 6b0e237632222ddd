"""Bank statements as text: sections, row grammars, and the rows of a whole statement."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import found, money

DAY = r"\d{2}/\d{2}"
SUM = r"\d[\d,]*\.\d{2}"


def behind(text: Column, start: str, ends: list[str]) -> Column:
    """What stands behind the first match of ``start``, up to the earliest of ``ends``; null
    without a start.  Patterns ignore case, and ``^`` and ``$`` are line ends."""
    tail = F.regexp_extract(text, rf"(?im)(?:{start})((?s:.*))\z", 1)
    stops = [F.nullif(F.regexp_instr(tail, F.lit(f"(?im){e}")), F.lit(0)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0] if stops else F.lit(None).cast("int")
    return F.when(text.rlike(f"(?im){start}"), F.when(stop.isNotNull(), F.left(tail, stop - 1)).otherwise(tail))


def lines_of(docs: DataFrame, doc: str, block: Column) -> DataFrame:
    """(doc, pos, line): trimmed lines that are not blank."""
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    return docs.select(doc, F.posexplode(lines).alias("pos", "line"))


@dataclass(frozen=True)
class Grammar:
    """Dated rows of a section: ``row`` has the groups date, amount and description at the
    places named; lines that match ``skip`` are no rows, and lines that match ``breaks`` do
    not go on with the row before."""

    start: str
    ends: tuple[str, ...]
    row: str
    date: int
    amount: int
    description: int
    skip: str = r"^\b$"
    breaks: str = r"^\b$"


# --- fixed values: headings, rows and ends of printed sections ---
NOISE = r"(?i)^(?:Ledger|Date)\b|^Total\b|Page\s+\d+\s+of\s+\d+|\(continued\)|Account\s+Number:|\d{4}\s+through\s+"
FINE_PRINT = r"|^\*\s|Annual\s+Percentage\s+Yield|Please\s+examine\s+this\s+statement|subject\s+to|notify\s+us|mailing\s+or|availability"
LEDGER_ROW = rf"^({DAY})\s+(.+?)\s+\$?({SUM})\s*$"
POSTED = rf"^({DAY})\s+{DAY}\s+([\d,\s]*\.\d{{2}})"
CREDITS = Grammar(r"^[ \t]*Deposits\s+and\s+Credits[ \t]*$", (r"^[ \t]*Withdrawals\s+and\s+Debits", r"^[ \t]*Checks\s+Paid", r"^[ \t]*Daily\s+Balance"), LEDGER_ROW, 1, 3, 2, NOISE + r"|^Deposits\s+and\s+Credits\b" + FINE_PRINT, "(?i)ledger date|amount|description")
WITHDRAWALS = Grammar(r"^[ \t]*Withdrawals\s+and\s+Debits[ \t]*$", (r"^[ \t]*Checks\s+Paid", r"^[ \t]*Daily\s+Balance", r"^[ \t]*Daily\s+Ending\s+Balance"), LEDGER_ROW, 1, 3, 2, NOISE + r"|^Withdrawals\s+and\s+Debits\b", "(?i)ledger date|amount|description")
POSTED_CREDITS = Grammar(r"^\s*(?:DEPOSITS/CREDITS|TRANSACTIONS)\s*$", (r"^\s*CHARGES/DEBITS\s*$", r"^\s*CHECKS\s+PROCESSED\s*$"), POSTED + r"\s+(.+)$", 1, 2, 3, r"^\b$", rf"(?i)^(?:Posting|Effective|Date|Amount|Description)$|^{DAY}")
POSTED_DEBITS = Grammar(r"^\s*CHARGES/DEBITS\s*$", (r"^\s*CHECKS\s+PROCESSED\s*$", r"^\s*DAILY\s+BALANCE\s*$"), POSTED + r"\s*-\s*(.*)$", 1, 2, 3, r"^\b$", rf"^{DAY}")
# --- end of fixed values ---


def dated_rows(docs: DataFrame, doc: str, text: str, g: Grammar) -> DataFrame:
    """(doc, n, date, amount, description, check_no) of a section by its grammar.  Lines that
    are no rows go on with the description of the row before."""
    lines = lines_of(docs, doc, behind(F.col(text), g.start, list(g.ends))).where(~F.col("line").rlike(g.skip))
    starts = F.col("line").rlike(g.row)
    run = F.count_if(starts).over(Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("starts", starts).withColumn("run", run).where((F.col("run") > 0) & (F.col("starts") | ~F.col("line").rlike(g.breaks)))
    more = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("pos", "line"))))
    rows = lines.groupBy(doc, "run").agg(F.max(F.when(F.col("starts"), F.col("line"))).alias("line"), F.transform(more, lambda x: x["line"]).alias("more"))
    part = lambda i: F.regexp_extract("line", g.row, i)
    description = F.trim(F.array_join(F.concat(F.array(F.trim(part(g.description))), F.col("more")), " "))
    return rows.select(
        doc, (F.col("run") - 1).cast("int").alias("n"), part(g.date).alias("date"), F.abs(money(part(g.amount))).alias("amount"), description.alias("description"), found(description, r"(?i)Check\s+No:\s*(\d+)").alias("check_no"),
    )


def split_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, date, amount, description) of zero-balance transfers: rows with their
    descriptions, then rows whose descriptions stand in a list of their own, paired in order;
    rows left without one drop out."""
    block = behind(F.col(text), r"(?=Zero\s+Balance\s+Transfers\s+\d+\s+transactions\b)", [r"\bChecks\s+and\s+Substitute\s+Checks\s+\d+\s+transactions\s+for\s+a\s+total\b"])
    lines = lines_of(docs, doc, block)
    row = rf"^({DAY})\s+(\d[\d,\s]*\.\d{{2}})\s*(.*)$"
    part = lambda i: F.regexp_extract("line", row, i)
    rows = lines.where(F.col("line").rlike(row)).select(doc, "pos", part(1).alias("date"), money(part(2)).alias("amount"), F.trim(part(3)).alias("description"))
    w = Window.partitionBy(doc).orderBy("pos")
    listed = lines.withColumn("listed", F.max(F.when(F.lower("line") == "transaction", F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    stop = r"(?i)\bChecks\s+and\s+Other\s+Debits\b|\bFor\s+the\s+period\b"
    listed = listed.withColumn("stopped", F.count_if(F.col("listed") & F.col("line").rlike(stop)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = listed.where(F.col("listed") & (F.col("stopped") == 0) & ~F.col("line").rlike(rf"(?i)^(?:description|transaction)$|^{DAY}|^(?:Date|posted|Amount|Reference|number|\|)+$"))
    words = words.select(doc, F.row_number().over(w).alias("k"), F.col("line").alias("listed_as"))
    pending = rows.where("description = ''").withColumn("k", F.row_number().over(w)).join(words, [doc, "k"])
    out = rows.where("description <> ''").select(doc, F.lit(0).alias("late"), "pos", "date", "amount", "description").unionByName(pending.select(doc, F.lit(1).alias("late"), "pos", "date", "amount", F.col("listed_as").alias("description")))
    return out.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("late", "pos")) - 1).cast("int").alias("n"), "date", "amount", "description")


def triples(docs: DataFrame, doc: str, block: Column, pattern: str = rf"(\d{{3,}})\*?\s+({DAY})\s+\$?([\d,]+\.\d{{2}})") -> DataFrame:
    """(doc, n, date, amount, check_no): every ``number date amount`` of a block."""
    zipped = F.arrays_zip(*[F.regexp_extract_all(block, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "check_no"), (2, "date"), (3, "amount"))])
    return docs.select(doc, F.posexplode(zipped).alias("n", "t")).select(doc, "n", "t.date", F.abs(money(F.col("t.amount"))).alias("amount"), "t.check_no")


def daily_check_sums(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, date, amount) of lines ``MM/DD Sum. n amount``."""
    pattern = rf"(?m)^[ \t]*({DAY})\s+Sum\.\s+\d+\s+([\d,]+\.\d{{2}})\b"
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "date"), (2, "amount"))])
    return docs.select(doc, F.posexplode(zipped).alias("n", "t")).select(doc, "n", "t.date", money(F.col("t.amount")).alias("amount"))


def columnar_debits(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, date, amount, description) of a section whose dates, amounts and descriptions
    stand in columns of their own: paired by place, no more than the section counts."""
    block = behind(F.col(text), r"\bACH\s+Debits\b", [r"\bCheck\s+and\s+Substitute\s+Check\s+Summary\b", r"\bMember\s+FDIC\b"])
    every = lambda p: F.regexp_extract_all("block", F.lit(p), F.lit(0))
    words = F.filter(F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(rf"^{DAY}|^{SUM}") & ~F.lower(x).isin("date", "posted", "amount", "transaction", "description", "reference", "number"))
    counted = F.array_max(F.transform(F.regexp_extract_all("block", F.lit(r"(?i)(\d+)\s+transactions\s+for\s+a\s+total"), F.lit(1)), lambda x: x.try_cast("int")))
    b = docs.select(doc, block.alias("block")).where("block IS NOT NULL").select(doc, every(rf"\b{DAY}\b").alias("dates"), every(rf"\b{SUM}\b").alias("amounts"), words.alias("words"), counted.alias("counted"))
    n = F.least(F.size("dates"), F.size("amounts"), F.when(F.col("counted") > 0, F.col("counted")))
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), lambda i: F.struct(F.get("dates", i).alias("date"), F.get("amounts", i).alias("amount"), F.get("words", i).alias("description")))
    return b.select(doc, F.posexplode(rows).alias("n", "t")).select(doc, "n", "t.date", money(F.col("t.amount")).alias("amount"), "t.description")


def check_summary(docs: DataFrame, doc: str, text: str, reach: int = 8) -> DataFrame:
    """(doc, n, date, amount, check_no): numbers of four to ten digits that an amount and a
    date follow within ``reach`` words; the date next to the amount counts first."""
    block = behind(F.col(text), r"\bCheck\s+and\s+Substitute\s+Check\s+Summary\b", [r"\bMember\s+FDIC\b"])
    words = F.filter(F.split(F.regexp_replace(block, r"\|", " "), r"\s+"), lambda x: x != "")

    def entry(tokens: Column, i: Column) -> Column:
        j = i + F.when(F.get(tokens, i + 1) == "*", 2).otherwise(1)
        near = F.slice(tokens, j + 1, F.lit(reach))
        k = F.array_position(F.transform(near, lambda x: x.rlike(r"^[\d,]+\.\d{2}$")), F.lit(True)).cast("int")
        day = lambda x: F.when(x.rlike(rf"^{DAY}$"), x)
        date = F.coalesce(day(F.get(tokens, j + k)), F.get(F.filter(near, lambda x: x.rlike(rf"^{DAY}$")), F.lit(0)))
        return F.when(F.get(tokens, i).rlike(r"^[1-9]\d{3,9}$") & (k > 0) & date.isNotNull(), F.struct(date.alias("date"), F.get(near, k - 1).alias("amount"), F.get(tokens, i).alias("check_no")))

    t = docs.select(doc, words.alias("w")).where("size(w) > 0")
    rows = F.filter(F.transform("w", lambda _, i: entry(F.col("w"), i)), lambda x: x.isNotNull())
    return t.select(doc, F.posexplode(rows).alias("n", "t")).select(doc, "n", "t.date", F.abs(money(F.col("t.amount"))).alias("amount"), "t.check_no")


def _united(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(name)) for name, p in parts])


def deposits(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """All deposits: zero-balance transfers where there are any, else by the ledger's grammar,
    else by that of posted rows."""
    zero = F.col(text).rlike(r"(?i)Zero\s+Balance\s+Transfers\s+\d+\s+transactions\b")
    ledger = dated_rows(docs.where(~zero), doc, text, CREDITS)
    rest = docs.where(~zero).join(ledger.select(doc).distinct(), doc, "left_anti")
    out = _united([("transfers", split_rows(docs.where(zero), doc, text)), ("ledger", ledger), ("posted", dated_rows(rest, doc, text, POSTED_CREDITS))])
    return out.select(doc, "part", "n", "date", "amount", "description")


def debits(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """All debits, by the sections a statement has: posted charges and processed checks; or
    withdrawals and paid checks; and debits in columns and the summary of checks."""
    t = F.col(text)
    has = lambda p: F.coalesce(t.rlike(f"(?i){p}"), F.lit(False))
    ach = has(r"\bACH\s+Debits\b")
    posted = ~ach & has(r"\bCHARGES/DEBITS\b")
    withdrawn = ~posted & ~ach & has(r"\bWithdrawals\s+and\s+Debits\b")
    paid = ~posted & (withdrawn | has(r"\bChecks\s+Paid\b"))
    out = _united([
        ("posted", dated_rows(docs.where(posted), doc, text, POSTED_DEBITS)),
        ("processed", triples(docs.where(posted), doc, behind(t, r"^\s*CHECKS\s+PROCESSED\s*$", [r"^\s*ACTIVITY\s+COUNT\s*$", r"^\s*DAILY\s+BALANCE\s*$"]))),
        ("withdrawn", dated_rows(docs.where(withdrawn), doc, text, WITHDRAWALS)),
        ("paid", triples(docs.where(paid), doc, behind(t, r"^[ \t]*Checks\s+Paid[ \t]*$", [r"^[ \t]*Daily\s+Balance", r"^[ \t]*Daily\s+Ending\s+Balance"]))),
        ("columns", columnar_debits(docs.where(~posted), doc, text)), ("summary", check_summary(docs.where(~posted), doc, text)),
    ])
    return out.select(doc, "part", "n", "date", "amount", "check_no", "description")


def statement_sheet(deposits: DataFrame, debits: DataFrame) -> DataFrame:
    """One table of both sections, by name."""
    return deposits.withColumn("section", F.lit("deposits")).unionByName(debits.withColumn("section", F.lit("debits")), allowMissingColumns=True)


def validation_order(index: Column, date: Column, balance: Column) -> list[Column]:
    """Rows in the order they were read in, where that is known, else by date and balance."""
    return [index.isNull(), index, F.when(index.isNull(), F.coalesce(date, F.lit("00/00"))), F.when(index.isNull(), F.coalesce(balance.try_cast("double"), F.lit(0.0)))]


def verification_report(statements: DataFrame, doc: str) -> DataFrame:
    """(doc, report): what was found beside what the statement says, as Markdown.  Columns:
    status, deposits, debits, checks, and those of ``extract.statement_summary``."""
    money_ = lambda c: F.format_string("$%.2f", F.coalesce(F.col(c), F.lit(0)).cast("double"))
    line = lambda label, ours, theirs: F.concat(F.lit(f"| {label} | "), ours, F.lit(" | "), theirs, F.lit(" |"))
    rows = [
        F.concat(F.lit("## "), F.col(doc).cast("string")), F.concat(F.lit("**Status:** "), F.col("status")), F.lit("| Category | Extracted | Summary Found |"), F.lit("| :--- | :--- | :--- |"),
        line("Deposits", money_("deposits"), money_("total_deposits")), line("Debits", money_("debits"), money_("total_withdrawals")), line("Checks", money_("checks"), money_("total_checks")),
        line("Opening Bal", F.lit("-"), money_("opening_balance")), line("Ending Bal", F.lit("-"), money_("ending_balance")),
    ]
    return statements.select(doc, F.concat_ws("\n", *rows).alias("report"))
