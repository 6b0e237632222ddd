"""Queries of bank statements as text: every statement is printed from a user's events in one
of the known layouts and read back; the SQL knows the events alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.money import cents
from ..operators import statements as ops
from ..sources import readers, shared
from .catalog import query

KIND = {"credit": ("signup", "view"), "debit": ("purchase", "click"), "check": ("error",)}


def _events(spark, d):
    """(doc, rows): a user's events in order, with the amount as printed."""
    e = readers.table(spark, d, "events")
    amount = F.format_number((cents(F.col("value")) + 1000).cast("double"), 2)
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "MM/dd").alias("date"), amount.alias("amount"))
    return e.groupBy(F.col("user_id").alias("doc")).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _section(which: str, line, sep: str = "\n"):
    return F.array_join(F.transform(F.filter("rows", lambda r: r["kind"].isin(*KIND[which])), line), sep)


def _s(x):
    return x["id"].cast("string")


def _text(*parts):
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


LEDGER = lambda word: lambda r: F.concat(r["date"], F.lit(f"   {word} "), _s(r), F.lit("   $"), r["amount"], F.when(r["id"] % 3 == 0, F.concat(F.lit("\n  ref "), _s(r))).otherwise(""))
CHECK = lambda r: F.concat((r["id"] + 100000).cast("string"), F.lit(" "), r["date"], F.lit(" $"), r["amount"])


def _ledger():
    return _text(
        "A Bank", "Account Number: XX-1", " Deposits and Credits ", "Ledger  Description  Amount", "Date", _section("credit", LEDGER("Dep")), "Total 3", "Page 1 of 2", "Withdrawals and Debits", "Date", _section("debit", LEDGER("Pay")),
        "Checks Paid", _section("check", CHECK, "   "), "Daily Balance", "01/01  Dep 0  $5.00",
    )


def _posted():
    credit = lambda r: F.concat(r["date"], F.lit(" "), r["date"], F.lit(" "), r["amount"], F.lit(" Dep "), _s(r), F.when(r["id"] % 3 == 0, F.concat(F.lit("\nref "), _s(r), F.lit("\nPosting"))).otherwise(""))
    debit = lambda r: F.concat(r["date"], F.lit(" "), r["date"], F.lit(" "), r["amount"], F.lit("- "), F.when(r["id"] % 3 == 0, F.concat(F.lit("Check\nCheck No: "), _s(r))).when(r["id"] % 3 == 1, F.concat(F.lit("Check No: "), _s(r))).otherwise("Fee"))
    return _text("Bank", "DEPOSITS/CREDITS", "Posting Effective", _section("credit", credit), "CHARGES/DEBITS", _section("debit", debit), "CHECKS PROCESSED", _section("check", CHECK, "* "), "ACTIVITY COUNT", "123456 01/01 $1.00")


def _columns():
    inline = lambda r: F.concat(r["date"], F.lit(" "), r["amount"], F.when(r["id"] % 2 == 0, F.concat(F.lit(" Dep "), _s(r))).otherwise(""))
    late = F.array_join(F.transform(F.filter("rows", lambda r: r["kind"].isin(*KIND["credit"]) & (r["id"] % 2 == 1)), lambda r: F.concat(F.lit("Dep "), _s(r))), "\n")
    return _text(
        "Zero Balance Transfers 20 transactions for", _section("credit", inline), "Transaction", "description", late, "Checks and Other Debits", "ACH Debits", "Date", "2 transactions for a total", _section("debit", lambda r: r["date"]),
        _section("debit", lambda r: r["amount"]), _section("debit", lambda r: F.concat(F.lit("Pay "), _s(r))), "Check and Substitute Check Summary",
        _section("check", lambda r: F.concat((r["id"] + 100000).cast("string"), F.when(r["id"] % 2 == 0, " * ").otherwise(" "), r["amount"], F.lit(" | "), r["date"], F.lit(" 009869897")), "  "), "Member FDIC 55555 1.00 01/01",
    )


def _statements(spark, d):
    """Printed once: each section is read from the table, not from the events again."""
    k = F.col("doc") % 3
    printed = _events(spark, d).select("doc", F.when(k == 0, _ledger()).when(k == 1, _posted()).otherwise(_columns()).alias("text"))
    return shared.written(printed, "statements")


EVENTS = """e AS (SELECT user_id AS doc, event_id AS id, CASE WHEN event_type IN ('signup', 'view') THEN 'credit' WHEN event_type IN ('purchase', 'click') THEN 'debit' WHEN event_type = 'error' THEN 'check' END AS kind,
 strftime(ts, '%m/%d') AS date, (CAST(value AS DECIMAL(18,2)) + 1000)::DOUBLE AS amount, CAST(event_id AS VARCHAR) AS s FROM events),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, kind ORDER BY id) - 1 AS INTEGER) AS n FROM e)"""


def _double(df):
    return df.withColumn("amount", F.col("amount").cast("double"))


@query("""SELECT doc, 'ledger' AS part, n, date, amount, 'Dep ' || s || CASE WHEN id % 3 = 0 THEN ' ref ' || s ELSE '' END AS description FROM n WHERE kind = 'credit' AND doc % 3 = 0
 UNION ALL SELECT doc, 'posted', n, date, amount, 'Dep ' || s || CASE WHEN id % 3 = 0 THEN ' ref ' || s ELSE '' END FROM n WHERE kind = 'credit' AND doc % 3 = 1
 UNION ALL SELECT doc, 'transfers', CAST(row_number() OVER (PARTITION BY doc ORDER BY id % 2, id) - 1 AS INTEGER), date, amount, 'Dep ' || s FROM n WHERE kind = 'credit' AND doc % 3 = 2""", EVENTS)
def statement_deposits(spark, d):
    return _double(ops.deposits(_statements(spark, d), "doc", "text"))


DEBITS = """SELECT doc, 'withdrawn' AS part, n, date, amount, NULL AS check_no, 'Pay ' || s || CASE WHEN id % 3 = 0 THEN ' ref ' || s ELSE '' END AS description FROM n WHERE kind = 'debit' AND doc % 3 = 0
 UNION ALL SELECT doc, 'paid', n, date, amount, CAST(100000 + id AS VARCHAR), NULL FROM n WHERE kind = 'check' AND doc % 3 = 0
 UNION ALL SELECT doc, 'posted', n, date, amount, CASE WHEN id % 3 < 2 THEN s END, CASE id % 3 WHEN 0 THEN 'Check Check No: ' || s WHEN 1 THEN 'Check No: ' || s ELSE 'Fee' END FROM n WHERE kind = 'debit' AND doc % 3 = 1
 UNION ALL SELECT doc, 'processed', n, date, amount, CAST(100000 + id AS VARCHAR), NULL FROM n WHERE kind = 'check' AND doc % 3 = 1
 UNION ALL SELECT doc, 'columns', n, date, amount, NULL, CASE WHEN n = 0 THEN '2 transactions for a total' ELSE (SELECT 'Pay ' || p.s FROM n p WHERE p.kind = 'debit' AND p.doc = n.doc AND p.n = n.n - 1) END FROM n WHERE kind = 'debit' AND doc % 3 = 2 AND n < 2
 UNION ALL SELECT doc, 'summary', n, date, amount, CAST(100000 + id AS VARCHAR), NULL FROM n WHERE kind = 'check' AND doc % 3 = 2"""


@query(DEBITS, EVENTS)
def statement_debits(spark, d):
    return _double(ops.debits(_statements(spark, d), "doc", "text"))


@query(f"SELECT section, count(*) AS rows, sum(amount) AS amount FROM (SELECT 'debits' AS section, amount FROM ({DEBITS}) UNION ALL SELECT 'deposits', amount FROM n WHERE kind = 'credit') GROUP BY 1", EVENTS)
def statement_sheet(spark, d):
    s = _statements(spark, d)
    sheet = ops.statement_sheet(ops.deposits(s, "doc", "text"), ops.debits(s, "doc", "text"))
    return sheet.groupBy("section").agg(F.count("*").alias("rows"), F.sum("amount").cast("double").alias("amount"))


@query("SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY id) - 1 AS INTEGER) AS n, date, amount FROM n WHERE id % 4 <> 0", EVENTS)
def daily_check_sums(spark, d):
    line = lambda r: F.concat(r["date"], F.when(r["id"] % 4 != 0, " Sum. 2 ").otherwise(" Sums 2 "), r["amount"], F.lit(" Summary"))
    s = _events(spark, d).select("doc", F.array_join(F.transform("rows", line), "\n").alias("text"))
    return _double(ops.daily_check_sums(s, "doc", "text"))


LAYOUTS = ("ledger", "card", "signs", "ends", "head", "totals", "words")


@query("""SELECT c_custkey, CASE WHEN k <> 5 THEN a END AS opening_balance, CASE WHEN k <> 6 THEN CASE WHEN k = 3 THEN a + 2 ELSE a + 1 END END AS total_deposits, CASE WHEN k <> 6 THEN CASE WHEN k = 3 THEN a + 1 ELSE a + 2 END END AS total_withdrawals,
 CASE WHEN k IN (0, 2, 3) THEN a + 3 END AS total_checks, CASE WHEN k <> 5 THEN a + 4 END AS ending_balance FROM (SELECT c_custkey, c_custkey % 7 AS k, (1000 + c_custkey)::DOUBLE + 0.25 AS a FROM customer)""")
def statement_summary(spark, d):
    k = F.col("c_custkey")
    a = [F.format_number((k + 1000 + i).cast("double") + 0.25, 2) for i in range(5)]
    w = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = [
        w("Opening Ledger Balance $", a[0], "\nDeposits and Credits 3 $", a[1], "\nWithdrawals and Debits 2 $", a[2], " Checks Paid 1 $", a[3], "\nEnding Ledger Balance  $", a[4]),
        w("Previous Balance $", a[0], " Payments and Other Credits (-) $", a[1], " Purchases and Other Debits (+) $", a[2], " Fees\nNew Balance $", a[4]), w("Amount: ", a[0], "  ", a[1], " ", a[2], "- ", a[3], "- ", a[4]),
        w("Beginning Balance: $", a[0], " Ending Balance: $", a[4], "\nTotal Debits/Credits ", a[1], " ", a[2], "\nNumber Checks Paid: 4 Totaling: $", a[3]),
        w("Beginning Deposits and Checks and Ending\nbalance other credits other debits balance\n", a[0], " ", a[1], " ", a[2], " ", a[4]), w("Total 4 ", a[1], " Total 9 ", a[2]), w("Your opening balance: ", a[0], "\nNew BALANCE $", a[4]),
    ]
    text = F.get(F.array(*texts), (k % 7).cast("int"))
    s = readers.table(spark, d, "customer").select("c_custkey", extract.statement_summary(text).alias("s")).select("c_custkey", "s.*")
    return s.withColumns({c: F.col(c).cast("double") for c in extract.STATEMENT})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN 'XX-' || CAST(c_custkey AS VARCHAR) END AS account_number, CASE c_custkey % 3 WHEN 0 THEN '01/01/2026' WHEN 1 THEN 'January 01, 2026' END AS period_start,
 CASE c_custkey % 3 WHEN 0 THEN '01/31/2026' WHEN 1 THEN 'march 30, 2026' END AS period_end FROM customer""")
def statement_metadata(spark, d):
    k = F.col("c_custkey")
    period = F.when(k % 3 == 0, "For the period  01/01/2026 to 01/31/2026").when(k % 3 == 1, "January 01, 2026 through march 30, 2026").otherwise("For the period of 2026")
    text = F.concat(F.when(k % 3 != 2, F.concat(F.lit("Account number: XX-"), k.cast("string"))).otherwise("Account"), F.lit("\n"), period)
    return readers.table(spark, d, "customer").select("c_custkey", extract.statement_metadata(text).alias("m")).select("c_custkey", "m.*")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0, CASE WHEN event_id % 3 <> 0 THEN event_id END, strftime(ts, '%m/%d'), CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END, event_id) AS place FROM events")
def validation_order(spark, d):
    e = readers.table(spark, d, "events").withColumn("idx", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    balance = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("n/a")
    w = Window.partitionBy("user_id").orderBy(*ops.validation_order(F.col("idx"), F.date_format("ts", "MM/dd"), balance), "event_id")
    return e.select("event_id", F.row_number().over(w).alias("place"))


@query("""SELECT c_custkey, '## ' || CAST(c_custkey AS VARCHAR) || chr(10) || '**Status:** ' || CASE WHEN c_custkey % 2 = 0 THEN 'OK' ELSE 'MISMATCH' END || chr(10) || '| Category | Extracted | Summary Found |' || chr(10) || '| :--- | :--- | :--- |' || chr(10) ||
 '| Deposits | $' || printf('%.2f', c_custkey::DOUBLE) || ' | $' || printf('%.2f', CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey + 0.5 END::DOUBLE) || ' |' || chr(10) || '| Debits | $1.00 | $0.00 |' || chr(10) || '| Checks | $0.00 | $0.00 |' || chr(10) || '| Opening Bal | - | $7.25 |' || chr(10) || '| Ending Bal | - | $0.00 |' AS report FROM customer""")
def verification_report(spark, d):
    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    c = readers.table(spark, d, "customer").select(
        "c_custkey", F.when(k % 2 == 0, "OK").otherwise("MISMATCH").alias("status"), k.cast("double").alias("deposits"), F.lit(1.0).alias("debits"), none.alias("checks"), F.when(k % 3 != 0, k + 0.5).alias("total_deposits"),
        none.alias("total_withdrawals"), none.alias("total_checks"), F.lit(7.25).alias("opening_balance"), none.alias("ending_balance"),
    )
    return ops.verification_report(c, "c_custkey")
