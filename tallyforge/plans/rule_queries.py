"""Queries of single rules: each is fed readings of every kind, and the SQL lists what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.money import cents
from ..operators import bank, claims as claim_ops, cleaning, documents as docs_ops, invoices, lines, monitoring, setops, workers_comp
from ..sources import readers
from . import bindings as b
from .catalog import query
from .invoice_queries import ROWS, _double, _rows, pick, sql_pick


def _customers(spark, d):
    return readers.table(spark, d, "customer")


def _sql(table: dict, name: str) -> str:
    return f"{sql_pick([None if v is None else str(v).replace(chr(39), chr(39) * 2) for v in table.values()], 'c_custkey')} AS {name}"


def _numbers(values: list) -> str:
    return "([" + ", ".join("NULL" if v is None else str(v) for v in values) + f"]::DOUBLE[])[c_custkey % {len(values)} + 1]"


#: A reading, and what each parser makes of it: sheet, signed, bracketed, claim, form, statement.
AMOUNTS = [
    ("$1,234.50", 1234.5, 1234.5, 1234.5, 1234.5, 1234.5, 1234.5), ("(12.00)", 0, -12, -12, 12, 12, -12), ("-", 0, 0, 0, 0, 0, None), ("nan", 0, 0, 0, 0, 0, None), (None, 0, 0, 0, 0, 0, None), ("", 0, 0, 0, 0, 0, None),
    ("7.25-", 0, 0, 0, 0, 0, -7.25), ("about 9", 0, 0, 9, 9, 9, None), (".50", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), ("-3", -3, -3, -3, -3, -3, -3), ("x(4)y", 0, 0, -4, 4, 4, None),
]
PARSERS = ("sheet", "signed_value", "bracketed", "claim", "form", "statement")


@query("SELECT c_custkey, " + ", ".join(f"{_numbers([a[i + 1] for a in AMOUNTS])} AS {n}" for i, n in enumerate(PARSERS)) + " FROM customer")
def money_cleaners(spark, d):
    t = pick([a[0] for a in AMOUNTS], F.col("c_custkey"))
    parsed = (money.sheet_money(t), money.signed_money(t), money.bracketed_money(t), money.claim_amount(t), money.form_number(t), money.statement_amount(t))
    return _customers(spark, d).select("c_custkey", *[v.alias(n) for v, n in zip(parsed, PARSERS, strict=True)])


DAYS = {
    "2026-01-05": "1/5/2026", "03/06/2026": "3/6/2026", "13/02/2026": "2/13/2026", "4-1-26": "4/1/2026", "February 19, 2026": "2/19/2026", "May 2026": "5/1/2026", "202604": "4/1/2026", "07/2026": "7/1/2026",
    "due on 2026/1/9 or so": "1/9/2026", "from 25/12/24 on": "12/25/2024", "on Sept. 9 2025": "9/9/2025", "tomorrow": "tomorrow", None: None,
}
YEARS = {"2019-20": 2019, "policy of 1998": 1998, "n/a": None, "2024": 2024, None: None}


@query(f"SELECT c_custkey, {_sql(DAYS, 'us')}, CAST({sql_pick(list(YEARS.values()), 'c_custkey')} AS INTEGER) AS claim_year FROM customer")
def date_cleaners(spark, d):
    k = F.col("c_custkey")
    return _customers(spark, d).select("c_custkey", dates.us_date(pick(list(DAYS), k)).alias("us"), dates.claim_year(pick(list(YEARS), k)).alias("claim_year"))


PEOPLE = {
    "Stone, Ann Marie B": ("Stone", "Ann", "Marie B"), "Ann M. Stone": ("Stone", "Ann", "M."), "Ann  Stone": ("Stone", "Ann", None), "Stone": ("Stone", None, None), "Stone,": ("Stone", None, None), "": (None, None, None), None: (None, None, None),
}
TURNED = {"John M. Smith": "Smith, John M.", "Smith, John": "Smith, John", "Cher": "Cher", "n/a": None, None: None}


@query("SELECT c_custkey, " + ", ".join(f"{sql_pick([v[i] for v in PEOPLE.values()], 'c_custkey')} AS {n}" for i, n in enumerate(("last", "first", "middle"))) + f", {_sql(TURNED, 'turned')} FROM customer")
def name_split(spark, d):
    k = F.col("c_custkey")
    return _customers(spark, d).select("c_custkey", text.name_parts(pick(list(PEOPLE), k)).alias("n"), text.last_first(pick(list(TURNED), k)).alias("turned")).select("c_custkey", "n.*", "turned")


CODES = {"C": "Closed", " cl ": "Closed", "RECLOSED": "Closed", "op": "Open", "r": "Reopened", "REOP": "Reopened", "pending": "PENDING", None: None}
INJURIES = {"TTD paid": "Indemnity", "med only": "Medical Only", "Expense": "Expense", "Other": "Other", None: None}
TIERS = {"E": "EE", "esc": "FAM", "E3D": "EC", "Employee and Spouse": "ES", "EMPLOYEE & TWO OR MORE DEPENDENTS": "EC", "F": "FAM", "PPO": "PPO", None: None}
SAID = {"Employee spouse and child": "FAM", "with dependents": "EC", "EE + Sp": "ES", "single": "EE", "pet": None}
SHEET = {"Emp + Ch": "EC", "EMP SP": "ES", "ee only": "EE", "Family": "FAM", "EE + SP 2": "ES", "12.50": None, "Employee": "EE", "children": "EC", "spouse": "ES", "other": "other"}
YES = {"y": "Yes", " TRUE ": "Yes", "1": "Yes", "no": "No", None: "No"}


@query(f"SELECT c_custkey, {_sql(CODES, 'status')}, {_sql(INJURIES, 'injury')}, {_sql(TIERS, 'tier')}, {_sql(SAID, 'said')}, {_sql(SHEET, 'sheet')}, {_sql(YES, 'yes')} FROM customer")
def status_map(spark, d):
    k = F.col("c_custkey")
    return _customers(spark, d).select(
        "c_custkey", text.claim_status(pick(list(CODES), k)).alias("status"), text.injury_type(pick(list(INJURIES), k)).alias("injury"), text.coverage(pick(list(TIERS), k)).alias("tier"), text.coverage_from_text(pick(list(SAID), k)).alias("said"),
        text.sheet_coverage(pick(list(SHEET), k)).alias("sheet"), text.yes_no(pick(list(YES), k)).alias("yes"),
    )


IDS = {"12345.0": "12345", "0000123": "123", "000012": "000012", " 77 ": "77", None: None}
INVOICES = {"000000005372": None, "0000027716": "27716", "260210001403": "260210001403", "00123": "00123", "A-0000123": "A-0000123"}
FILES = {'a/b:c*"d".pdf': "a_b_c__d_.pdf", "plain.pdf": "plain.pdf"}
GHOSTS = {"Doe, John": True, "Acme Corp": True, "Ann Stone": False, "Placeholder": True, "policy total row": True, "Quillfeather": False, None: False}
BUSINESS = {"Acme Inc": True, "Quillfeather": False, "the Insured": True, None: False}


def _flags(table: dict, name: str) -> str:
    return "[" + ", ".join(str(v).lower() for v in table.values()) + f"][c_custkey % {len(table)} + 1] AS {name}"


@query(f"SELECT c_custkey, {_sql(IDS, 'id')}, {_sql(INVOICES, 'invoice')}, {_sql(FILES, 'file')}, {_flags(GHOSTS, 'ghost')}, {_flags(BUSINESS, 'business')} FROM customer")
def id_rules(spark, d):
    k = F.col("c_custkey")
    return _customers(spark, d).select(
        "c_custkey", text.id_text(pick(list(IDS), k)).alias("id"), text.invoice_number(pick(list(INVOICES), k), F.lit(53.72)).alias("invoice"), text.file_name(pick(list(FILES), k)).alias("file"), text.stands_in(pick(list(GHOSTS), k)).alias("ghost"), text.is_corporate(pick(list(BUSINESS), k)).alias("business"),
    )


@query("SELECT doc_id, coalesce(string_agg(regexp_replace(trim(l, ' '), '\\s{3,}', ' | ', 'g'), chr(10) ORDER BY pos) FILTER (length(trim(l, ' ')) >= 2 AND length(regexp_replace(l, '[^a-zA-Z0-9]', '', 'g')) >= length(l) * 0.2), '') AS text FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text || chr(10) || '.... x ....' || chr(10) || 'a    b', chr(10)) AS ls FROM documents)) GROUP BY 1")
def clean_lines(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", docs_ops.clean_lines(F.concat("text", F.lit("\n.... x ....\na    b"))).alias("text"))


@query("SELECT event_id, CASE WHEN value <= 1 THEN 'fast' WHEN value <= 3 THEN 'average' ELSE 'slow' END AS level FROM events")
def time_levels(spark, d):
    return readers.table(spark, d, "events").select("event_id", monitoring.time_level(F.col("value")).alias("level"))


# ---------------------------------------------------------------- claims


@query("SELECT count(*) FILTER (n % 4 IN (0, 1)) AS open_claims, count(*) FILTER (n % 4 = 2) AS closed_claims FROM (SELECT l_orderkey * 10 + l_linenumber AS n FROM lineitem)")
def status_case(spark, d):
    """Status is compared without regard to case and spaces."""
    li = readers.table(spark, d, "lineitem")
    status = pick(["OPEN", " Open ", "closed", "Reopened"], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    c = li.select(status.alias("status"), F.lit(1).cast("decimal(18,2)").alias("incurred"), F.lit(1).cast("decimal(18,2)").alias("paid"), F.lit(1).cast("decimal(18,2)").alias("reserve"), F.lit(False).alias("litigated"))
    return claim_ops.executive_summary(c).select("open_claims", "closed_claims")


@query("SELECT claim_number, l_partkey, l_suppkey FROM claims WHERE abs(round(paid + reserve + (l_linenumber % 3) * 0.05 - incurred, 2)) <= 0.1", b.CLAIMS)
def math_valid_claims(spark, d):
    c = b.claims(spark, d)
    extra = ((F.col("l_linenumber") % 3) * 0.05).cast("decimal(18,2)")
    return cleaning.math_valid(c, [F.col("paid"), F.col("reserve"), extra], F.col("incurred"), 0.1).select("claim_number", "l_partkey", "l_suppkey")


@query("SELECT count(*) AS claims, count(*) FILTER (l_linenumber % 3 <> 0) AS valid, round(count(*) FILTER (l_linenumber % 3 <> 0) * 100.0 / count(*), 1) AS score FROM lineitem")
def claim_quality(spark, d):
    return cleaning.quality_score(readers.table(spark, d, "lineitem"), F.col("l_linenumber") % 3 != 0)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 50.5 ELSE sum(coalesce(l_quantity, 0)) END AS premium FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def total_premiums(spark, d):
    li = readers.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("string").alias("premium"))).alias("ratings"))
    calculated = F.when(F.col("l_orderkey") % 2 == 0, "50.5").when(F.col("l_orderkey") % 3 == 0, "0")
    return li.select(F.col("l_orderkey").alias("o_orderkey"), workers_comp.total_premium(calculated, F.col("ratings"), "premium").alias("premium"))


@query("SELECT c_custkey, 'prior' AS part, c_name AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer UNION ALL SELECT c_custkey, 'people', x, 'role' FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS x FROM customer) UNION ALL SELECT c_custkey, 'who', c_name, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'general', 'q1', 'Y' FROM customer UNION ALL SELECT c_custkey, 'demographics', c_mktsegment, 'x' FROM customer")
def wc_tables(spark, d):
    """An application's five parts: two lists, two structs and the answers."""
    c = _customers(spark, d)
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    docs = c.select(
        "c_custkey", F.array(pair(F.col("c_name"), F.col("c_nationkey").cast("string"))).alias("prior"), F.array(pair(F.col("c_name"), F.lit("role")), pair(F.col("c_mktsegment"), F.lit("role"))).alias("people"), pair(F.col("c_name"), F.col("c_mktsegment")).alias("who"),
        pair(F.col("c_mktsegment"), F.lit("x")).alias("demographics"), F.create_map(F.lit("q1"), F.lit("Y")).alias("general"),
    )
    t = workers_comp.flatten(docs, "c_custkey", ["prior", "people"], ["who", "demographics"], ["general"])
    return setops.union_all([df.toDF("c_custkey", "a", "b").withColumn("part", F.lit(n)) for n, df in t.items()]).select("c_custkey", "part", "a", "b")


@query("""SELECT doc, n * 3 + x.p AS pos, x.line AS line FROM (SELECT user_id AS doc, event_id AS n FROM events) e, LATERAL (SELECT unnest(CASE n % 3 WHEN 0 THEN [{'p': 1, 'line': '012 7380 IN    $' || CAST(n AS VARCHAR) || '    0.000 $0.00'}, {'p': 2, 'line': 'text'}]
 WHEN 1 THEN [{'p': 0, 'line': '011 8810 IL    $' || CAST(n AS VARCHAR) || '    1,407'}, {'p': 2, 'line': '. .'}] ELSE [{'p': 0, 'line': 'note'}, {'p': 1, 'line': '$5'}, {'p': 2, 'line': 'end of page'}] END) AS x)""")
def stitched_lines(spark, d):
    """Amounts above their row, below it, and where there is no row."""
    e = readers.table(spark, d, "events")
    k, amount = F.col("event_id") % 3, F.concat(F.lit("$"), F.col("event_id").cast("string"))
    three = F.when(k == 0, F.array(amount, F.lit("012 7380 IN    0.000 $0.00"), F.lit("text"))).when(k == 1, F.array(F.lit("011 8810 IL"), F.concat(F.lit("  "), amount), F.lit("1,407"))).otherwise(F.array(F.lit("note"), F.lit("$5"), F.lit("end of page")))
    rows = e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), F.posexplode(three).alias("p", "line")).select("doc", (F.col("n") * 3 + F.col("p")).alias("pos"), "line")
    stop = e.where(k == 1).select(F.col("user_id").alias("doc"), (F.col("event_id") * 3 + 2).alias("pos"), F.lit(". .").alias("line"))
    # a line that is no row stands between one event's lines and the next one's
    gaps = rows.withColumn("pos", F.col("pos") * 2).unionByName(stop.withColumn("pos", F.col("pos") * 2 + 1))
    out = workers_comp.stitched_lines(gaps, "doc", "pos", "line")
    return out.select("doc", F.floor(F.col("pos") / 2).alias("pos"), "line")


# ---------------------------------------------------------------- invoices and banks


@query("""SELECT plan, current::DOUBLE AS current FROM r WHERE coalesce(plan, '') NOT IN ('Total Pet Care', 'Subscriber Total') UNION ALL SELECT 'CALCULATED GRAND TOTAL', sum(current)::DOUBLE FROM r WHERE coalesce(plan, '') NOT IN ('Total Pet Care', 'Subscriber Total')
 UNION ALL SELECT plan, current::DOUBLE FROM r WHERE coalesce(plan, '') NOT IN ('Total Pet Care', 'Subscriber Total') UNION ALL SELECT 'REPORTED GRAND TOTAL', max(current)::DOUBLE FROM r WHERE plan = 'Vision'""", ROWS)
def grand_totals(spark, d):
    """Once without a reported total, once with some."""
    r = _rows(spark, d)
    more = r.where("plan = 'Vision'").withColumn("plan", F.lit("Reported Invoice Total"))
    return _double(invoices.grand_total(r, "plan", "current").unionByName(invoices.grand_total(r.unionByName(more), "plan", "current")), "current")


@query("""SELECT field, rate, rate > lim AS over FROM (SELECT 'member' AS field, avg((coalesce(trim(member), '') = '')::INT) AS rate, 0.5 AS lim FROM r UNION ALL SELECT 'plan', avg((coalesce(trim(plan), '') = '')::INT), 0.05 FROM r UNION ALL SELECT 'current', avg((current IS NULL)::INT), 0.5 FROM r)""", ROWS)
def flagged_rates(spark, d):
    rates = invoices.missing_rates(_rows(spark, d), ["member", "plan", "current"])
    return invoices.flagged_rates(rates, {"member": 0.5, "plan": 0.05, "current": 0.5})


PLACE = """(l IN ('MISSING', 'PARTICIPANT', 'SPOUSE') AND f = 'FROM_PREVIOUS_PAGE' OR l = 'MISSING' OR f = 'FROM_PREVIOUS_PAGE' OR (l IN ('PARTICIPANT', 'SPOUSE') AND f = '') OR (f = '' AND l = '') OR ((f = '' OR l IN ('', 'PARTICIPANT', 'MISSING')) AND coalesce(current, 0) <> 0))"""
ORPHAN_LASTS, ORPHAN_FIRSTS = ["Ray", "MISSING", "Stone", "Spouse", "", "Participant", "Lopez"], ["Ann", "FROM_PREVIOUS_PAGE", "", "Bo"]


@query(f"""SELECT n, CASE WHEN pl THEN person.l0 ELSE last END AS last, CASE WHEN pl THEN person.f0 ELSE first END AS first, CASE WHEN pl THEN person.m0 ELSE member END AS member, pl AS repaired FROM (SELECT *, last_value(CASE WHEN NOT pl AND NOT tot AND l NOT IN ('', 'MISSING') THEN {{'l0': last, 'f0': first, 'm0': member}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS person
 FROM (SELECT *, {PLACE} AS pl, coalesce(regexp_matches(upper(plan), 'TOTAL|AMOUNT DUE'), false) AS tot FROM (SELECT doc, n, plan, member, current, {sql_pick(ORPHAN_LASTS, 'n')} AS last, {sql_pick(ORPHAN_FIRSTS, 'n')} AS first, upper({sql_pick(ORPHAN_LASTS, 'n')}) AS l, upper({sql_pick(ORPHAN_FIRSTS, 'n')}) AS f FROM r))) WHERE NOT pl OR (NOT tot AND person IS NOT NULL)""", ROWS)
def placeholder_repair(spark, d):
    r = _rows(spark, d).withColumns({"last": pick(ORPHAN_LASTS, F.col("n")), "first": pick(ORPHAN_FIRSTS, F.col("n"))})
    return invoices.repair_placeholders(r, "doc", "n", "last", "first", "plan", ["current"], ["member"]).select("n", "last", "first", "member", "repaired")


MEMOS = ["Card purchase", "Ledger balance forward", "12 1,000.25", "12 1000.25 paid", "12 9,999.25", "Page 3", "ach debits list", "======================", "Rent"]


@query("SELECT event_id, k IN (1, 5, 7) OR big AS deposit, k IN (1, 2, 3, 5, 6, 7) OR big AS debit FROM (SELECT event_id, event_id % 9 AS k, event_id % 50 = 0 AS big FROM events)")
def summary_rules(spark, d):
    k = F.col("event_id")
    amount = F.when(k % 50 == 0, 9000000).otherwise(F.lit(1000.25)).cast("decimal(18,2)")
    e = readers.table(spark, d, "events").select("event_id", pick(MEMOS, k).alias("memo"), amount.alias("amount"))
    # the large ones have an amount of their own, so that no memo repeats it
    return e.select("event_id", bank.summary_line(F.col("memo"), F.col("amount"), 8e6).alias("deposit"), bank.summary_line(F.col("memo"), F.col("amount"), 5e6, bank.DEBIT_SUMMARY_WORDS, by_count=True).alias("debit"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'amount should be 30.00' WHEN event_id % 4 = 1 THEN 'sign reversed' END AS note FROM events""")
def audit_notes(spark, d):
    """A statement for each event: an opening of 100, an amount of 20, and a printed balance
    that is off, or has the sign turned, or agrees, or is not there."""
    k = F.col("event_id") % 4
    tx = readers.table(spark, d, "events").select("event_id", F.lit("Deposit").alias("description"), F.lit(20).cast("decimal(18,2)").alias("amount"), F.when(k == 0, 130).when(k == 1, 80).when(k == 2, 120).cast("decimal(18,2)").alias("running_balance"))
    return bank.audit_balance(tx, "event_id", ["event_id"], F.lit(100).cast("decimal(18,2)")).select("event_id", "note")


# ---------------------------------------------------------------- logs and sets


@query("SELECT filename, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS cost, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds, max(ts) AS last_seen FROM (SELECT *, 'user' || CAST(user_id AS VARCHAR) AS filename, event_id % 100 AS t FROM events) GROUP BY filename")
def usage_by_file(spark, d):
    e = readers.table(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("filename"), (F.col("event_id") % 100).alias("total_tokens"), cents(F.col("value")).alias("total_cost"), "event_type", "ts")
    return monitoring.usage_details(e, ["filename"], "event_type", "ts").withColumn("cost", F.col("cost").cast("double"))


@query("WITH c AS (SELECT user_id, avg(value) AS confidence FROM events GROUP BY 1) SELECT user_id, confidence FROM c UNION ALL SELECT NULL, avg(confidence) FROM c")
def mean_confidence(spark, d):
    return monitoring.mean_confidence(readers.table(spark, d, "events"), "user_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type NOT IN ('purchase', 'error')")
def active_requests(spark, d):
    return monitoring.active_requests(readers.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ("purchase", "error")).select("user_id", "event_id")


@query("""SELECT k, p.path AS path, p.old AS old, p.new AS new, CASE WHEN p.old IS NULL THEN 'added' WHEN p.new IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS q FROM orders) o, LATERAL (SELECT unnest([
 {'path': 'a.b.status', 'old': s, 'new': CASE WHEN k % 3 = 0 THEN 'X' ELSE s END}, {'path': 'a.c', 'old': CASE WHEN k % 4 <> 0 THEN q END, 'new': q}, {'path': 'l[0]', 'old': 'x', 'new': 'x'}, {'path': 'l[1]', 'old': s, 'new': CASE WHEN k % 2 = 0 THEN s END}]) AS p) WHERE p.old IS DISTINCT FROM p.new""")
def nested_diff(spark, d):
    o = readers.table(spark, d, "orders")
    k, s, q = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    record = lambda st, c, l: o.select(k.alias("k"), F.struct(F.struct(st.alias("status")).alias("b"), c.alias("c")).alias("a"), l.alias("l"))
    return setops.nested_diff(record(s, F.when(k % 4 != 0, q), F.array(F.lit("x"), s)), record(F.when(k % 3 == 0, "X").otherwise(s), q, F.when(k % 2 == 0, F.array(F.lit("x"), s)).otherwise(F.array(F.lit("x")))), "k")


MATCHES = """l AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS VARCHAR) END AS id, CASE WHEN event_id % 3 = 1 THEN 'S' || CAST(event_id % 70 AS VARCHAR) END AS ssn, ['Ann', 'Bo', 'Kim'][event_id % 3 + 1] AS f, ['Ray', 'Stone', 'Vega', 'Lo'][event_id % 4 + 1] AS n FROM events),
r AS (SELECT c_custkey AS id0, CASE WHEN c_custkey % 2 = 0 THEN '000' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS id, 's-' || CAST(c_custkey AS VARCHAR) AS ssn, ['ann', 'KIM'][c_custkey % 2 + 1] AS f, ['RAY', 'vega', 'none'][c_custkey % 3 + 1] AS n FROM customer),
m AS (SELECT k, min(CASE WHEN l.id = r.id THEN id0 END) AS a, min(CASE WHEN l.ssn = r.ssn THEN id0 END) AS b, min(CASE WHEN l.id = ltrim(r.id, '0') THEN id0 END) AS c, min(CASE WHEN l.ssn = upper(replace(r.ssn, '-', '')) THEN id0 END) AS d, min(CASE WHEN lower(l.f) = lower(r.f) AND lower(l.n) = lower(r.n) THEN id0 END) AS e FROM l, r GROUP BY k)"""


@query("SELECT k, coalesce(a, b, c, d, e) AS match, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'ssn' WHEN c IS NOT NULL THEN 'loose id' WHEN d IS NOT NULL THEN 'loose ssn' ELSE 'name' END AS rule FROM m WHERE coalesce(a, b, c, d, e) IS NOT NULL", MATCHES)
def person_match(spark, d):
    """All five rules in a row: id and number as they are, then loosely, then by name."""
    k, c = F.col("event_id"), F.col("c_custkey")
    left = readers.table(spark, d, "events").select(k.alias("k"), F.when(k % 3 == 0, (k % 90).cast("string")).alias("pid"), F.when(k % 3 == 1, F.concat(F.lit("S"), (k % 70).cast("string"))).alias("ssn"), pick(["Ann", "Bo", "Kim"], k).alias("f"), pick(["Ray", "Stone", "Vega", "Lo"], k).alias("n"))
    right = _customers(spark, d).select(c.alias("id"), F.when(c % 2 == 0, F.concat(F.lit("000"), c.cast("string"))).otherwise(c.cast("string")).alias("pid"), F.concat(F.lit("s-"), c.cast("string")).alias("ssn"), pick(["ann", "KIM"], c).alias("f"), pick(["RAY", "vega", "none"], c).alias("n"))
    own = lambda x: (F.col(x), F.col(x))
    loose = lambda x: (text.plain(text.zero_stripped(F.col(x))),) * 2
    return lines.cascade_match(left, right, "k", [("id", *own("pid")), ("ssn", *own("ssn")), ("loose id", *loose("pid")), ("loose ssn", *loose("ssn")), ("name", *(text.name_key(F.col("f"), F.col("n")),) * 2)])
