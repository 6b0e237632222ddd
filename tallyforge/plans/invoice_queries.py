"""Queries of premium invoices: totals, headers, fees, classes of rows, names and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import plans
from ..operators import invoices as ops
from ..sources import readers
from .catalog import query


def pick(values: list, k: Column) -> Column:
    """One of ``values`` by a number, in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))


def sql_pick(values: list, k: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{k} % {len(values)} + 1]"


FIRSTS = ["Ann", "Bo", "", "Grand Total", None, "J", "Reported Invoice Total", "Kim Lee"]
LASTS = ["Ray", "Credit/Fee", "Stone", None, "Total", "Lopez", "Balance Due now"]
PLANS = ["Dental PPO", "Amount Due", None, "Total Pet Care", "Vision", "Billing Fee", "Subscriber Total", "Life", "Invoiced Amount", "Surplus Reimbursement", "Packaged Savings"]
KINDS = ["EE", "FEES", None, "LIFE", "nan"]
IDS = ["1014", "", "7009", None, "123456789", "88", "***42"]
SSNS = ["4111", "***42", None, "88", "000000000"]


def _rows(spark, d):
    """A premium row per event: a document per user, with odd names, plans, kinds and ids."""
    e = readers.table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc"), k.alias("n"), pick(FIRSTS, k).alias("first"), pick(LASTS, k).alias("last"), pick(PLANS, k).alias("plan"), pick(KINDS, k).alias("kind"), pick(IDS, k).alias("member"), pick(SSNS, k).alias("ssn"),
        F.when(k % 6 != 0, F.when(k % 4 == 1, 25).otherwise(F.round("value", 0))).cast("decimal(18,2)").alias("current"), F.when(k % 3 == 0, F.round("value", 1)).cast("decimal(18,2)").alias("adjustment"),
        pick(["EE", "FAM", None], k).alias("tier"), pick([None, "2026-01-15", "02/01/2026", ""], k).alias("own_date"),
        F.when(k % 9 == 0, "0").when(k % 13 == 0, F.concat(F.lit("$1,"), F.lpad(F.pmod(k, F.lit(1000)).cast("string"), 3, "0"), F.lit(".50"))).alias("stated"),
        pick(["I1", "I2", None, "I1"], F.col("user_id") + F.when(F.col("user_id") % 3 == 0, 2).otherwise(k)).alias("invoice"), F.when(k % 5 == 0, F.round("value", 0)).cast("decimal(18,2)").alias("due"),
        F.when(F.col("user_id") % 2 == 0, 77).cast("decimal(18,2)").alias("header_due"),
    )


ROWS = f"""r AS (SELECT user_id AS doc, event_id AS n, {sql_pick(FIRSTS, 'event_id')} AS first, {sql_pick(LASTS, 'event_id')} AS last, {sql_pick(PLANS, 'event_id')} AS plan, {sql_pick(KINDS, 'event_id')} AS kind,
 {sql_pick(IDS, 'event_id')} AS member, {sql_pick(SSNS, 'event_id')} AS ssn, CASE WHEN event_id % 6 <> 0 THEN CASE WHEN event_id % 4 = 1 THEN 25 ELSE round(value, 0) END END::DECIMAL(18,2) AS current,
 CASE WHEN event_id % 3 = 0 THEN round(value, 1) END::DECIMAL(18,2) AS adjustment, {sql_pick(["EE", "FAM", None], 'event_id')} AS tier, {sql_pick([None, "2026-01-15", "02/01/2026", ""], 'event_id')} AS own_date,
 CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 1000 + event_id % 1000 + 0.5 END AS stated, ['I1', 'I2', NULL, 'I1'][(user_id + CASE WHEN user_id % 3 = 0 THEN 2 ELSE event_id END) % 4 + 1] AS invoice,
 CASE WHEN event_id % 5 = 0 THEN round(value, 0) END::DECIMAL(18,2) AS due, CASE WHEN user_id % 2 = 0 THEN 77 END::DECIMAL(18,2) AS header_due FROM events)"""


def _double(df, *names):
    return df.withColumns({c: F.col(c).cast("double") for c in names})


@query("""SELECT plan, current::DOUBLE AS current, adjustment::DOUBLE AS adjustment FROM r UNION ALL SELECT 'TOTAL CURRENT PREMIUM', sum(current)::DOUBLE, NULL FROM r
 UNION ALL SELECT 'TOTAL ADJUSTMENTS', NULL, sum(adjustment)::DOUBLE FROM r UNION ALL SELECT 'GRAND TOTAL', (sum(current) + sum(adjustment))::DOUBLE, NULL FROM r""", ROWS)
def three_totals(spark, d):
    return _double(ops.three_totals(_rows(spark, d).select("plan", "current", "adjustment"), "plan", "current", "adjustment"), "current", "adjustment")


RANK = "CASE WHEN up LIKE '%AMOUNT DUE%' THEN 0 WHEN up LIKE '%INVOICED AMOUNT%' THEN 1 WHEN up LIKE '%BALANCE DUE%' THEN 2 WHEN up LIKE '%REPORTED INVOICE TOTAL%' THEN 3 WHEN up LIKE '%GRAND TOTAL%' THEN 4 END"


@query(f"""SELECT doc, coalesce((SELECT stated::DECIMAL(18,2) FROM r b WHERE b.doc = a.doc AND stated > 0 ORDER BY n LIMIT 1), (SELECT current FROM (SELECT *, {RANK} AS rk FROM (SELECT *, upper(concat_ws('|', plan, first)) AS up FROM r)) b WHERE b.doc = a.doc AND current > 0 AND rk IS NOT NULL ORDER BY rk, n DESC LIMIT 1),
 sum(CASE WHEN coalesce(first, '') <> '' THEN coalesce(current, 0) END), 0)::DOUBLE AS display_total FROM r a GROUP BY doc""", ROWS)
def display_total(spark, d):
    return ops.display_total(_rows(spark, d), "doc", "n", "stated", "plan", "first", "current")


@query("""SELECT doc, max(CASE WHEN current > 0 THEN current END)::DOUBLE AS current, (array_agg(kind ORDER BY n) FILTER (kind IS NOT NULL AND lower(kind) NOT IN ('n/a', 'none', '')))[1] AS kind,
 (array_agg(member ORDER BY n) FILTER (member IS NOT NULL AND member <> ''))[1] AS member FROM r GROUP BY doc""", ROWS)
def header_merge(spark, d):
    return _double(ops.merged_header(_rows(spark, d), "doc", "n", ["current"], ["kind", "member"]), "current")


@query("""SELECT n, coalesce(nullif(tier, ''), h.tier2) AS tier, coalesce(CASE WHEN invoice = 'I1' THEN 500 END, due)::DOUBLE AS due FROM r LEFT JOIN (SELECT doc, 'T' || CAST(doc AS VARCHAR) AS tier2 FROM r WHERE doc % 4 <> 0 GROUP BY doc) h USING (doc)""", ROWS)
def header_injection(spark, d):
    r = _rows(spark, d)
    headers = r.select("doc").distinct().select("doc", F.when(F.col("doc") % 4 != 0, F.concat(F.lit("T"), F.col("doc").cast("string"))).otherwise("N/A").alias("tier"))
    dues = spark.range(1).select(F.lit("I1").alias("invoice"), F.lit(500).cast("decimal(18,2)").alias("amount"))
    return _double(ops.inject_headers(r, headers, "doc", ["tier"], "invoice", "due", dues).select("n", "tier", "due"), "due")


@query("""SELECT doc, CASE WHEN adds AND inv <> 'global' THEN inv END AS invoice, CASE WHEN adds THEN amount ELSE hd END::DOUBLE AS current FROM (
 SELECT *, max(adds) OVER w AS any_added, max(inplan) OVER w AS any_total, row_number() OVER (PARTITION BY doc ORDER BY inv) AS rn FROM (
 SELECT *, (count(*) OVER (PARTITION BY doc) > 1 OR inv <> 'global') AND NOT has AND amount > 0 AS adds FROM (
 SELECT doc, coalesce(invoice, 'global') AS inv, max(coalesce(due, 0)) AS amount, bool_or(coalesce(upper(plan), '') LIKE '%TOTAL%' OR coalesce(upper(first), '') LIKE '%TOTAL%') AS has, bool_or(coalesce(upper(plan), '') LIKE '%TOTAL%') AS inplan,
 max(header_due) AS hd FROM s GROUP BY 1, 2)) WINDOW w AS (PARTITION BY doc)) WHERE adds OR (NOT any_added AND NOT any_total AND rn = 1 AND coalesce(hd, 0) > 0)""",
       ROWS + ", s AS (SELECT * REPLACE (CASE WHEN doc % 5 < 3 AND plan LIKE '%Total%' THEN NULL ELSE plan END AS plan, CASE WHEN doc % 5 < 3 AND first LIKE '%Total%' THEN 'Zoe' ELSE first END AS first, CASE WHEN doc % 5 = 1 THEN NULL ELSE due END AS due) FROM r)")
def synthetic_totals(spark, d):
    quiet = F.col("doc") % 5 < 3
    r = _rows(spark, d)
    r = r.withColumns({
        "plan": F.when(~(quiet & F.coalesce(F.col("plan").contains("Total"), F.lit(False))), F.col("plan")), "first": F.when(quiet & F.col("first").contains("Total"), "Zoe").otherwise(F.col("first")), "due": F.when(F.col("doc") % 5 != 1, F.col("due")),
    })
    return _double(ops.synthetic_totals(r, "doc", "invoice", "due", "plan", "first", "current", "header_due").select("doc", "invoice", "current"), "current")


@query("SELECT o_custkey AS doc, list(o_orderkey ORDER BY o_orderkey) AS numbers, CAST(count(*) AS INTEGER) AS invoices, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total_value FROM orders GROUP BY 1")
def vendor_invoices(spark, d):
    o = readers.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("amount")))).alias("invoices"))
    return ops.invoice_list(o, "doc", "invoices", "number", "amount")


@query("""SELECT doc, sum((coalesce(trim(ssn) NOT IN ('', 'null', 'None'), false))::INT + (coalesce(trim(kind) NOT IN ('', 'null', 'None'), false))::INT + (coalesce(trim(last) NOT IN ('', 'null', 'None'), false))::INT
 + (coalesce(current, 0) <> 0 OR coalesce(adjustment, 0) <> 0)::INT) / (count(*) * 4) AS fill_rate FROM r GROUP BY doc""", ROWS)
def fill_rate(spark, d):
    return ops.fill_rate(_rows(spark, d), "doc", ["ssn", "kind", "last"], ["current", "adjustment"])


@query("SELECT doc, count(*) AS rows, coalesce(sum(current), 0)::DOUBLE AS subtotal FROM r WHERE lower(last) LIKE '%ray%' GROUP BY doc UNION ALL SELECT NULL, count(*), coalesce(sum(current), 0)::DOUBLE FROM r WHERE lower(last) LIKE '%ray%'", ROWS)
def member_audit(spark, d):
    return ops.member_audit(_rows(spark, d), "doc", "last", "RAY", "current")


HIT = "regexp_matches(upper(coalesce({c}, '')), '\\b(TOTAL|SUMMARY|SUBTOTAL|BALANCE DUE|GRAND TOTAL|INVOICE TOTAL)\\b') AND upper(coalesce({c}, '')) NOT LIKE '%TOTAL PET%'"
KEEP = "upper(coalesce({c}, '')) LIKE '%REPORTED INVOICE TOTAL%'"
BLANK = "lower(coalesce({c}, '')) IN ('', 'none', 'nan')"


@query("SELECT n FROM r WHERE NOT (CASE " + " ".join(f"WHEN {HIT.format(c=c)} THEN NOT ({KEEP.format(c=c)})" for c in ("first", "last", "plan")) + " ELSE " + " AND ".join(BLANK.format(c=c) for c in ("first", "last", "plan")) + " AND current IS NOT NULL END)", ROWS)
def summary_rows(spark, d):
    return _rows(spark, d).where(~ops.summary_row(["first", "last", "plan"], "first", "last", "plan", "current")).select("n")


HEADS = ["Ray", " Last Name ", "NAME", None, "lastname", "Stone"]


@query(f"SELECT c_custkey FROM customer WHERE c_custkey % 6 IN (0, 3, 5)")
def header_echo_rows(spark, d):
    c = readers.table(spark, d, "customer").withColumn("last", pick(HEADS, F.col("c_custkey")))
    return c.where(~ops.header_echo(F.col("last"))).select("c_custkey")


@query("SELECT n FROM r WHERE NOT (coalesce(member, '') LIKE '%123456789%' OR coalesce(ssn, '') LIKE '%000000000%')", ROWS)
def dummy_ids(spark, d):
    return _rows(spark, d).where(~ops.dummy_id(F.col("member"), F.col("ssn"))).select("n")


@query("""SELECT n FROM (SELECT *, count(pid) OVER (PARTITION BY doc, pid) AS c FROM (SELECT *, coalesce(nullif(upper(trim(member)), ''), nullif(upper(trim(ssn)), '')) AS pid FROM r))
 WHERE NOT (pid IS NOT NULL AND coalesce(plan, '') = 'Subscriber Total' AND c > 1)""", ROWS)
def subscriber_totals(spark, d):
    return ops.without_subscriber_totals(_rows(spark, d), "doc", ["member", "ssn"], "plan").select("n")


@query("""SELECT a.n AS n, min(b.c_custkey) AS match FROM (SELECT event_id AS n, ['j', 'John', 'A', 'Ann Marie', ''][event_id % 5 + 1] AS f, ['Ray', 'Stone', 'Vega'][event_id % 3 + 1] AS l FROM events) a
 JOIN (SELECT c_custkey, ['JOHN', 'Ann', 'annmarie', 'J', 'Bo'][c_custkey % 5 + 1] AS f, ['ray', 'STONE', 'Vega', 'Lo'][c_custkey % 4 + 1] AS l FROM customer) b ON lower(a.l) = lower(b.l)
 AND a.f <> '' AND (lower(replace(a.f, ' ', '')) = lower(replace(b.f, ' ', '')) OR (length(a.f) = 1 OR length(b.f) = 1) AND left(lower(a.f), 1) = left(lower(b.f), 1)) GROUP BY 1""")
def initial_match(spark, d):
    a = readers.table(spark, d, "events").select(F.col("event_id").alias("n"), pick(["j", "John", "A", "Ann Marie", ""], F.col("event_id")).alias("first"), pick(["Ray", "Stone", "Vega"], F.col("event_id")).alias("last"))
    b = readers.table(spark, d, "customer").select("c_custkey", pick(["JOHN", "Ann", "annmarie", "J", "Bo"], F.col("c_custkey")).alias("first"), pick(["ray", "STONE", "Vega", "Lo"], F.col("c_custkey")).alias("last"))
    return ops.initial_matches(a, b, "n", "c_custkey", "first", "last")


@query("""SELECT n, CASE WHEN noise AND member LIKE '101%' THEN 'Legal Plan' WHEN noise AND member LIKE '700%' THEN 'Identity Theft Plan' ELSE p END AS plan, CASE WHEN noise AND (member LIKE '101%' OR member LIKE '700%') THEN 'VOLUNTARY' ELSE kind END AS kind,
 CASE WHEN mv THEN 0 ELSE current END::DOUBLE AS current, CASE WHEN mv THEN current ELSE adjustment END::DOUBLE AS adjustment
 FROM (SELECT *, p IS NULL OR p = 'Invoice' AS noise, coalesce(own_date = '02/01/2026', false) AND coalesce(current, 0) <> 0 AND coalesce(adjustment, 0) = 0 AS mv FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'Invoice' ELSE plan END AS p FROM r))""", ROWS)
def legal_plan(spark, d):
    """The invoice's date is January 15, written otherwise than on its rows."""
    r = _rows(spark, d).withColumn("plan", F.when(F.col("n") % 2 == 0, "Invoice").otherwise(F.col("plan")))
    out = ops.legal_plans(r, "member", "plan", "kind", "current", "adjustment", ["own_date"], F.lit("2026/01/15"))
    return _double(out.select("n", "plan", "kind", "current", "adjustment"), "current", "adjustment")


@query("""SELECT n, is_fee, row_number() OVER (PARTITION BY doc ORDER BY is_fee, n) AS place, coalesce(nm, plan) AS plan, CASE WHEN nm IS NOT NULL THEN 'Credit/Fee' ELSE last END AS last FROM (
 SELECT *, row_number() OVER (PARTITION BY doc, is_fee, CASE WHEN nm = 'Billing Fee' THEN 'b' WHEN nm IS NOT NULL THEN nm || v ELSE 'other ' || coalesce(upper(plan), '') || v END ORDER BY n) AS c FROM (
 SELECT *, nm IS NOT NULL OR kind = 'FEES' OR last = 'Credit/Fee' AS is_fee0, coalesce(nm IS NOT NULL OR kind = 'FEES' OR last = 'Credit/Fee', false) AS is_fee FROM (
 SELECT *, CASE WHEN plan = 'Billing Fee' AND v = 25 THEN 'Billing Fee' WHEN plan = 'Surplus Reimbursement' THEN 'Surplus Reimbursement' WHEN plan = 'Packaged Savings' THEN 'Packaged Savings Credit' END AS nm
 FROM (SELECT *, coalesce(nullif(current, 0), adjustment, 0) AS v FROM r)))) WHERE NOT is_fee OR c = 1""", ROWS)
def fee_dedupe(spark, d):
    return ops.single_fees(_rows(spark, d), "doc", "n", "plan", "kind", "last", "first", "tier", "current", "adjustment").select("n", "is_fee", "place", "plan", "last")


@query("""SELECT n, CASE WHEN coalesce(member, '') <> '' AND coalesce(ssn, '') <> '' AND (member = ssn OR member LIKE '***%' AND ssn LIKE '***%') THEN NULL ELSE member END AS member,
 CASE WHEN p LIKE '%ACCIDENT%' THEN 'ACCIDENT' WHEN p LIKE '%CRITICAL%' THEN 'CRITICAL ILLNESS' WHEN p LIKE '%HOSPITAL%' THEN 'HOSPITAL INDEMNITY' WHEN p LIKE '%LIFE%' THEN 'LIFE' ELSE kind END AS kind
 FROM (SELECT *, upper(['Accident plus', 'Term life', 'Critical care', 'Hospital stay', 'Other', NULL][n % 6 + 1]) AS p FROM r)""", ROWS)
def colonial_rows(spark, d):
    p = pick(["Accident plus", "Term life", "Critical care", "Hospital stay", "Other", None], F.col("n"))
    return _rows(spark, d).select("n", ops.own_member_id(F.col("member"), F.col("ssn")).alias("member"), plans.plan_type(p, "colonial", F.col("kind")).alias("kind"))


def _words(c: str, words) -> str:
    return f"regexp_matches(upper(coalesce({c}, '')), '\\b({'|'.join(words)})\\b')"


CLASS = f"""CASE WHEN bw OR coalesce(current, 0) > 60 OR (nm AND NOT id AND NOT pl) OR (NOT nm AND NOT pl AND NOT fee) THEN 'total' WHEN fee THEN 'adjustment' ELSE 'member' END"""
CLASSED = ROWS + f""", c0 AS (SELECT *, coalesce(first, '') <> '' AND coalesce(last, '') <> '' AS nm, coalesce(member, '') <> '' AS id, coalesce(ssn, '') <> '' AS sn, coalesce(plan, '') <> '' AS pl FROM r),
c1 AS (SELECT *, ({_words('plan', ops.TOTAL_WORDS)} OR {_words('first', ops.TOTAL_WORDS)} OR {_words('last', ops.TOTAL_WORDS)}) AND coalesce(plan, '') NOT IN ('Total Pet Care', 'Subscriber Total') AND NOT ((id OR sn) AND nm) AS bw FROM c0),
c2 AS (SELECT *, NOT bw AND ({_words('plan', ops.FEE_WORDS)} OR {_words('last', ops.FEE_WORDS)} OR coalesce(kind, '') = 'FEES') AS fee FROM c1)"""


@query(f"SELECT n, cl AS row_class, row_number() OVER (PARTITION BY doc ORDER BY CASE cl WHEN 'member' THEN 0 WHEN 'adjustment' THEN 1 ELSE 2 END, n) AS place FROM (SELECT *, {CLASS} AS cl FROM c2)", CLASSED)
def row_partition(spark, d):
    return ops.partitioned(_rows(spark, d), "doc", "n", ops.row_class("plan", "first", "last", "member", "ssn", "kind", "current", 60)).select("n", "row_class", "place")


@query("SELECT n, row_number() OVER (PARTITION BY doc ORDER BY invoice NULLS LAST, last NULLS LAST, first NULLS LAST, n) AS place FROM r", ROWS)
def member_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy(*ops.member_order("invoice", "last", "first"), "n")
    return _rows(spark, d).select("n", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS empty FROM orders")
def empty_items(spark, d):
    k = F.col("o_orderkey")
    blank = F.array(F.struct(F.lit(" None ").alias("FIRSTNAME"), F.lit(None).cast("string").alias("PLAN_NAME")), F.struct(F.lit("").alias("FIRSTNAME"), F.lit("nan").alias("PLAN_NAME")))
    full = F.array(F.struct(F.lit("").alias("FIRSTNAME"), F.col("o_orderstatus").alias("PLAN_NAME")))
    o = readers.table(spark, d, "orders").withColumn("items", F.when(k % 3 != 0, full).when(k % 2 == 0, blank))
    return o.select("o_orderkey", ops.empty_items(F.col("items"), ["FIRSTNAME", "PLAN_NAME"]).alias("empty"))


@query("""SELECT n, trim(b) AS "PLAN_NAME", CASE WHEN b LIKE '%Accident%' THEN 'ACCIDENT' WHEN b LIKE '%dental%' THEN 'DENTAL' WHEN b LIKE '%LTD%' THEN 'LTD' WHEN b LIKE '%Medical%' THEN 'MEDICAL' ELSE 'OTHER' END AS "PLAN_TYPE",
 coalesce(current, 0)::DOUBLE AS "CURRENT_PREMIUM" FROM (SELECT *, ['Accident A', ' Basic dental ', 'LTD 60', 'Total', '', 'Benefit Description', 'Medical', 'Pet', NULL][n % 9 + 1] AS b FROM r) WHERE n % 9 IN (0, 1, 2, 6, 7)""", ROWS)
def benefit_rows(spark, d):
    names = ["Accident A", " Basic dental ", "LTD 60", "Total", "", "Benefit Description", "Medical", "Pet", None]
    r = _rows(spark, d).withColumn("b", pick(names, F.col("n")))
    out = ops.benefit_rows(r, "b", "current", lambda c: plans.plan_type(c, "benefit"))
    return _double(out.select("n", "PLAN_NAME", "PLAN_TYPE", "CURRENT_PREMIUM"), "CURRENT_PREMIUM")


TYPED = ["Voluntary Life - Spouse", "AD&D Family", "Short Term income", "std basic", "Long term child", "VDEN 2", "PPO Health", "VisionCare", "HMO", None, "Dental life"]


@query(f"""SELECT n, CASE WHEN p LIKE '%DENTAL%' THEN 'DENTAL' WHEN p LIKE '%VISION%' THEN 'VISION' WHEN p LIKE '%LIFE%' OR p LIKE '%AD&D%' THEN 'LIFE' WHEN p LIKE '%STD%' OR p LIKE '%SHORT TERM%' THEN 'STD' WHEN p LIKE '%LTD%' OR p LIKE '%LONG TERM%' THEN 'LTD' ELSE 'MEDICAL' END AS product,
 CASE WHEN p LIKE '%AD&D%' THEN 'AD&D' WHEN p LIKE '%LIFE%' THEN 'LIFE' WHEN p LIKE '%STD%' THEN 'STD' WHEN p LIKE '%LTD%' THEN 'LTD' WHEN p LIKE '%DEN%' THEN 'DENTAL' WHEN p LIKE '%VIS%' THEN 'VISION' ELSE 'VOLUNTARY' END AS voluntary,
 CASE WHEN coalesce(kind, '') NOT IN ('', 'EE', 'nan') THEN kind WHEN p LIKE '%DENTAL%' THEN 'DENTAL' WHEN p LIKE '%VISION%' THEN 'VISION' WHEN p LIKE '%LIFE%' THEN 'LIFE' WHEN p LIKE '%AD&D%' THEN 'AD&D'
  WHEN p LIKE '%PPO%' OR p LIKE '%HMO%' OR p LIKE '%HEALTH%' THEN 'MEDICAL' ELSE kind END AS repaired,
 CASE WHEN p LIKE '%SPOUSE%' THEN 'ES' WHEN p LIKE '%CHILD%' THEN 'EC' WHEN p LIKE '%FAMILY%' THEN 'FAM' ELSE 'EE' END AS tier FROM (SELECT n, kind, upper(coalesce({sql_pick(TYPED, 'n')}, '')) AS p FROM r)""", ROWS)
def plan_types(spark, d):
    p = pick(TYPED, F.col("n"))
    return _rows(spark, d).select("n", plans.plan_type(p).alias("product"), plans.plan_type(p, "voluntary").alias("voluntary"), plans.repaired_type(p, F.col("kind")).alias("repaired"), plans.tier_in_plan(p).alias("tier"))


#: A plan name as read, spaced, and cleaned as a blue plan's.
NAMES = [
    ("TGLife  basic", "TG Life basic", "TGLife basic"), ("tgAD&D", "TG AD&D", "tgAD&D"), ("Choice P7330 gold", "Choice P 7330 gold", "Choice P7330 gold"), ("SAND NFO 12 BlueCare", "SAND NFO 12 BlueCare", "BLUECARE NFQ 12 "),
    ("JAX BLUECARE info 9 REN", "JAX BLUECARE info 9 REN", "BLUECARE NFQ 9"), ("Health", "Health", "Health"), ("Beac Use  gold", "Beac Use gold", "gold"), ("XP7330", "XP7330", "XP7330"),
]


@query("SELECT c_custkey, " + ", ".join(f"{sql_pick([x[i] for x in NAMES], 'c_custkey')} || CASE WHEN c_custkey % {len(NAMES)} = 5 THEN '' ELSE ' ' || CAST(c_custkey AS VARCHAR) END AS {n}" for i, n in ((1, "spaced"), (2, "blue"))) + " FROM customer")
def plan_names(spark, d):
    k = F.col("c_custkey")
    name = F.concat(pick([x[0] for x in NAMES], k), F.when(k % len(NAMES) == 5, "").otherwise(F.concat(F.lit(" "), k.cast("string"))))
    return readers.table(spark, d, "customer").select("c_custkey", plans.spaced_plan(name).alias("spaced"), plans.blue_plan(name).alias("blue"))
