"""Every query: its Spark form over the driver's tables, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import bank, claims as ops, cleaning, documents as docs_ops, invoices, monitoring, setops, workers_comp
from ..sources import readers, writers
from ..streaming import streams
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


SUMS = "CAST(sum(incurred) AS DOUBLE) AS total_incurred, CAST(sum(paid) AS DOUBLE) AS total_paid, CAST(sum(reserve) AS DOUBLE)"

# ---------------------------------------------------------------- claims


@query(f"""SELECT count(*) AS total_claims, count(*) FILTER (status = 'OPEN') AS open_claims, count(*) FILTER (status = 'CLOSED') AS closed_claims,
 {SUMS} AS outstanding_reserve, count(*) FILTER (litigated) AS litigated_claims, count(*) FILTER (litigated)::DOUBLE / count(*) * 100 AS litigation_pct,
 CAST(sum(incurred) AS DOUBLE) / count(*) AS average_claim_cost, CAST(max(incurred) AS DOUBLE) AS largest_claim FROM claims""", b.CLAIMS)
def exec_summary(spark, d):
    return ops.executive_summary(b.claims(spark, d))


TOTAL_ORDER = ["claim_number", "l_partkey", "l_suppkey"]


@query("SELECT claim_number, state, status, CAST(incurred AS DOUBLE) AS incurred FROM claims ORDER BY incurred DESC, claim_number, l_partkey, l_suppkey LIMIT 10", b.CLAIMS)
def top_claims(spark, d):
    return ops.top_claims(b.claims(spark, d, "state"), 10, ["claim_number", "state", "status"], TOTAL_ORDER)


@query("SELECT claim_number, client, CAST(incurred AS DOUBLE) AS incurred FROM claims ORDER BY incurred DESC, claim_number, l_partkey, l_suppkey LIMIT 5", b.CLAIMS)
def top_five_claims(spark, d):
    return ops.top_claims(b.claims(spark, d, "client"), 5, ["claim_number", "client"], TOTAL_ORDER)


@query(f"SELECT * FROM (SELECT state, count(claim_number) AS claim_count, {SUMS} AS outstanding_reserve FROM claims GROUP BY state) ORDER BY total_incurred DESC, state LIMIT 10", b.CLAIMS)
def losses_by_state(spark, d):
    return ops.losses_by_state(b.claims(spark, d, "state"))


LOSSES = "SELECT {k}, count(*) AS claim_count, CAST(sum(incurred) AS DOUBLE) AS total_incurred, CAST(sum(incurred) AS DOUBLE) / count(*) AS average_severity FROM claims GROUP BY {k} ORDER BY sum(incurred) DESC, {k} LIMIT 10"


@query(LOSSES.format(k="class_code, class_text"), b.CLAIMS)
def losses_by_class(spark, d):
    return ops.losses_by(b.claims(spark, d, "class_code", "class_text"), ["class_code", "class_text"])


@query(LOSSES.format(k="cause"), b.CLAIMS)
def losses_by_cause(spark, d):
    return ops.losses_by(b.claims(spark, d, "cause"), ["cause"])


@query(f"""SELECT bucket, count(claim_number) AS claim_count, CAST(sum(reserve) AS DOUBLE) AS total_reserve, CAST(sum(incurred) AS DOUBLE) AS total_incurred FROM (
 SELECT *, CASE WHEN days <= -1 THEN NULL WHEN days <= 30 THEN '0-30 Days' WHEN days <= 90 THEN '31-90 Days' WHEN days <= 180 THEN '91-180 Days' WHEN days <= 365 THEN '181-365 Days' ELSE 'Over 365 Days' END AS bucket
 FROM (SELECT *, (SELECT max(loss_date) FROM claims) - loss_date AS days FROM claims WHERE status = 'OPEN')) WHERE bucket IS NOT NULL GROUP BY bucket""", b.CLAIMS)
def open_aging(spark, d):
    return ops.open_aging(b.claims(spark, d))


def _case(col: str, table: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 5.0 END"


def _steps(x: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {n} THEN {p}" for n, p in steps) + " ELSE 0 END"


def _category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {n} THEN '{c}'" for n, c in ops.CATEGORIES) + " ELSE 'Critical' END"


def _mode(col: str) -> str:
    return f"(SELECT client, {col} FROM (SELECT client, {col}, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, {col}) AS rn FROM claims GROUP BY client, {col}) WHERE rn = 1)"


RISK = b.CLAIMS + f""", g AS (SELECT client, count(*) AS n, CAST(sum(incurred) AS DOUBLE) AS inc, CAST(sum(reserve) AS DOUBLE) AS res, count(*) FILTER (litigated) AS lit FROM claims GROUP BY client),
risk AS (SELECT client, n AS claim_count, inc AS total_incurred, {_steps('n', ops.FREQUENCY)} + {_steps('inc / n', ops.SEVERITY)} + {_steps('lit::DOUBLE / n * 100', ops.LITIGATION)}
 + {_steps('res / inc * 100', ops.RESERVE)} + greatest(0.0, 10 - {_case('state', b.STATE_FACTORS)}) + greatest(0.0, 5 - {_case('class_code', b.CLASS_FACTORS)} / 2) AS raw
 FROM g JOIN {_mode('state')} USING (client) JOIN {_mode('class_code')} USING (client))"""


def _risk(spark, d):
    return ops.client_risk(b.claims(spark, d, "client", "state", "class_code"), b.STATE_FACTORS, b.CLASS_FACTORS)


@query(f"SELECT client, claim_count, total_incurred, CAST(round_even(raw, 0) AS BIGINT) AS score, {_category('raw')} AS category FROM risk", RISK)
def client_risk(spark, d):
    return _risk(spark, d)


@query(f"SELECT client, CAST(round_even(raw, 0) AS BIGINT) AS score, {_category('raw')} AS category FROM risk ORDER BY score, client LIMIT 5", RISK)
def worst_clients(spark, d):
    return _risk(spark, d).select("client", "score", "category").orderBy("score", "client").limit(5)


@query(f"SELECT portfolio_score, clients, {_category('portfolio_score')} AS classification FROM (SELECT CAST(round_even(avg(round_even(raw, 0)), 0) AS BIGINT) AS portfolio_score, count(*) AS clients FROM risk)", RISK)
def portfolio_score(spark, d):
    return ops.portfolio_score(_risk(spark, d))


@query("SELECT count(*) AS before_filter, count(*) FILTER (year = 1995) AS after_filter, count(*) - count(*) FILTER (year = 1995) AS excluded FROM claims", b.CLAIMS)
def year_filter_counts(spark, d):
    return ops.filter_counts(b.claims(spark, d), 1995)


@query(f"SELECT status, count(*) AS claims, CAST(sum(incurred) AS DOUBLE) AS total_incurred FROM claims WHERE year = 1995 GROUP BY status", b.CLAIMS)
def year_filter(spark, d):
    return ops.year_filter(b.claims(spark, d), 1995).groupBy("status").agg(F.count("*").alias("claims"), ops.total(F.col("incurred")).alias("total_incurred"))


@query("""SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y >= 1994 THEN 'included' ELSE 'excluded' END AS split, count(*) AS claims, CAST(sum(incurred) AS DOUBLE) AS total_incurred
 FROM (SELECT *, CASE WHEN claim_number % 11 = 0 THEN NULL ELSE year END AS y FROM claims) GROUP BY 1""", b.CLAIMS)
def claim_year_split(spark, d):
    c = b.claims(spark, d).withColumn("year", F.when(F.col("claim_number") % 11 != 0, F.col("year")))
    return ops.year_split(c, 1998)


@query("""SELECT count(*) FILTER (y IS NULL OR y >= 1994) AS last_five_years, count(*) FILTER (y < 1994) AS older, count(*) AS total
 FROM (SELECT CASE WHEN claim_number % 11 = 0 THEN NULL ELSE year END AS y FROM claims)""", b.CLAIMS)
def claims_count(spark, d):
    """Counted by policy, as by file, and merged by sum."""
    c = b.claims(spark, d).withColumn("year", F.when(F.col("claim_number") % 11 != 0, F.col("year")))
    return ops.merged_counts(ops.recent_counts(c, 1998, by=["policy"]))


BREAKDOWN = f"count(*) AS claim_count, {SUMS} AS total_reserves, count(*) FILTER (status = 'OPEN') AS open_count, count(*) FILTER (status = 'CLOSED') AS closed_count"


@query(f"SELECT year, {BREAKDOWN} FROM claims GROUP BY year", b.CLAIMS)
def year_breakdown(spark, d):
    return ops.by_year(b.claims(spark, d))


@query(f"SELECT coalesce(nullif(CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE carrier END, ''), 'Unknown') AS carrier, {BREAKDOWN} FROM claims GROUP BY 1", b.CLAIMS)
def carrier_breakdown(spark, d):
    gone = F.when(F.col("l_suppkey") % 5 == 0, "").when(F.col("l_suppkey") % 7 != 0, F.col("carrier"))
    return ops.by_carrier(b.claims(spark, d, "carrier").withColumn("carrier", gone))


@query("""SELECT year, t AS total_incurred, CASE WHEN lag(t) OVER (ORDER BY year) > 0 THEN (t - lag(t) OVER (ORDER BY year)) / lag(t) OVER (ORDER BY year) * 100 END AS change_pct
 FROM (SELECT year, CAST(sum(incurred) AS DOUBLE) AS t FROM claims GROUP BY year)""", b.CLAIMS)
def year_over_year(spark, d):
    return ops.year_over_year(ops.by_year(b.claims(spark, d)))


@query(f"""SELECT (SELECT claim_number FROM claims ORDER BY incurred DESC, claim_number LIMIT 1) AS highest_claim, CAST(max(incurred) AS DOUBLE) AS highest_incurred,
 (SELECT claim_number FROM claims WHERE incurred > 0 ORDER BY incurred, claim_number LIMIT 1) AS lowest_claim, CAST(min(incurred) FILTER (incurred > 0) AS DOUBLE) AS lowest_incurred,
 count(*) FILTER (incurred > 0 AND reserve * 2 > incurred) AS high_reserve_claims FROM claims""", b.CLAIMS)
def claim_extremes(spark, d):
    return ops.extremes(b.claims(spark, d))


@query("""SELECT * FROM (SELECT unnest([{'category': 'risk', 'topic': 'litigation', 'n': lit}, {'category': 'info', 'topic': 'reserves exceed paid', 'n': CASE WHEN res > paid AND paid > 0 THEN 1 ELSE 0 END},
 {'category': 'info', 'topic': 'open claims', 'n': o}, {'category': 'info', 'topic': 'all closed', 'n': CASE WHEN res = 0 AND o = 0 THEN 1 ELSE 0 END}, {'category': 'risk', 'topic': 'large claims', 'n': big}], recursive := true)
 FROM (SELECT count(*) FILTER (litigated) AS lit, sum(reserve) AS res, sum(paid) AS paid, count(*) FILTER (status = 'OPEN') AS o, count(*) FILTER (incurred > 100000) AS big FROM claims)) WHERE n > 0""", b.CLAIMS)
def observations(spark, d):
    return ops.observations(b.claims(spark, d))


@query("SELECT year, min(policy) AS policy, min(carrier) AS carrier FROM claims GROUP BY year", b.CLAIMS)
def summary_level(spark, d):
    return ops.summary_level(b.claims(spark, d, "carrier"))


@query("""SELECT claim_number, CAST(total AS DOUBLE) AS total FROM (SELECT claim_number, CASE WHEN sum(zero) OVER () = 0 THEN paid + reserve ELSE zero END AS total FROM (SELECT *, 0 AS zero FROM claims))""", b.CLAIMS)
def totals_from_parts(spark, d):
    c = b.claims(spark, d).withColumn("total", F.lit(0).cast("decimal(18,2)"))
    return ops.missing_totals(c, "total", [F.col("paid"), F.col("reserve")]).select("claim_number", F.col("total").cast("double").alias("total"))


# ---------------------------------------------------------------- cleaning and matching


@query("SELECT claim_number, l_partkey, CAST(incurred AS DOUBLE) AS incurred FROM (SELECT *, row_number() OVER (PARTITION BY claim_number ORDER BY l_partkey, l_suppkey, incurred) AS rn FROM claims) WHERE rn = 1", b.CLAIMS)
def first_wins_dedupe(spark, d):
    w = cleaning.first_wins(b.claims(spark, d), ["claim_number"], ["l_partkey", "l_suppkey", "incurred"])
    return w.select("claim_number", "l_partkey", F.col("incurred").cast("double").alias("incurred"))


VERSIONS = """v AS (SELECT user_id, list({'score': event_id % 4, 'date': CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END, 'detail': CASE WHEN event_id % 5 <> 0 THEN event_type END, 'best': event_id % 4} ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, len(l) AS copies, list_reduce(l, lambda a, x: CASE WHEN (x.score > a.best AND (x.date IS NOT NULL OR a.date IS NULL)) OR (a.date IS NULL AND x.date IS NOT NULL)
 THEN {'score': x.score, 'date': coalesce(x.date, a.date), 'detail': coalesce(x.detail, a.detail), 'best': greatest(a.best, x.score)} ELSE {'score': a.score, 'date': coalesce(a.date, x.date), 'detail': coalesce(a.detail, x.detail), 'best': greatest(a.best, x.score)} END) AS r FROM v)"""


@query("SELECT user_id, copies, r.date AS date, r.detail AS detail, CAST(r.best AS INTEGER) AS best_score FROM f", VERSIONS)
def best_claim_version(spark, d):
    """A user's events as copies of one record; score, date and detail may each be missing."""
    e = readers.table(spark, d, "events")
    k = F.col("event_id")
    e = e.select("user_id", "event_id", (k % 4).cast("int").alias("score"), F.when(k % 3 != 0, F.col("ts").cast("date")).alias("date"), F.when(k % 5 != 0, F.col("event_type")).alias("detail"))
    return cleaning.best_version(e, "user_id", ["event_id"], "score", "date", ["detail"]).select("user_id", "copies", "date", "detail", "best_score")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def missing_claims(spark, d):
    o, li = readers.table(spark, d, "orders"), readers.table(spark, d, "lineitem").where("l_quantity > 10")
    return cleaning.missing_from(o, li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def extra_claims(spark, d):
    o, li = readers.table(spark, d, "orders").where("o_orderstatus = 'F'"), readers.table(spark, d, "lineitem")
    return cleaning.missing_from(li, o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("SELECT '00' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_zero_stripped(spark, d):
    c = readers.table(spark, d, "customer").select(F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("id"))
    return cleaning.missing_from(c, readers.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("id")), "id", zero_insensitive=True)


@query("SELECT '0' || CAST(o_custkey AS VARCHAR) AS id, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def master_listed(spark, d):
    o = readers.table(spark, d, "orders").select(F.concat(F.lit("0"), F.col("o_custkey").cast("string")).alias("id"), "o_orderkey")
    return cleaning.listed(o, readers.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id")), "id")


@query("""SELECT c_name, c_acctbal > 0 AS has_money FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'ACME INC' WHEN c_custkey % 5 = 0 THEN 'null' ELSE c_name END AS nm FROM customer)
 WHERE NOT ((nm = 'ACME INC' OR nm = 'null') AND c_acctbal <= 0 AND length(c_mktsegment) <= 9)""")
def strict_phantom_filter(spark, d):
    c = readers.table(spark, d, "customer").withColumn("nm", F.when(F.col("c_custkey") % 3 == 0, "ACME INC").when(F.col("c_custkey") % 5 == 0, "null").otherwise(F.col("c_name")))
    long_text = F.when(F.length("c_mktsegment") > 9, F.concat("c_mktsegment", F.lit(" injury")))
    return c.where(~cleaning.phantom(F.col("nm"), [F.col("c_acctbal")], long_text)).select("c_name", (F.col("c_acctbal") > 0).alias("has_money"))


@query("""SELECT claim_number, CAST(round(abs(paid + reserve + l_linenumber - incurred), 2) AS DOUBLE) AS diff, round(abs(paid + reserve + l_linenumber - incurred), 2) < 2.0 AS valid FROM claims""", b.CLAIMS)
def math_check(spark, d):
    c = b.claims(spark, d)
    return c.select("claim_number", cleaning.math_check([F.col("paid"), F.col("reserve"), F.col("l_linenumber")], F.col("incurred"), 2.0).alias("m")).select("claim_number", "m.*")


@query("""SELECT e.event_id, a.event_type AS last_anchor FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_type) AS event_type FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id, ts) a ON e.user_id = a.user_id AND e.ts >= a.ts""")
def asof_backfill(spark, d):
    e = readers.table(spark, d, "events")
    anchors = e.where("event_type IN ('signup', 'purchase')").groupBy("user_id", "ts").agg(F.max("event_type").alias("last_anchor"))
    return cleaning.nearest_before(e.select("user_id", "ts", "event_id"), anchors, "user_id", "ts", "last_anchor").select("event_id", "last_anchor")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def suspicious_lookup(spark, d):
    c = readers.table(spark, d, "customer").where("c_acctbal < 0")
    return cleaning.looked_up(readers.table(spark, d, "orders"), "o_custkey", c, "c_custkey", ["c_name"]).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS amount_due FROM lineitem")
def amount_by_invoice(spark, d):
    return invoices.amount_by_invoice(readers.table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount_due")


# ---------------------------------------------------------------- invoices


@query("""SELECT INV_NUMBER, LINE, PREMIUM, PRIORITY FROM (SELECT o_orderkey AS INV_NUMBER, CAST(l_linenumber AS INTEGER) AS LINE, l_extendedprice AS PREMIUM, coalesce(CASE WHEN l_returnflag = 'A' THEN l_returnflag END, o_orderpriority) AS PRIORITY
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)""")
def header_item_coalesce(spark, d):
    o = readers.table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("INV_NUMBER"), F.col("o_orderpriority").alias("PRIORITY")).alias("HEADER"))
    item = F.struct(F.col("l_linenumber").alias("LINE"), F.col("l_extendedprice").alias("PREMIUM"), F.when(F.col("l_returnflag") == "A", F.col("l_returnflag")).alias("PRIORITY"))
    items = readers.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("LINE_ITEMS"))
    docs = o.join(items, o.o_orderkey == items.l_orderkey, "left").select("HEADER", "LINE_ITEMS")
    return invoices.explode_items(docs, "HEADER", "LINE_ITEMS", ["PRIORITY"]).select("INV_NUMBER", "LINE", "PREMIUM", "PRIORITY")


@query("""SELECT first, last, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS merged_rows FROM (SELECT c_mktsegment AS first, c_name AS last, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey)
 GROUP BY first, last, o_custkey, o_orderstatus""")
def carrier_row_merge(spark, d):
    m = invoices.merge_rows(_carrier_rows(spark, d), "first", "last", ["id"], text.plain(F.col("kind")), [], ["amount"], ["id"], ["o_orderkey"])
    return m.select("first", "last", F.col("amount").cast("double").alias("amount"), "merged_rows")


def _carrier_rows(spark, d):
    o, c = readers.table(spark, d, "orders"), readers.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("first"), F.col("c_name").alias("last"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("kind"), money.cents(F.col("o_totalprice")).alias("amount"), "o_orderkey")


@query("""SELECT sum(v)::DOUBLE AS before_sum, (SELECT sum(s)::DOUBLE FROM (SELECT sum(v) AS s FROM p GROUP BY o_custkey, o_orderstatus)) AS after_sum, true AS intact FROM p""", "p AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey)")
def merge_integrity(spark, d):
    """Before and after the merge of ``carrier_row_merge``."""
    rows = _carrier_rows(spark, d)
    return invoices.merge_integrity(rows, invoices.merge_rows(rows, "first", "last", ["id"], text.plain(F.col("kind")), [], ["amount"], ["id"], ["o_orderkey"]), "amount")


@query("""SELECT o_orderstatus AS label, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'GRAND TOTAL', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders""")
def grand_total_row(spark, d):
    g = readers.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.sum(money.cents(F.col("o_totalprice"))).alias("amount"))
    return invoices.with_totals(g, "label", ["amount"]).select("label", F.col("amount").cast("double").alias("amount"))


@query("""SELECT o_orderkey, CAST(coalesce(nullif(CASE WHEN coalesce(bl, 0) + coalesce(ad, 0) > coalesce(due, 0) + 0.05 THEN coalesce(bl, 0) + coalesce(ad, 0) ELSE due END, 0), nullif(coalesce(bl, 0) + coalesce(ad, 0), 0), s) AS DOUBLE) AS invoice_total
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS due, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) - 10 END AS bl, CASE WHEN o_orderkey % 5 = 0 THEN 10.04 WHEN o_orderkey % 5 = 1 THEN 10.06 END::DECIMAL(18,2) AS ad FROM orders) JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def invoice_totals(spark, d):
    o, li = readers.table(spark, d, "orders"), readers.table(spark, d, "lineitem")
    k, price = F.col("o_orderkey"), money.cents(F.col("o_totalprice"))
    billed, adj = F.when(k % 3 == 0, price - 10).cast("decimal(18,2)"), F.when(k % 5 == 0, 10.04).when(k % 5 == 1, 10.06).cast("decimal(18,2)")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("o_orderkey", F.when(k % 4 != 0, price).alias("due"), billed.alias("billed"), adj.alias("adj"), money.cents(F.col("l_extendedprice")).alias("current"))
    return invoices.amount_due(rows, "o_orderkey", "due", "billed", "adj", "current")


@query("""SELECT l_orderkey, t AS target, round(abs(t - s), 2) AS gap, NOT (s - t > greatest(1.0, s * 0.01)) AND abs(t - s) > 0.05 AS needs_review
 FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_orderkey) JOIN (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS t FROM orders) ON l_orderkey = o_orderkey""")
def reconcile_gap(spark, d):
    li = readers.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money.cents(F.col("l_extendedprice"))).cast("double").alias("s"))
    o = readers.table(spark, d, "orders").select("o_orderkey", money.cents(F.col("o_totalprice")).cast("double").alias("t"))
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", invoices.reconcile(F.col("s"), [F.col("t")]).alias("r"))
    return r.select("l_orderkey", "r.target", F.round("r.gap", 2).alias("gap"), "r.needs_review")


@query("""SELECT (SELECT string_agg(s_name, ' | ' ORDER BY s_suppkey) FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 3)) || CASE WHEN count(*) > 3 THEN ' (+' || CAST(count(*) - 3 AS VARCHAR) || ' more)' ELSE '' END AS vendors,
 count(*) AS invoices, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM supplier""")
def vendor_line(spark, d):
    s = readers.table(spark, d, "supplier").withColumn("amount", money.cents(F.col("s_acctbal")))
    return invoices.vendor_line(s, "s_name", "amount", ["s_suppkey"])


@query("""SELECT vendor, sum(a)::DOUBLE AS total, max(a)::DOUBLE AS largest, min(k) FILTER (a = m) AS largest_item FROM (SELECT s_name AS vendor, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, l_orderkey * 10 + l_linenumber AS k, max(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY s_name) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY vendor""")
def vendor_stats(spark, d):
    li, s = readers.table(spark, d, "lineitem"), readers.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("vendor"))
    bills = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("vendor", money.cents(F.col("l_extendedprice")).alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    return invoices.vendor_statistics(bills, "vendor", "amount", "item")


@query("""SELECT l_orderkey, benefit, CAST(premium AS DOUBLE) AS premium FROM (SELECT l_orderkey, l_returnflag AS benefit, sum(CAST(l_tax AS DECIMAL(18,2))) AS premium FROM lineitem GROUP BY 1, 2) WHERE premium <> 0""")
def unpivot_premiums(spark, d):
    li = readers.table(spark, d, "lineitem")
    wide = li.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(money.cents(F.col("l_tax"))))
    return invoices.unpivot_premiums(wide, ["l_orderkey"], ["A", "N", "R"], "benefit", "premium").withColumn("premium", F.col("premium").cast("double"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'S' || CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS member FROM events""")
def fill_down(spark, d):
    e = readers.table(spark, d, "events").withColumn("member", F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string"))).otherwise(" "))
    return invoices.fill_down(e, "user_id", ["ts", "event_id"], ["member"]).select("event_id", "member")


ORPHANS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type IN ('click', 'view') THEN 'MISSING' ELSE event_type END AS person, 'P' || CAST(event_id % 4 AS VARCHAR) AS plan,
 CASE WHEN event_id % 9 <> 0 THEN value END AS premium FROM events),
a AS (SELECT *, person <> 'MISSING' AS is_real, last_value(CASE WHEN person <> 'MISSING' THEN person END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastp FROM e),
r AS (SELECT *, count(*) FILTER (is_real AND person IS DISTINCT FROM lastp) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM a),
s AS (SELECT *, list(CASE WHEN is_real THEN plan END) OVER (PARTITION BY user_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)"""


@query("""SELECT event_id, CASE WHEN is_real THEN person ELSE lastp END AS person, NOT is_real AS repaired FROM s
 WHERE is_real OR NOT (i > 50 OR coalesce(list_contains(seen, plan), false) OR premium IS NULL OR lastp IS NULL)""", ORPHANS)
def orphan_repair(spark, d):
    e = readers.table(spark, d, "events").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    e = e.select("user_id", "event_id", "idx", F.when(F.col("event_type").isin("click", "view"), "MISSING").otherwise(F.col("event_type")).alias("person"), F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("plan"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("premium"))
    return invoices.repair_orphans(e, "user_id", ["idx"], "person", F.col("plan"), ["premium"], "idx", "MISSING").select("event_id", "person", "repaired")


@query("""SELECT event_id, CASE WHEN m THEN NULL ELSE v END AS current, CASE WHEN m THEN v END AS adjustment FROM (SELECT event_id, v, v <> 0 AND (event_type = 'error' OR v < 0) AS m FROM (SELECT event_id, event_type, CAST(value - 50 AS DECIMAL(18,2))::DOUBLE AS v FROM events))""")
def adjustment_move(spark, d):
    e = readers.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "Retro plan").otherwise("Plan").alias("plan"), money.cents(F.col("value") - 50).cast("double").alias("current"), F.lit(None).cast("double").alias("adjustment"))
    return invoices.move_adjustments(e, F.col("plan"), "current", "adjustment").select("event_id", "current", "adjustment")


@query("SELECT avg(CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END) AS id, avg(CASE WHEN c_custkey % 10 = 0 THEN 1.0 ELSE 0.0 END) AS plan FROM customer")
def missing_rates(spark, d):
    c = readers.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("id"), F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_mktsegment")).alias("plan"))
    return invoices.missing_rates(c, ["id", "plan"])


# ---------------------------------------------------------------- bank statements


AUDIT = b.TRANSACTIONS + """, v AS (SELECT *, CASE WHEN regexp_matches(lower(description), 'withdrawal|debit|check|payment|fee|purchase|outgoing|send') THEN CASE WHEN amount > 0 THEN -amount ELSE amount END
   WHEN regexp_matches(lower(description), 'deposit|credit|interest|refund|incoming|receive') AND amount < 0 THEN -amount ELSE amount END AS value FROM tx),
g AS (SELECT *, count(running_balance) OVER w AS grp, last_value(running_balance IGNORE NULLS) OVER w AS anchor FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, coalesce(anchor, 100) + coalesce(sum(CASE WHEN running_balance IS NULL THEN value END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM g)"""


@query("""SELECT event_id, CAST(prior AS DOUBLE) AS prior, coalesce(abs(prior + value - running_balance) > 0.01, false) AS fixed,
 CAST(CASE WHEN coalesce(abs(prior + value - running_balance) > 0.01, false) THEN abs(round(running_balance - prior, 2)) ELSE amount END AS DOUBLE) AS amount_due FROM p""", AUDIT)
def running_balance_audit(spark, d):
    a = bank.audit_balance(b.transactions(spark, d), "user_id", ["ts", "event_id"], F.lit(100).cast("decimal(18,2)"))
    return a.select("event_id", F.col("prior").cast("double").alias("prior"), "fixed", F.col("amount_due").cast("double").alias("amount_due"))


@query("""SELECT user_id, CAST(coalesce(sum(value) FILTER (value > 0), 0) AS DOUBLE) AS deposits, CAST(coalesce(sum(-value) FILTER (value < 0 AND check_no IS NULL), 0) AS DOUBLE) AS debits,
 CAST(coalesce(sum(-value) FILTER (value < 0 AND check_no IS NOT NULL), 0) AS DOUBLE) AS checks FROM v GROUP BY user_id""", AUDIT)
def bank_sums(spark, d):
    t = b.transactions(spark, d)
    return bank.sums(t.withColumn("value", bank.signed(F.col("amount"), F.col("description"))), "user_id")


GAP = "CASE WHEN abs(u.d - x[1].d) > 300 THEN abs(abs(u.d - x[1].d) - 365) ELSE abs(u.d - x[1].d) END <= 1"
FOLDED = b.TRANSACTIONS + f""", n AS (SELECT event_id, round(amount, 0) AS key, upper(description) AS t, dayofyear(strptime('2000/' || date, '%Y/%m/%d')) AS d FROM tx),
l AS (SELECT list([{{'id': event_id, 'd': d, 't': t}}] ORDER BY event_id) AS rows FROM n GROUP BY key),
k AS (SELECT unnest(list_reduce(rows, lambda a, x: CASE WHEN len(list_filter(a, lambda u: {GAP} AND contains(u.t, x[1].t))) > 0 THEN a ELSE list_append(list_filter(a, lambda u: NOT ({GAP} AND contains(x[1].t, u.t))), x[1]) END)) AS r FROM l)"""


@query("SELECT event_id, date, description FROM tx JOIN k ON event_id = r.id", FOLDED)
def fuzzy_tx_dedupe(spark, d):
    """Transactions of equal amounts, to the unit, over all users."""
    t = b.transactions(spark, d).withColumn("amount", F.round("amount", 0).cast("decimal(18,0)"))
    return bank.drop_duplicates(t, ["amount"], "event_id").select("event_id", "date", "description")


@query("SELECT event_id, description FROM tx WHERE NOT regexp_matches(upper(description), 'SUMMARY|TOTAL|VIEW') AND abs(amount) <= 150", b.TRANSACTIONS)
def summary_line_filter(spark, d):
    t = b.transactions(spark, d)
    return t.where(~bank.summary_line(F.col("description"), F.col("amount"), 150) & ~F.upper("description").contains("VIEW")).select("event_id", "description")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY check_no IS NULL, CASE WHEN check_no IS NULL THEN 0 ELSE CAST(check_no AS BIGINT) END, date, event_id) AS place FROM tx", b.TRANSACTIONS)
def debit_sort(spark, d):
    """Every statement's debits in order: a place for each row, so the whole order is checked."""
    return bank.placed(b.transactions(spark, d), "user_id", [*bank.debit_order(F.col("check_no"), F.col("date")), "event_id"]).select("user_id", "event_id", "place")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date, event_id) AS place FROM tx", b.TRANSACTIONS)
def deposit_sort(spark, d):
    return bank.placed(b.transactions(spark, d), "user_id", [*bank.deposit_order(F.col("date")), "event_id"]).select("user_id", "event_id", "place")


# ---------------------------------------------------------------- workers' compensation


@query("""SELECT l_orderkey, l_returnflag, pay FROM (SELECT *, max(pay > 0) OVER (PARTITION BY l_orderkey, l_returnflag) AS any_pay, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, CASE WHEN pay > 0 THEN pay END ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
 FROM (SELECT *, greatest(l_quantity - 25, 0) AS pay FROM lineitem)) WHERE rn = 1 AND (pay > 0 OR NOT any_pay)""")
def rating_dedupe(spark, d):
    li = readers.table(spark, d, "lineitem").withColumn("pay", F.greatest(F.col("l_quantity") - 25, F.lit(0.0)))
    return workers_comp.dedupe_rating(li, ["l_orderkey", "l_returnflag"], "pay", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_returnflag", "pay")


@query("SELECT user_id, event_type AS question, CASE WHEN max(CASE WHEN value > 90 THEN 1 ELSE 0 END) = 1 THEN 'Y' ELSE 'N' END AS answer FROM events GROUP BY user_id, event_type")
def answers_or_merge(spark, d):
    e = readers.table(spark, d, "events").select("user_id", F.col("event_type").alias("question"), F.when(F.col("value") > 90, "yes").otherwise("n").alias("answer"))
    return workers_comp.any_yes(e, ["user_id", "question"], "answer")


@query("SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn = 1")
def longest_name(spark, d):
    return workers_comp.longest(readers.table(spark, d, "conversations"), "conv_id", "text", "turn")


@query("SELECT user_id, (array_agg(event_type ORDER BY event_id) FILTER (event_type <> 'click'))[1] AS kind FROM events GROUP BY user_id")
def fill_later(spark, d):
    e = readers.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "N/A").otherwise(F.col("event_type")).alias("kind"))
    return workers_comp.fill_later(e, "user_id", "event_id", ["kind"])


@query("SELECT o_orderkey, 'q1' AS question, CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS answer FROM orders UNION ALL SELECT o_orderkey, 'q2', CASE WHEN o_totalprice > 100000 THEN 'Y' ELSE 'N' END FROM orders")
def wc_questions(spark, d):
    o = readers.table(spark, d, "orders")
    m = F.create_map(F.lit("q1"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N"), F.lit("q2"), F.when(F.col("o_totalprice") > 100000, "Y").otherwise("N"))
    return workers_comp.flatten(o.select("o_orderkey", m.alias("generalQuestions")), "o_orderkey", [], [], ["generalQuestions"])["generalQuestions"]


# ---------------------------------------------------------------- monitoring


LAST = "(SELECT max(ts) FROM events)"


def _now(spark, d):
    return readers.table(spark, d, "events").agg(F.max("ts")).scalar()


@query(f"""SELECT count(*) AS total_requests, count(*) FILTER (status = 'completed') AS completed_requests, count(*) FILTER (status = 'failed') AS failed_requests, count(*) FILTER (status = 'processing') AS processing_requests,
 round(count(*) FILTER (status = 'completed')::DOUBLE / count(*) * 100, 2) AS success_rate, round(coalesce(avg(processing_time) FILTER (status = 'completed'), 0), 2) AS average_processing_time,
 count(*) FILTER (timestamp >= {LAST} - INTERVAL 1 DAY) AS recent_requests_24h FROM requests""", b.REQUESTS)
def monitor_stats(spark, d):
    return monitoring.statistics(b.requests(spark, d), _now(spark, d))


@query(f"""SELECT count(*) AS total_requests, count(*) FILTER (status = 'completed') AS completed_requests, count(*) FILTER (status = 'failed') AS failed_requests, count(*) FILTER (status = 'processing') AS processing_requests,
 round(count(*) FILTER (status = 'completed')::DOUBLE / count(*) * 100, 2) AS success_rate, round(coalesce(avg(processing_time) FILTER (status = 'completed'), 0), 2) AS average_processing_time
 FROM requests WHERE timestamp >= {LAST} - INTERVAL 72 HOUR""", b.REQUESTS)
def monitor_recent(spark, d):
    return monitoring.statistics(monitoring.within(b.requests(spark, d), _now(spark, d), 72))


@query("SELECT coalesce(error_details, 'Unknown Error') AS error, count(*) AS n FROM requests WHERE status = 'failed' GROUP BY 1", b.REQUESTS)
def error_frequency(spark, d):
    return monitoring.error_frequency(b.requests(spark, d))


@query("SELECT id, status FROM (SELECT * FROM requests ORDER BY timestamp DESC, id DESC LIMIT 1000) WHERE status = 'failed'", b.REQUESTS)
def latest_n_then_filter(spark, d):
    return monitoring.latest(b.requests(spark, d), 1000, "id").where("status = 'failed'").select("id", "status")


@query("SELECT id, filename FROM requests WHERE document_type = 'click' AND contains(lower(filename), 'user1')", b.REQUESTS)
def request_filter(spark, d):
    return monitoring.matching(b.requests(spark, d), {"document_type": "click"}, {"filename": "USER1"}).select("id", "filename")


@query("""SELECT user_id, count(*) AS completed, round(avg(processing_time), 2) AS avg_time, round(min(processing_time), 2) AS min_time, round(max(processing_time), 2) AS max_time, round(count(*) / 24.0, 4) AS per_hour FROM requests WHERE status = 'completed' GROUP BY user_id""", b.REQUESTS)
def performance_by_type(spark, d):
    return monitoring.performance(b.requests(spark, d), 24, ["user_id"])


COSTED = b.CALLS + """, m AS (SELECT *, round(prompt_tokens / 1000.0 * pin, 6) AS input_cost, round(completion_tokens / 1000.0 * pout, 6) AS output_cost FROM calls)"""


@query("""SELECT conv_id, turn, prompt_tokens + completion_tokens AS total_tokens, CAST(round(input_cost + output_cost, 6) AS DOUBLE) AS total_cost, CASE WHEN input_cost + output_cost <= 0.005 THEN 'low' WHEN input_cost + output_cost <= 0.05 THEN 'medium' ELSE 'high' END AS cost_level FROM m""", COSTED)
def ai_call_metrics(spark, d):
    return monitoring.call_metrics(b.ai_calls(spark, d)).select("conv_id", "turn", "total_tokens", "total_cost", "cost_level")


@query("SELECT model, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(round(sum(round(input_cost + output_cost, 6)), 4) AS DOUBLE) AS cost FROM m GROUP BY model", COSTED)
def ai_usage_by_model(spark, d):
    return monitoring.usage_by(monitoring.call_metrics(b.ai_calls(spark, d)), ["model"])


@query("""SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM events UNION ALL SELECT 'scan_status', event_type, count(*) FROM events GROUP BY event_type UNION ALL SELECT 'action', CAST(user_id % 3 AS VARCHAR), count(*) FROM events GROUP BY user_id % 3""")
def security_breakdown(spark, d):
    e = readers.table(spark, d, "events").select(F.col("event_type").alias("scan"), (F.col("user_id") % 3).cast("string").alias("action"))
    return monitoring.security_stats(e, "scan", "action")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_state(spark, d):
    return monitoring.latest_state(readers.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, epoch_us(e) - epoch_us(s) AS duration_us FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS s, max(ts) FILTER (event_type = 'purchase') AS e FROM events GROUP BY user_id) WHERE e >= s""")
def step_durations(spark, d):
    e = readers.table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").alias("kind"))
    return monitoring.step_durations(e, ["user_id"], "kind", "ts")


@query(f"SELECT event_id FROM events WHERE ts < {LAST} - INTERVAL 7 DAY")
def retention_sweep(spark, d):
    return monitoring.expired(readers.table(spark, d, "events"), "ts", _now(spark, d), 7).select("event_id")


@query("SELECT count(DISTINCT user_id) AS messages, count(*) AS files FROM events")
def ledger_summary(spark, d):
    return monitoring.ledger_summary(readers.table(spark, d, "events"), "user_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_activity(spark, d):
    return streams.window_counts(readers.table(spark, d, "events"), "ts", ["event_type"], "1 day")


# ---------------------------------------------------------------- documents


QUALITY = """SELECT doc_id, CAST(len(string_split(t, '(cid:')) - 1 AS BIGINT) AS cid_count, CASE WHEN dense > 0 THEN round(1 - alnum / dense, 4) ELSE 1.0 END AS noise_ratio, round(vowels / greatest(alpha, 1), 4) AS vowel_ratio, CAST(alpha AS BIGINT) AS alpha_count
 FROM (SELECT doc_id, text AS t, length(regexp_replace(text, '[\\s$.,/\\-:]', '', 'g')) AS dense, length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS alnum, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS alpha, length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) AS vowels FROM documents)"""


@query(QUALITY)
def text_quality(spark, d):
    q = docs_ops.quality(F.col("text"))
    return readers.table(spark, d, "documents").select("doc_id", *[q[c].alias(c) for c in ("cid_count", "noise_ratio", "vowel_ratio", "alpha_count")])


@query("SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) / length(text) AS ratio FROM documents")
def alnum_ratio(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", docs_ops.alnum_ratio(F.col("text")).alias("ratio"))


COUNTED = "length(regexp_replace({t}, '[^{c}]', '', 'g'))"
NOISE = f"""t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM t),
g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c WHERE ch <> chr(10)) GROUP BY doc_id, ch, run HAVING count(*) >= 10) GROUP BY doc_id),
m AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[(]cid:')) AS cid, len(regexp_extract_all(t, '[/\\\\|@#$%&<>={{}}\\[\\]^~`]')) AS symbols, len(regexp_extract_all(t, '[^\\x20-\\x7E]')) AS odd, len(regexp_extract_all(t, '[a-zA-Z]{{3,}}')) AS words,
 coalesce(g.n, 0) AS runs, length(regexp_replace(t, '[\\s$.,/\\-:]', '', 'g')) AS dense, {COUNTED.format(t='t', c='a-zA-Z0-9')} AS alnum, {COUNTED.format(t='t', c='a-zA-Z')} AS alpha, {COUNTED.format(t='t', c='aeiouAEIOU')} AS vowels,
 list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(9) || chr(13) || ' ')), lambda x: length(x) >= 5) AS ls FROM t LEFT JOIN g USING (doc_id)),
q AS (SELECT *, len(list_filter(ls, lambda x: {COUNTED.format(t='x', c='a-zA-Z0-9')} * 2 < length(x) OR regexp_matches(x, '[|_]{{3,}}'))) / greatest(len(ls), 1) AS nl FROM m)"""


@query("""SELECT doc_id, n >= 50 AND (cid / greatest(n / 8, 1) > 0.25 OR (symbols + odd) / greatest(n, 1) > 0.15 OR symbols / greatest(n, 1) > 0.10 OR ((symbols + odd) / greatest(n, 1) > 0.08 AND words / greatest(n / 5, 1) < 0.20) OR runs > 3) AS is_noise,
 list_filter([CASE WHEN cid > 5 THEN 'cid' END, CASE WHEN round(CASE WHEN dense > 0 THEN 1 - alnum / dense ELSE 1 END, 4) > 0.3 THEN 'noise' END, CASE WHEN alpha > 100 AND round(vowels / greatest(alpha, 1), 4) < 0.22 THEN 'vowels' END, CASE WHEN round(nl, 4) > 0.15 THEN 'lines' END], lambda x: x IS NOT NULL) AS reasons FROM q""", NOISE)
def text_noise(spark, d):
    q = docs_ops.quality(F.col("text"))
    return readers.table(spark, d, "documents").select("doc_id", docs_ops.is_noise(F.col("text")).alias("is_noise"), docs_ops.quality_reasons(q).alias("reasons"))


NAME_RULES = [("NEWS", ["src1", "src2"]), ("WIKI", ["src3"])]
CONTENT_RULES = [("TABLE", [" | "], 1), ("PROSE", ["the", "der", "le"], 1)]


@query("""SELECT doc_id, CASE WHEN contains(source, 'src1') OR contains(source, 'src2') THEN 'NEWS' WHEN contains(source, 'src3') THEN 'WIKI' WHEN contains(lower(text), ' | ') THEN 'TABLE' WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'le') THEN 'PROSE' ELSE 'UNKNOWN' END AS class FROM documents""")
def doc_classify(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", docs_ops.classify(F.col("source"), F.col("text"), NAME_RULES, CONTENT_RULES).alias("class"))


PAGED = "p AS (SELECT conv_id, turn, text, list_filter(['the ', 'and '], lambda x: contains(lower(text), x)) AS m FROM conversations), q AS (SELECT *, lag(m) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, max(turn) OVER (PARTITION BY conv_id) AS lastt, min(turn) OVER (PARTITION BY conv_id) AS zero FROM p), s AS (SELECT * FROM q WHERE len(m) > 0 AND (prev IS NULL OR len(prev) = 0 OR NOT list_has_any(m, prev)))"


@query("SELECT conv_id, turn AS first_page, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, lastt) AS last_page FROM s UNION ALL SELECT conv_id, min(turn), max(turn) FROM q WHERE conv_id NOT IN (SELECT conv_id FROM s) GROUP BY conv_id", PAGED)
def boundary_ranges(spark, d):
    return docs_ops.ranges(readers.table(spark, d, "conversations"), "conv_id", "turn", "text", ["the ", "and "])


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN 'head' WHEN length(text) > 200 THEN 'long' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def page_tagging(spark, d):
    c = readers.table(spark, d, "conversations")
    return docs_ops.tag_sections(c, "conv_id", "turn", [("head", F.col("role") == "system"), ("long", F.length("text") > 200)]).select("conv_id", "turn", "section")


@query("""SELECT conv_id, turn, concat_ws(chr(10), text, nxt) AS "window" FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE nxt IS NOT NULL OR n = 1""")
def page_windows(spark, d):
    return docs_ops.page_pairs(readers.table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT doc_id, CAST(k AS INTEGER) AS chunk, substring(text, greatest(k * 1000 - 100, 0) + 1, k * 1000 + 1000 - greatest(k * 1000 - 100, 0)) AS part FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 1000 + 1)) AS k FROM documents)""")
def chunk_windows(spark, d):
    return docs_ops.overlapping_chunks(readers.table(spark, d, "documents"), "doc_id", "text", 1000, 100)


@query("SELECT doc_id, page, text FROM (SELECT doc_id, CAST(generate_subscripts(parts, 1) - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS page, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE page > 0 OR trim(text, ' ') <> ''")
def page_split(spark, d):
    """Every line is a page, marked as such; odd documents begin with a mark."""
    marked = F.regexp_replace("text", "\n", "[[PAGE_7]]")
    docs = readers.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.concat(F.lit("[[PAGE_1]]"), marked)).alias("text"))
    return docs_ops.split_pages(docs, "doc_id", "text")


# ---------------------------------------------------------------- sets


@query("SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier")
def union_sources(spark, d):
    c = readers.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return setops.union_all([c, readers.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))])


@query("""SELECT k, 'left' AS side FROM (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders) UNION ALL
 SELECT k, 'right' FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders EXCEPT ALL SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber <= 3)""")
def except_rows(spark, d):
    li = readers.table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("k"))
    return setops.sheet_diff(li, readers.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("""SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) + (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS same_set,
 (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) + (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) = 0 AS same_multiset""")
def multiset_equality(spark, d):
    return setops.same_rows(readers.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), readers.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("""SELECT k, path, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM (
 SELECT o_orderkey AS k, 'status' AS path, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS old, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS new FROM orders) WHERE old IS DISTINCT FROM new""")
def json_diff(spark, d):
    o = readers.table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.select(k.alias("k"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("status"))
    new = o.select(k.alias("k"), F.when(k % 7 != 0, F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("status"))
    return setops.record_diff(old, new, ["k"], ["status"])


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def distinct_list(spark, d):
    return setops.distinct_list(readers.table(spark, d, "nation"), "n_regionkey", "n_name", "nations")


@query("SELECT 'nation' AS sheet, CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def pipe_lines(spark, d):
    return writers.pipe_lines(readers.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


# ---------------------------------------------------------------- scalar cleaners
