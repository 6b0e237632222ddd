"""Further queries: line and page sequences, matching, totals and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plans, text
from ..operators import bank, invoices, lines, monitoring, setops
from ..sources import readers
from . import bindings as b
from .catalog import query


def _lines(spark, d):
    return lines.to_lines(readers.table(spark, d, "documents"), "doc_id", "text")


LINES = "l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@query("""SELECT doc_id, CAST(run AS BIGINT) AS "row", string_agg(line, ' ' ORDER BY pos) AS line FROM (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-F]')) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l) WHERE run > 0 GROUP BY 1, 2""", LINES)
def continuation_rows(spark, d):
    return lines.join_continuations(_lines(spark, d), "doc_id", "pos", "line", F.col("line").rlike("^[A-F]"))


@query("SELECT event_id, strftime(ts, '%m/%d') AS date, event_type AS description, printf('%.2f', value) AS amount FROM events")
def dated_rows(spark, d):
    e = readers.table(spark, d, "events")
    line = F.concat(F.date_format("ts", "MM/dd"), F.lit("  "), "event_type", F.lit("   "), F.col("value").cast("decimal(18,2)").cast("string"))
    return e.select("event_id", lines.dated_row(line).alias("r")).select("event_id", "r.*")


@query("SELECT o_orderkey, 0 AS n, '100' || CAST(o_orderkey AS VARCHAR) AS number, '1/2' AS date, '3.50' AS amount FROM orders UNION ALL SELECT o_orderkey, 1, '200' || CAST(o_orderkey AS VARCHAR), '11/12', '1,004.00' FROM orders")
def check_triples(spark, d):
    k = F.col("o_orderkey").cast("string")
    o = readers.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("100"), k, F.lit(" 1/2 3.50   200"), k, F.lit(" 11/12 1,004.00")).alias("line"))
    return lines.repeated_triples(o, "line", ["o_orderkey"])


@query("""SELECT doc_id, CASE WHEN s > 0 THEN CASE WHEN e > 0 THEN substring(text, s, e) ELSE substring(text, s) END END AS part FROM (SELECT *, instr(substring(text, s + 1), '.') AS e FROM (SELECT doc_id, text, instr(text, 'the') AS s FROM documents))""")
def section_slice(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", lines.section(F.col("text"), "the", [r"\."]).alias("part"))


@query("SELECT string_agg(s_name, ', ' ORDER BY s_suppkey) AS vendors FROM (SELECT s_name, s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)")
def first_vendors(spark, d):
    """The first five vendors of a summary page."""
    return invoices.first_vendors(readers.table(spark, d, "supplier"), "s_name", ["s_suppkey"])


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Dental' WHEN 1 THEN NULL END AS type, CASE c_custkey % 3 WHEN 0 THEN 'Dental' WHEN 1 THEN 'BLUECARE NFQ' END AS plan FROM customer")
def blue_plans(spark, d):
    """Blue plans have no type; bare categories are both type and name."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Dental").when(k % 3 == 1, "JAX NFO BLUECARE USE")
    return readers.table(spark, d, "customer").select("c_custkey", plans.blue_type(name).alias("type"), plans.blue_plan(name).alias("plan"))


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM l WHERE pos % 6 = 0", LINES)
def header_gaps(spark, d):
    return lines.headers_apart(_lines(spark, d), "doc_id", "pos", 5)


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type OR b IS NULL")
def new_starts(spark, d):
    return lines.new_starts(readers.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def capped_rows(spark, d):
    return lines.first_rows(readers.table(spark, d, "events"), "user_id", ["ts", "event_id"], F.lit(5)).select("event_id")


@query("SELECT user_id, CAST(bt AS INTEGER) AS batch, list(event_id ORDER BY event_id) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS bt FROM events WHERE event_type = 'error') GROUP BY 1, 2")
def id_batches(spark, d):
    return lines.batches(readers.table(spark, d, "events").where("event_type = 'error'"), "user_id", "event_id", 5)


@query("SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 0 THEN turn + 10 WHEN turn % 3 = 1 THEN turn + 20 ELSE turn END AS INTEGER) AS page FROM conversations")
def page_order(spark, d):
    t = F.col("turn")
    stated = F.when(t % 3 == 0, F.format_string("Page %d of 99", t + 10)).when(t % 3 == 1, F.format_string("page  %d", t + 20)).otherwise("no number")
    return readers.table(spark, d, "conversations").select("conv_id", "turn", lines.logical_page(stated, t).alias("page"))


@query("SELECT year, rank FROM (SELECT year, row_number() OVER (ORDER BY year = 'n/a', CASE WHEN year <> 'n/a' THEN CAST(year AS INTEGER) END, year) AS rank FROM (SELECT DISTINCT CASE WHEN year(o_orderdate) = 1996 THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders))")
def year_sort(spark, d):
    from pyspark.sql import Window

    y = F.when(F.year("o_orderdate") == 1996, "n/a").otherwise(F.year("o_orderdate").cast("string"))
    years = readers.table(spark, d, "orders").select(y.alias("year")).distinct()
    return years.withColumn("rank", F.row_number().over(Window.orderBy(*lines.year_order(F.col("year")))))


@query("""SELECT year, s_suppkey FROM (SELECT year, s_suppkey, row_number() OVER (PARTITION BY year ORDER BY s_suppkey) AS rn FROM (SELECT s_suppkey, unnest([CAST(1990 + s_suppkey % 5 AS VARCHAR), CAST(1990 + s_suppkey % 7 AS VARCHAR)]) AS year FROM supplier)) WHERE rn = 1""")
def summary_years(spark, d):
    k = F.col("s_suppkey")
    s = readers.table(spark, d, "supplier").withColumn("years", F.concat((k % 5 + 1990).cast("string"), F.lit(" , "), (k % 7 + 1990).cast("string")))
    return lines.explode_years(s, "years", ["s_suppkey"]).select("year", "s_suppkey")


@query("""SELECT k, match, rule FROM (SELECT c_custkey AS k, c_custkey AS match, 'id' AS rule FROM customer WHERE c_custkey % 2 = 0 UNION ALL
 SELECT c.c_custkey, m.id, 'segment' FROM customer c JOIN (SELECT c_mktsegment, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) m USING (c_mktsegment) WHERE c.c_custkey % 2 = 1)""")
def entity_match(spark, d):
    c = readers.table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"))
    right = c.where("c_custkey % 2 = 0")
    return lines.cascade_match(c.select("k", "c_custkey", "c_mktsegment"), right, "k", [("id", text.id_text(F.col("c_custkey")), text.id_text(F.col("c_custkey"))), ("segment", text.plain(F.col("c_mktsegment")), text.plain(F.col("c_mktsegment")))])


@query("SELECT event_id FROM tx t WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM tx k WHERE k.event_id % 2 = 0 AND k.date = t.date AND abs(k.amount) = abs(t.amount) AND upper(left(k.description, 20)) = upper(left(t.description, 20)))", b.TRANSACTIONS)
def adaptive_rows(spark, d):
    t = b.transactions(spark, d)
    keys = {"d": F.col("date"), "a": F.abs("amount"), "t": F.upper(F.left("description", F.lit(20)))}
    return lines.absent(t.where("event_id % 2 = 1"), t.where("event_id % 2 = 0"), keys).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_mktsegment, 'BUILD|AUTO') AND c_custkey NOT IN (12, 34)")
def keyword_filter(spark, d):
    c = readers.table(spark, d, "customer")
    return c.where(~text.is_summary_label(F.col("c_mktsegment"), "build|auto") & ~F.col("c_custkey").isin(12, 34)).select("c_custkey", "c_name")


@query("SELECT event_id FROM events WHERE (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) + 1 >= 2")
def min_cells(spark, d):
    e = readers.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, 1).alias("a"), F.when(F.col("event_id") % 3 == 0, 1).alias("b"))
    return readers.at_least(e, 2).select("event_id")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey NULLS LAST, c_name NULLS LAST, c_acctbal NULLS LAST, c_custkey) AS place FROM customer")
def members_sorted(spark, d):
    return bank.placed(readers.table(spark, d, "customer"), "c_mktsegment", [*invoices.member_order("c_nationkey", "c_name", "c_acctbal"), "c_custkey"]).select("c_custkey", "place")


@query("SELECT event_type AS batch, count(*) AS total, count(*) FILTER (event_id % 4 = 1) AS succeeded, count(*) FILTER (event_id % 4 <> 1) AS failed, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def batch_stats(spark, d):
    ok = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4 == 1)
    return monitoring.batch_results(readers.table(spark, d, "events").withColumnRenamed("event_type", "batch"), "batch", ok, "value")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(spark, d):
    return setops.counted(readers.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), ["year"], "n")


@query("SELECT count(DISTINCT (c_mktsegment, c_nationkey)) AS pairs, count(*) FILTER (n > 1) AS repeated FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer)")
def pair_counts(spark, d):
    return setops.repeats(readers.table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT role FROM conversations")
def distinct_union(spark, d):
    return setops.sorted_union([readers.table(spark, d, "documents").select(F.col("source").alias("name")), readers.table(spark, d, "conversations").select("role")])


@query("SELECT user_id, json_extract_string(props, '$.k') AS k, 'done' AS state FROM events")
def metadata_merge(spark, d):
    e = readers.table(spark, d, "events")
    m = monitoring.json_merge(F.col("props"), F.lit('{"state": "done"}'))
    return e.select("user_id", m.alias("m")).select("user_id", F.col("m")["k"].alias("k"), F.col("m")["state"].alias("state"))


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS cell, string_split(p_name, ' ')[2] AS next FROM part""")
def pipe_cells(spark, d):
    p = readers.table(spark, d, "part").select("p_partkey", F.concat(F.lit("| "), F.replace("p_name", F.lit(" "), F.lit(" |")), F.lit(" |")).alias("line"))
    cells = lines.cells(F.col("line"))
    return p.select("p_partkey", F.get(cells, F.lit(0)).alias("cell"), F.get(cells, F.lit(1)).alias("next"))
