"""Queries of printed lines, chunks and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as docs_ops, invoice_lines as ops, monitoring
from ..sources import readers
from . import bindings as b
from .catalog import query
from .invoice_queries import pick

NAMES = ["STONE", "RAY LEE", "DE LA CRUZ"]


def _lines(df, *texts):
    """(doc, pos, line): the texts of each row of (doc, n), in order."""
    exploded = df.select("doc", "n", F.posexplode(F.array(*texts)).alias("p", "line"))
    return exploded.select("doc", (F.col("n") * len(texts) + F.col("p")).alias("pos"), "line")


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _events(spark, d):
    e = readers.table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("s"))


def _double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("current", "adjustment")})


def sql_names(k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in NAMES) + f"][{k} % {len(NAMES)} + 1]"


E = "e AS (SELECT user_id AS doc, event_id AS n, CAST(event_id AS VARCHAR) AS s FROM events)"


@query(f"""SELECT doc, {sql_names('n')} AS last, 'ANN B' AS first, p.plan AS plan, CASE WHEN n % 5 <> 0 THEN ['EE', 'ES', 'EE + CH'][n % 3 + 1] END AS tier, p.v::DOUBLE AS current FROM e, LATERAL (SELECT unnest(
 CASE doc % 3 WHEN 0 THEN [{{'plan': 'Life', 'v': n % 7 + 0.5}}, {{'plan': 'HSA Fee', 'v': -3.25}}] WHEN 1 THEN [{{'plan': 'LTD', 'v': 0.0}}, {{'plan': 'SPD', 'v': 4.0}}] ELSE [{{'plan': 'DOL ACF', 'v': 1.5}}, {{'plan': 'ACF CREDIT', 'v': n % 7 + 0.5}}, {{'plan': 'Flex Fee', 'v': -3.25}}] END) AS p)
 WHERE p.v <> 0 UNION ALL SELECT DISTINCT doc, '', 'INVOICE TOTAL', 'REPORTED INVOICE TOTAL (FOR AUDIT)', NULL, 1234.5 FROM e""", E)
def location_lines(spark, d):
    """Pages of three invoices, each told by its heading alone; the names run into the dates."""
    e = _events(spark, d)
    numbers = F.when(F.col("doc") % 3 == 1, "0.00 9 9 4.00 1 1 0").otherwise(_c(F.when(F.col("doc") % 3 == 0, "7").otherwise("1.50"), " ", (F.col("n") % 7).cast("string"), ".50 0 0 0 3.25-"))
    row = _c(pick(NAMES, F.col("n")), ", ANN B", F.when(F.col("n") % 2 == 0, "").otherwise(" "), "01/31/1980 ", F.when(F.col("n") % 5 == 0, "3337").otherwise(pick(["EE", "ES", "EE + CH"], F.col("n"))), "  ", numbers)
    head = F.when(F.col("doc") % 3 == 0, "Group Dep Life bill").when(F.col("doc") % 3 == 1, "no 12902").otherwise("Dental")
    docs = e.select("doc").distinct()
    lines = e.select("doc", F.col("n").alias("pos"), row.alias("line")).unionByName(docs.select("doc", F.lit(-1).cast("long").alias("pos"), head.alias("line")))
    lines = lines.unionByName(docs.select("doc", F.lit(1 << 40).alias("pos"), F.lit("** Location Totals   3  1,234.50").alias("line"))).withColumn("page", F.lit(1))
    return _double(ops.location_rows(lines)).select("doc", "last", "first", "plan", "tier", "current")


@query(f"""SELECT doc, {sql_names('n')} AS last, 'ANN' AS first, s AS member, CASE WHEN n % 3 = 0 THEN 'DTS' ELSE 'COMBINED' END AS plan, CASE n % 3 WHEN 0 THEN 'STD' ELSE 'LTD+STD' END AS kind, (CASE n % 3 WHEN 0 THEN 3.3 WHEN 1 THEN 173.31 ELSE 137.68 END)::DOUBLE AS current FROM e""", E)
def mirrored_lines(spark, d):
    e = _events(spark, d)
    name = _c(F.reverse("s"), " :ON DI NNA ,", F.reverse(pick(NAMES, F.col("n"))), " :EMAN")
    k = F.col("n") % 3
    lines = _lines(e, name, F.when(k == 0, "TSOC EE").otherwise("13.371$ 83.431$ AEDA SS 09/09 057,3 DTL"), F.lit("03.3$ 03.3$ SKEEW 11 41/41 001 DTS"), F.when(k == 1, "13.371$ 13.371$ SLATOT").otherwise("x"))
    return _double(ops.turned_rows(lines)).select("doc", "last", "first", "member", "plan", "kind", "current")


@query(f"""SELECT doc, {sql_names('n')} AS last, 'ANN' AS first, CASE WHEN n % 2 = 0 THEN s END AS member, CASE WHEN n % 3 = 0 THEN 'Voluntary Life - Spouse' WHEN n % 3 = 1 THEN 'GIS BENEFIT' ELSE 'Dental HMO' END AS plan,
 CASE WHEN n % 3 = 0 THEN 'LIFE' WHEN n % 3 = 1 THEN 'MEDICAL' ELSE 'DENTAL' END AS kind, CASE WHEN n % 3 = 0 THEN 'ES' ELSE 'EE' END AS tier, CASE WHEN n % 3 = 2 THEN -7.25 ELSE n % 100 + 0.5 END::DOUBLE AS current FROM e WHERE doc % 2 = 0
 UNION ALL SELECT doc, {sql_names('n')}, 'ANN', CASE WHEN n % 2 = 0 THEN s END, 'GIS BENEFIT', 'MEDICAL', 'EE', unnest(CASE WHEN n % 3 = 2 THEN [7.25] ELSE [2.0, n % 100 + 0.5] END)::DOUBLE FROM e WHERE doc % 2 = 1""", E)
def benefit_lines(spark, d):
    """Lists of one premium a line, and wide lines of several; every second person is known by
    a masked number only."""
    e = _events(spark, d)
    k = F.col("n") % 3
    head = _c(F.when(F.col("n") % 2 == 0, F.col("s")).otherwise("XXX-XX-1234"), " ", pick(NAMES, F.col("n")), ", ANN 01/02/2026 ")
    value = F.when(k == 2, "(7.25)").otherwise(_c((F.col("n") % 100).cast("string"), ".50"))
    rest = F.when(F.col("doc") % 2 == 1, _c(F.when(k == 2, "$0.00").otherwise("$2.00"), "  ", value)).otherwise(_c(F.when(k == 0, "Voluntary Life - Spouse ").when(k == 1, "").otherwise("Dental HMO  "), "$", value))
    lines = _lines(e, _c(head, rest), F.lit("All Employees Totals: 9.99"))
    return _double(ops.benefit_lines(lines, F.col("doc") % 2 == 0)).select("doc", "last", "first", "member", "plan", "kind", "tier", "current")


@query("SELECT c_custkey, '1/2/2026' AS \"INV_DATE\", 'N' || CAST(c_custkey AS VARCHAR) AS \"INV_NUMBER\", CASE WHEN c_custkey % 2 = 0 THEN '02/01/2026' END AS \"BILLING_PERIOD\" FROM customer")
def benefit_header(spark, d):
    k = F.col("c_custkey")
    text = _c("INVOICE DATE: 1/2/2026\ninvoice # N", k.cast("string"), " \nBilling Period ", F.when(k % 2 == 0, "02/01/2026 - 2/28/2026").otherwise("02/01/2026"))
    return readers.table(spark, d, "customer").select("c_custkey", ops.benefit_header(text).alias("h")).select("c_custkey", "h.*")


@query(f"""SELECT doc, l AS last, 'Ann' AS first, p.plan AS plan, p.kind AS kind, p.tier AS tier, p.v::DOUBLE AS current FROM (SELECT doc, n, last_value(CASE WHEN n % 2 = 0 THEN {sql_names('n')} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS l FROM e) q,
 LATERAL (SELECT unnest([{{'plan': 'Dental', 'kind': 'DENTAL', 'tier': CASE n % 4 WHEN 0 THEN 'FAM' WHEN 1 THEN 'ES' WHEN 2 THEN 'EC' ELSE 'EE' END, 'v': 12.5}}, {{'plan': 'Std', 'kind': 'STD', 'tier': '', 'v': n % 9 + 0.25}}, {{'plan': 'Voluntary Term Life', 'kind': 'LIFE', 'tier': '', 'v': 3.0}}]) AS p) WHERE l IS NOT NULL""", E)
def grid_lines(spark, d):
    """A table with bars whose odd lines have no name; two premiums share a cell."""
    e = _events(spark, d)
    tier = pick(["Emp,Sp,Ch", "Emp & Sp", "ch", "Emp"], F.col("n"))
    row = _c("| ", F.when(F.col("n") % 2 == 0, _c(pick(NAMES, F.col("n")), ", Ann")).otherwise("Continued"), " | 10.00 2.50 | ", tier, " | | | | | ", (F.col("n") % 9).cast("string"), ".25 | | | 100,000 | | 3.00 | |")
    docs = e.select("doc").distinct()
    at = lambda pos, line: docs.select("doc", F.lit(pos).cast("long").alias("pos"), F.lit(line).alias("line"))
    lines = e.select("doc", F.col("n").alias("pos"), row.alias("line")).unionByName(at(-3, "| STONE, Ann | 9.00 | | | | | | | | | | | | | |")).unionByName(at(-2, "| Current Premiums |")).unionByName(at(-1, "| Employee | 1.00 | | | | | | | | | | | | | |"))
    lines = lines.unionByName(at(1 << 40, "Summary of Current Premiums")).unionByName(at(1 << 41, "| X, Y | 9.00 | | | | | | | | | | | | | |"))
    return _double(ops.grid_rows(lines)).select("doc", "last", "first", "plan", "kind", "tier", "current")


@query(f"""SELECT doc, {sql_names('n')} AS last, 'Ann' AS first, CAST(10000 + n AS VARCHAR) AS member, x.plan AS plan, x.kind AS kind, x.tier AS tier, x.c::DOUBLE AS current, x.a AS adjustment FROM e, LATERAL (SELECT unnest([
 {{'plan': 'Life Vol EE', 'kind': 'LIFE', 'tier': 'EE', 'c': n % 50 + 1.5, 'a': NULL::DOUBLE}}, {{'plan': 'VDEN plus', 'kind': 'DENTAL', 'tier': 'ES', 'c': 1020.25, 'a': NULL}}, {{'plan': 'VDEN plus', 'kind': 'DENTAL', 'tier': 'EE', 'c': NULL, 'a': 4.5}}]) AS x)""", E)
def detail_lines(spark, d):
    e = _events(spark, d)
    lines = _lines(
        e, _c("  *", pick(NAMES, F.col("n")), ", Ann   ", (F.col("n") + 10000).cast("string"), " Participant 04/01/25 Life Vol EE 20,000 ", (F.col("n") % 50 + 1).cast("string"), ".50"), F.lit("Group ID: 7 Ppt 04/01/25 Life 1.00"),
        F.lit("        Spouse 4/1/2025 VDEN plus 1,020.25"), F.lit("   Retroactive Change 03/01/2025 4.50"), F.lit("        Dep 4/1/2025 Zero 0.00"),
    )
    return _double(ops.detail_rows(lines)).select("doc", "last", "first", "member", "plan", "kind", "tier", "current", "adjustment")


@query(f"SELECT doc, n * 3 + x.p AS pos, x.line AS line FROM e, LATERAL (SELECT unnest([{{'p': 0, 'line': '  ' || {sql_names('n')} || ', Ann  ' || CAST(10000 + n AS VARCHAR) || ' Spouse 1'}}, {{'p': 1, 'line': ' ' || {sql_names('n')} || ', Ann  ' || CAST(10000 + n AS VARCHAR) || ' Dep 4/1/25 Life 2'}}, {{'p': 2, 'line': 'Dep of none'}}]) AS x)", E)
def identity_lines(spark, d):
    e = _events(spark, d)
    return ops.with_identity(_lines(e, _c("  ", pick(NAMES, F.col("n")), ", Ann  ", (F.col("n") + 10000).cast("string"), " Spouse 1"), F.lit("     Dep 4/1/25 Life 2"), F.lit("Dep of none")))


# ---------------------------------------------------------------- chunks


CHUNKS = """t AS (SELECT doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM documents WHERE text IS NOT NULL)"""


@query("""SELECT doc_id, x.chunk AS chunk, x.policy AS policy, x.part AS part FROM t, LATERAL (SELECT unnest(CASE doc_id % 3 WHEN 0 THEN [{'chunk': 0, 'policy': 'Unknown', 'part': t}]
 WHEN 1 THEN [{'chunk': 1, 'policy': 'A1', 'part': trim('Policy A1 ' || t)}, {'chunk': 2, 'policy': 'B22', 'part': trim(right('Policy A1 ' || t || ' ', 5) || 'Policy B22', ' ' || chr(10))}]
 ELSE [{'chunk': 0, 'policy': 'Initial Section', 'part': 'Initial text ' || t}, {'chunk': 1, 'policy': 'C3', 'part': 'Policy C3'}] END) AS x)""", CHUNKS)
def policy_chunks(spark, d):
    t = F.btrim(F.col("text"), F.lit(" \t\r\n\x0b\x0c"))
    k = F.col("doc_id") % 3
    docs = readers.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.when(k == 0, t).when(k == 1, _c("Policy A1 ", t, " Policy B22")).otherwise(_c("Initial text ", t, " Policy C3")).alias("text"))
    return docs_ops.policy_chunks(docs, "doc_id", "text", r"Policy ([A-Z]\d+)", 5)


@query("""SELECT doc_id, x.piece AS piece, x.policy AS policy, x.part AS part FROM (SELECT doc_id, t, greatest(length(t) - 1, 0) // 50 AS last FROM t) q, LATERAL (SELECT unnest(CASE WHEN doc_id % 2 = 0 AND length(t) > 50 THEN [{'piece': i::INTEGER, 'policy': 'P (part ' || CAST(i + 1 AS VARCHAR) || ')', 'part': substring(t, i * 50 + 1, 50)} FOR i IN range(0, last + 1)]
 WHEN doc_id % 2 = 0 THEN [{'piece': 0, 'policy': 'P', 'part': t}] ELSE [{'piece': 0, 'policy': 'P (page 2)', 'part': 'head ' || t}, {'piece': 1, 'policy': 'P (page 2+)', 'part': '=====' || chr(10) || 'Page 2' || chr(10) || '=====' || chr(10) || repeat('z', 50)}] END) AS x)""", CHUNKS)
def oversized_chunks(spark, d):
    t = F.btrim(F.col("text"), F.lit(" \t\r\n\x0b\x0c"))
    text = F.when(F.col("doc_id") % 2 == 0, t).otherwise(_c("head ", t, "\n=====\nPage 2\n=====\n" + "z" * 50))
    c = readers.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit("P").alias("policy"), text.alias("part"))
    return docs_ops.split_oversized(c, ["doc_id"], "policy", "part", 50)


@query("SELECT lang AS doc, count(*) AS num_chunks, sum(length(text))::BIGINT AS total_chars, max(length(text))::INTEGER AS longest, min(length(text))::INTEGER AS shortest FROM documents GROUP BY 1")
def chunk_report(spark, d):
    return docs_ops.chunk_report(readers.table(spark, d, "documents").select(F.col("lang").alias("doc"), F.col("text").alias("part")), "doc", "part")


@query("""SELECT conv_id AS doc, turn AS first_page, 0 AS piece, CASE WHEN turn % 4 = 3 THEN 'mixed' ELSE 'detail' END AS type, CASE WHEN turn % 4 = 3 THEN 'Totals: ' || text ELSE string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id, b, k, turn % 4 = 3 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS part
 FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id, b, turn % 4 = 3 ORDER BY turn) - 1) // 2 AS k FROM (SELECT *, count(*) FILTER (turn % 4 = 3) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)) QUALIFY turn % 4 = 3 OR row_number() OVER (PARTITION BY conv_id, b, k, turn % 4 = 3 ORDER BY turn) = 1""",
       "c AS (SELECT conv_id, min(turn) AS turn, trim(replace(min(text), chr(10), ' ')) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn)")
def structural_chunks(spark, d):
    c = readers.table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.trim(F.replace(F.min("text"), F.lit("\n"), F.lit(" "))).alias("text"))
    return docs_ops.structural_chunks(c.select(F.col("conv_id").alias("doc"), "turn", F.when(F.col("turn") % 4 == 3, _c("Totals: ", F.col("text"))).otherwise(F.col("text")).alias("text")), "doc", "turn", "text", 2, 1 << 30)


@query("""SELECT s_nationkey AS doc, string_agg(line, chr(10) ORDER BY o, k) AS table FROM (SELECT s_nationkey, s_suppkey AS k, row_number() OVER w > 1 AS later, 0 AS z, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 2 END AS o, rpad(s_name, (max(length(s_name)) OVER (PARTITION BY s_nationkey))::INTEGER, ' ') || ' | ' || rpad(CAST(s_suppkey AS VARCHAR), (max(length(CAST(s_suppkey AS VARCHAR))) OVER (PARTITION BY s_nationkey))::INTEGER, ' ') AS line
 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey) UNION ALL SELECT s_nationkey, 0, true, 0, 1, repeat('-', max(length(s_name))) || '-+-' || repeat('-', max(length(CAST(s_suppkey AS VARCHAR)))) FROM supplier GROUP BY s_nationkey) GROUP BY 1""")
def text_tables(spark, d):
    return docs_ops.text_table(readers.table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"), "s_name", F.col("s_suppkey").alias("key")), "doc", "k", ["s_name", "key"])


# ---------------------------------------------------------------- logs


@query("SELECT r.id AS id, s.turn AS turn FROM requests r JOIN conversations s ON s.conv_id = r.id", b.REQUESTS)
def request_steps(spark, d):
    steps = readers.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn")
    return monitoring.request_steps(b.requests(spark, d), steps, "id").select("id", "turn")


@query("SELECT id, CASE WHEN user_id % 2 = 0 THEN '/a/' || filename END AS path FROM requests", b.REQUESTS)
def resolved_paths(spark, d):
    r = b.requests(spark, d)
    cache = r.where("user_id % 2 = 0").select(F.col("filename").alias("file"), F.explode(F.array(F.concat(F.lit("/b/"), "filename"), F.concat(F.lit("/a/"), "filename"))).alias("path"))
    return monitoring.resolved_paths(r, "filename", cache).select("id", "path")


@query("SELECT conv_id, count(*) + 1 AS calls, (sum(length(text)) + 2 * count(*) + 7)::BIGINT AS total_ai_tokens, (count(*) * 0.5 + 0.25)::DOUBLE AS total_ai_cost FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def added_calls(spark, d):
    call = F.struct(F.length("text").alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(0.5).alias("total_cost"))
    c = readers.table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.collect_list(call).alias("calls"))
    new = F.struct(F.lit(7).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.lit(0.25).alias("total_cost"))
    return monitoring.with_call(c, "calls", new).select("conv_id", F.size("calls").cast("long").alias("calls"), "total_ai_tokens", "total_ai_cost")


@query("SELECT id, status, filename FROM requests UNION ALL SELECT -id, 'logged', NULL FROM requests WHERE id % 10 = 0", b.REQUESTS)
def appended_log(spark, d):
    r = b.requests(spark, d)
    return monitoring.appended(r.select("id", "status", "filename"), r.where("id % 10 = 0").select((-F.col("id")).alias("id"), F.lit("logged").alias("status"), F.lit(1).alias("other")))


@query("""SELECT event_id, CASE WHEN c >= 3 THEN least(60 * pow(2, least(c - 2, 60)), 300) ELSE 60 END::DOUBLE AS wait FROM (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id, run ORDER BY event_id) AS c FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events))""")
def poll_waits(spark, d):
    e = readers.table(spark, d, "events").withColumn("found", (F.col("event_type") == "error").cast("int"))
    return monitoring.poll_interval(e, "user_id", "event_id", "found", 60).select("event_id", "wait")
