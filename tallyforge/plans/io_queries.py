"""Queries that write tables and read them back, follow streams, and merge.

Each takes rows of the given tables through a reader, writer, stream or sink in the
shared folder; its SQL says what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bank, lines, scan, setops
from ..sources import readers, shared, store, tables, workbooks, writers
from ..streaming import ledger, requests, streams
from . import bindings as b
from .catalog import query


def _folder(spark) -> str:
    return f"{shared.folder(spark)}/io-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    """The events as a stream, be the table one file or a folder of them."""
    schema, path = readers.table(spark, d, "events").schema, f"{d}/events.parquet"
    return streams.new_rows(spark, path, schema) if store.is_folder(spark, path) else streams.new_rows(spark, d, schema, pattern="events.parquet")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def workbook_sheets(spark, d):
    """Two sheets of a workbook, written and read: names, numbers and missing cells."""
    n, path = readers.table(spark, d, "nation"), f"{_folder(spark)}.xlsx"
    workbooks.write({"names": n.select("n_nationkey", "n_name"), "regions": n.select("n_nationkey", "n_regionkey")}, path)
    names, regions = (workbooks.read(spark, path, s).withColumn("n_nationkey", F.col("n_nationkey").cast("int")) for s in ("names", "regions"))
    kind = lambda c: n.schema[c].dataType
    return names.join(regions.select("n_nationkey", "n_regionkey"), "n_nationkey").select(F.col("n_nationkey").cast(kind("n_nationkey")).alias("n_nationkey"), "n_name", F.col("n_regionkey").cast(kind("n_regionkey")).alias("n_regionkey"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def delimited_sheet(spark, d):
    """A sheet written as delimited text, with an empty column and empty rows that drop out."""
    path = _folder(spark)
    c = readers.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(None).cast("string").alias("nothing"))
    writers.write_sheet(c.unionByName(c.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in c.schema])), path, c.columns)
    back = readers.sheets(spark, path)
    assert "nothing" not in back.columns
    return back.select(F.col("c_custkey").cast(c.schema["c_custkey"].dataType).alias("c_custkey"), "c_name", "c_mktsegment")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS c0, s_name AS c1, CASE WHEN s_suppkey % 3 <> 0 THEN 'x' END AS c2 FROM supplier")
def headerless_lines(spark, d):
    """Delimited text without a header, of which every third line lacks its last cell."""
    path = _folder(spark)
    k = F.col("s_suppkey")
    readers.table(spark, d, "supplier").select(F.concat_ws(",", k.cast("string"), "s_name", F.when(k % 3 != 0, "x")).alias("value")).write.text(path)
    return readers.headerless(spark, path, 3)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def record_files(spark, d):
    """JSON files, one per region, each an object with a list of records, read back with their file's name."""
    n, path = readers.table(spark, d, "nation"), _folder(spark)
    record = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(record).alias("claims"))).alias("value")).write.partitionBy("n_regionkey").text(path)
    back = readers.records(spark, f"{path}/*/*.txt")
    return back.where("SOURCE_FILE LIKE '%.txt'").select(F.col("id").cast(n.schema["n_nationkey"].dataType).alias("id"), "name")


@query("SELECT n_regionkey AS case_id, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def case_folders(spark, d):
    """A folder per case with its rows and a record of how many there are; only cases whose
    record agrees with the rows come out."""
    n, path = readers.table(spark, d, "nation"), _folder(spark)
    writers.write_case(n.select(F.col("n_regionkey").alias("case_id"), "n_name"), path)
    rows = spark.read.parquet(f"{path}/rows").groupBy("case_id").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))
    told = spark.read.json(f"{path}/metadata").select("case_id", "rows")
    kind = n.schema["n_regionkey"].dataType
    return rows.join(told, "case_id").where("n = rows").select(F.col("case_id").cast(kind).alias("case_id"), "n", "last")


@query("SELECT 'csv' AS ext, 'text/csv' AS type, CAST(NULL AS VARCHAR) AS rejected")
def gated_files(spark, d):
    """Files of a folder with their type by content; a table's text passes as what it is."""
    path = _folder(spark)
    readers.table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.csv(path, header=True)
    found = readers.validated(readers.files(spark, path, "*.csv"))
    return found.select(readers.extension(F.col("path")).alias("ext"), "type", "rejected").distinct()


@query("SELECT r_name || chr(10) || 'end' AS text FROM region")
def text_files(spark, d):
    """Whole text files, one per region."""
    path = _folder(spark)
    r = readers.table(spark, d, "region").select("r_name", F.concat("r_name", F.lit("\nend")).alias("value"))
    r.repartition("r_name").write.partitionBy("r_name").text(path)
    return readers.page_texts(spark, f"{path}/*/*.txt").select(F.regexp_replace("text", "\n$", "").alias("text"))


@query("SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS policy FROM customer WHERE c_custkey % 5 <> 0 OR c_acctbal > 0")
def canonical_columns(spark, d):
    """Columns by their aliases, in any case; rows without a name or balance drop out."""
    k = F.col("c_custkey")
    c = readers.table(spark, d, "customer").select(k.alias("ClaimNo"), F.when(k % 5 != 0, F.col("c_name")).alias("nm"), F.col("c_name").alias("INSURED"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    rows = readers.known(c, ["nm", "bal"])
    kind = c.schema["ClaimNo"].dataType
    out = readers.resolve_columns(rows, {"id": ["claim", "CLAIMNO"], "name": ["insured"], "policy": ["policy_no"]})
    return readers.reindexed(out, {"id": kind.simpleString(), "name": "string", "policy": "string"})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def filled_rows(spark, d):
    """Rows with at least three filled cells."""
    k = F.col("n_nationkey")
    n = readers.table(spark, d, "nation").select("n_nationkey", "n_name", F.when(k % 2 == 0, F.col("n_regionkey")).alias("x"))
    return readers.at_least(n, 3).select("n_nationkey", "n_name")


@query("SELECT event_id, event_type FROM events")
def stream_ledger(spark, d):
    """All events through a stream into the ledger, twice: the second run and a replayed batch add nothing."""
    e, path = readers.table(spark, d, "events").select("event_id", "event_type"), _folder(spark)
    stream = lambda: _event_stream(spark, d).select("event_id", "event_type")
    write = ledger.once_into(path, "events", key="event_id")
    streams.run_available(stream(), f"{path}/checkpoint", write)
    streams.run_available(stream(), f"{path}/checkpoint", write)
    write(e, 0)
    return ledger.committed(spark, path, e.schema).select("event_id", "event_type")


STEPS = """s AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (event_type IN ('purchase', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM events),
f AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN (ts, event_id) END) OVER (PARTITION BY user_id, seg) AS first FROM s)"""


@query("SELECT user_id, any_value(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END) FILTER (event_type IN ('purchase', 'error')) AS event, count(*) AS updates FROM f WHERE (ts, event_id) >= first GROUP BY user_id, seg HAVING count(*) FILTER (event_type IN ('purchase', 'error')) > 0", STEPS)
def request_lifecycles(spark, d):
    """Events as updates of requests, through keyed state: a sign-up begins one, a purchase or an
    error ends it.  Of what the stream tells, the ends."""
    path = _folder(spark)
    e = _event_stream(spark, d)
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("reading")
    e = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    told = requests.lifecycles(e, "user_id", "ts", "status", ["event_id"], silence="3650 days")
    streams.run_available(told, f"{path}/checkpoint", ledger.once_into(path, "requests"), "update")
    return ledger.committed(spark, path, told.schema).where("event IN ('completed', 'failed')").select("user_id", "event", "updates")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def merged_state(spark, d):
    """The last event of each user, merged into a keyed table in three parts, of which the second comes twice."""
    e = readers.table(spark, d, "events").select("user_id", "event_id", "event_type")
    table = tables.KeyedTable(spark, _folder(spark), "user_id", buckets=4)
    for part in (0, 1, 1, 2):
        table.merge(e.where(F.col("event_id") % 3 == part), "event_id", f"part-{part}")
    return table.read().select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, 'changed' AS kind, 'a.s' AS path FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'added', 'a.p.q' FROM orders WHERE o_orderkey % 4 = 0
 UNION ALL SELECT o_orderkey, 'changed', 'l' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'added', 'n' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'removed', 'gone' FROM orders WHERE o_orderkey % 5 = 1""")
def json_diff(spark, d):
    """JSON of no fixed form: nested fields, lists as values, whole objects on one side; 1 and 1.0 are the same."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    q = F.when(k % 4 != 0, F.col("o_orderpriority"))
    obj = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    o = readers.table(spark, d, "orders")
    old = obj(a=obj(s=s, p=obj(q=q, one=F.lit(1))), l=F.array(F.lit("x"), s), gone=F.when(k % 5 == 1, F.lit("g")))
    new = obj(a=obj(s=F.when(k % 3 == 0, "X").otherwise(s), p=obj(q=F.col("o_orderpriority"), one=F.lit(1.0))), l=F.when(k % 2 == 0, F.array(F.lit("x"), s)).otherwise(F.array(F.lit("x"))), n=F.when(k % 5 == 0, obj(m=obj(z=F.lit(1)))))
    diff = setops.json_diff(o.select("o_orderkey", F.to_json(old).alias("j")), o.select("o_orderkey", F.to_json(new).alias("j")), "o_orderkey", "j")
    return diff.select("o_orderkey", "kind", "path")


@query("""SELECT event_id, check_no FROM tx WHERE check_no IS NULL OR event_id % 2 = 0 UNION ALL SELECT min(event_id), check_no FROM tx WHERE check_no IS NOT NULL AND event_id % 2 = 1 GROUP BY check_no, amount, date""", b.TRANSACTIONS)
def check_rows_appended(spark, d):
    """Check rows of another reading come in once, if their number, amount and date are not there."""
    t = b.transactions(spark, d).select("event_id", "check_no", "amount", "date")
    have, more = t.where("check_no IS NULL OR event_id % 2 = 0"), t.where("check_no IS NOT NULL AND event_id % 3 <> 2")
    more = more.unionByName(t.where("check_no IS NOT NULL AND event_id % 3 = 2"))
    return lines.append_absent(have, more, ["check_no", "amount", "date"], "event_id").select("event_id", "check_no")


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 AND 'F' || upper(chr(CAST(97 + c_custkey % 5 AS INTEGER))) || '_' || upper(c_mktsegment) NOT IN (SELECT 'F' || upper(chr(CAST(97 + c_custkey % 3 AS INTEGER))) || '_' || upper(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0)""")
def fallback_rows(spark, d):
    """Rows of a second reading whose first and last names the first reading lacks join it."""
    k = F.col("c_custkey")
    c = readers.table(spark, d, "customer")
    first = c.where(k % 2 == 0).select(k, F.concat(F.lit("f"), F.char(97 + k % 3)).alias("first"), F.when(k % 10 != 0, F.lower("c_mktsegment")).alias("last"))
    second = c.where(k % 2 == 1).select(k, F.concat(F.lit("F"), F.char(97 + k % 5)).alias("first"), F.col("c_mktsegment").alias("last"))
    return lines.fallback(first, second, "first", "last").select("c_custkey")


@query("""SELECT event_id, 100 + CASE WHEN turned THEN 1 - n ELSE n - 1 END AS prior, false AS fixed, turned FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
 user_id % 3 = 0 AND count(*) FILTER (event_id % 4 = 0) OVER (PARTITION BY user_id) > 0 AS turned FROM events)""")
def turned_statements(spark, d):
    """Statements of users, of which every third prints balances that agree with turned signs only."""
    e = readers.table(spark, d, "events").select("user_id", "event_id", "ts", F.lit("other").alias("description"), F.lit(1).cast("long").alias("amount"))
    n = scan.running(e, "user_id", ["ts", "event_id"], {"n": ("count", F.col("event_id"))})
    printed = F.when(F.col("event_id") % 4 == 0, 100 + F.when(F.col("user_id") % 3 == 0, -F.col("n")).otherwise(F.col("n")))
    told = bank.audit_balance(n.withColumn("running_balance", printed), "user_id", ["ts", "event_id"], F.lit(100).cast("long"), turn=True)
    return told.select("event_id", "prior", "fixed", "turned")
