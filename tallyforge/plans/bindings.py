"""The driver's tables in the roles of the operators, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents
from ..sources.readers import table

STATE_FACTORS = {"GERMANY": 1.0, "FRANCE": 2.0, "JAPAN": 3.0, "CHINA": 6.0, "BRAZIL": 8.0}
CLASS_FACTORS = {"Brand#11": 1.0, "Brand#22": 3.0, "Brand#33": 6.0, "Brand#44": 8.0, "Brand#55": 10.0}


#: The tables behind the columns of a claim that are not on the order line itself.
BEHIND = {"cause": "orders", "client": "customer", "account": "customer", "state": "nation", "class_code": "part", "class_text": "part", "carrier": "supplier"}


def claims(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """A claim per order line, with the columns ``extra`` from other tables.  Only tables that
    a column needs are joined: Spark does not drop an inner join that nobody reads from."""
    li = table(spark, d, "lineitem")
    price, cut = cents(F.col("l_extendedprice")), cents(F.col("l_discount"))
    c = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_number"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSED").alias("status"),
        price.alias("incurred"), (price - price * cut).alias("paid"), (price * cut).alias("reserve"), (F.col("l_returnflag") == "R").alias("litigated"),
        F.col("l_shipdate").cast("date").alias("loss_date"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").cast("string").alias("policy"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    need = {BEHIND[x] for x in extra}
    if need & {"orders", "customer", "nation"}:
        o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("cause"))
        if need & {"customer", "nation"}:
            o = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("client"), F.col("c_mktsegment").alias("account"), "c_nationkey"), "o_custkey")
        if "nation" in need:
            o = o.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state")), "c_nationkey")
        c = c.join(o, "l_orderkey")
    if "part" in need:
        c = c.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class_code"), F.col("p_type").alias("class_text")), "l_partkey")
    if "supplier" in need:
        c = c.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("carrier")), "l_suppkey")
    return c


CLAIMS = """claims AS (
  SELECT l_orderkey * 10 + l_linenumber AS claim_number, c_name AS client, c_mktsegment AS account, n_name AS state,
         CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status, price AS incurred, price - price * cut AS paid, price * cut AS reserve,
         l_returnflag = 'R' AS litigated, p_brand AS class_code, p_type AS class_text, o_orderpriority AS cause,
         CAST(l_shipdate AS DATE) AS loss_date, CAST(year(l_shipdate) AS INTEGER) AS year, s_name AS carrier, CAST(l_suppkey AS VARCHAR) AS policy,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS cut FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request per event."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), status.alias("status"), F.col("event_type").alias("document_type"), F.col("value").alias("processing_time"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("filename"), F.get_json_object("props", "$.k").alias("error_details"), F.col("props").alias("metadata"), "user_id",
    )


REQUESTS = """requests AS (
  SELECT event_id AS id, ts AS timestamp,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
         event_type AS document_type, value AS processing_time, 'user' || CAST(user_id AS VARCHAR) || '.pdf' AS filename,
         json_extract_string(props, '$.k') AS error_details, props AS metadata, user_id FROM events)"""


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """A bank transaction per event; every seventh event prints no balance."""
    e = table(spark, d, "events")
    desc = F.when(F.col("event_type") == "purchase", "Card purchase").when(F.col("event_type") == "error", "Check payment").otherwise(F.concat(F.lit("Deposit "), "event_type"))
    return e.select(
        "user_id", "event_id", "ts", F.date_format("ts", "MM/dd").alias("date"), desc.alias("description"), cents(F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("check_no"),
        F.when(F.col("event_id") % 7 == 0, cents(F.col("value") * 2)).alias("running_balance"),
    )


TRANSACTIONS = """tx AS (
  SELECT user_id, event_id, ts, strftime(ts, '%m/%d') AS date,
         CASE event_type WHEN 'purchase' THEN 'Card purchase' WHEN 'error' THEN 'Check payment' ELSE 'Deposit ' || event_type END AS description,
         CAST(value AS DECIMAL(18,2)) AS amount, CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END AS check_no,
         CASE WHEN event_id % 7 = 0 THEN CAST(value * 2 AS DECIMAL(18,2)) END AS running_balance FROM events)"""


def ai_calls(spark: SparkSession, d: str) -> DataFrame:
    """A model call per turn; four characters count as a token."""
    c = table(spark, d, "conversations")
    tokens = F.floor(F.length("text") / 4).cast("long")
    return c.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "gpt-4o").when(F.col("conv_id") % 3 == 1, "gpt-4o-mini").otherwise("other").alias("model"),
        F.when(F.col("role") == "user", tokens).otherwise(0).alias("prompt_tokens"), F.when(F.col("role") == "user", 0).otherwise(tokens).cast("long").alias("completion_tokens"), F.lit(2).alias("pages"),
    )


CALLS = """calls AS (
  SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model,
         CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END AS prompt_tokens, CASE WHEN role = 'user' THEN 0 ELSE length(text) // 4 END AS completion_tokens,
         CASE conv_id % 3 WHEN 1 THEN 0.00015 ELSE 0.0025 END AS pin, CASE conv_id % 3 WHEN 1 THEN 0.0006 ELSE 0.01 END AS pout FROM conversations)"""
