"""Queries of claim records by part: analysis, repairs and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import claims as ops
from ..sources import readers
from .catalog import query


def _parts(spark, d):
    """A claim record per order line; estimates are text with signs, some fields are missing."""
    li = readers.table(spark, d, "lineitem")
    p, n = cents(F.col("l_extendedprice")), F.col("l_partkey")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    part = lambda k, x: F.when(n % k != 0, x).cast("decimal(18,2)")
    return li.select(
        key.alias("claim_number"), "l_partkey", "l_suppkey", p.alias("medical_paid"), part(5, F.col("l_quantity")).alias("medical_reserve"), part(3, F.col("l_quantity") * 2).alias("indemnity_paid"),
        part(4, F.col("l_suppkey") - 5).alias("indemnity_reserve"), part(7, F.lit(12.5)).alias("expense_paid"), F.lit(None).cast("decimal(18,2)").alias("expense_reserve"),
        F.when(n % 6 != 0, p + F.when(n % 2 == 0, F.col("l_quantity")).otherwise(0)).cast("decimal(18,2)").alias("total_incurred"),
        F.when(n % 4 == 0, "Open").when(n % 4 == 1, "Closed").when(n % 4 == 2, "Reopened").when(n % 8 == 3, "open").alias("status"),
        F.when(n % 3 == 0, "YES").when(n % 3 == 1, "no").alias("litigation"), F.when(n % 5 == 0, "True").otherwise("false").alias("reopen"),
        F.when(n % 2 == 0, "Medical Only").when(n % 5 != 0, "Indemnity").alias("injury_type"),
        F.when(n % 3 == 0, F.concat(F.lit("$"), F.format_number(F.lit(1000) + n, 2))).when(n % 3 == 1, "n/a").alias("estimated_medical"), (F.col("l_linenumber") * 100).cast("string").alias("estimated_comp"),
    )


PARTS = """parts AS (SELECT l_orderkey * 10 + l_linenumber AS claim_number, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS mp, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS mr,
 CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_quantity * 2 AS DECIMAL(18,2)) END AS ip, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_suppkey - 5 AS DECIMAL(18,2)) END AS ir, CASE WHEN l_partkey % 7 <> 0 THEN 12.5::DECIMAL(18,2) END AS ep,
 CASE WHEN l_partkey % 6 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE 0 END AS DECIMAL(18,2)) END AS inc,
 CASE WHEN l_partkey % 4 = 0 THEN 'Open' WHEN l_partkey % 4 = 1 THEN 'Closed' WHEN l_partkey % 4 = 2 THEN 'Reopened' WHEN l_partkey % 8 = 3 THEN 'open' END AS status, l_partkey % 3 = 0 AS lit, l_partkey % 5 = 0 AS re,
 l_partkey % 2 = 0 AS med_only, CASE WHEN l_partkey % 3 = 0 THEN (1000 + l_partkey)::DECIMAL(18,2) ELSE 0 END AS em, (l_linenumber * 100)::DECIMAL(18,2) AS ec FROM lineitem),
z AS (SELECT *, coalesce(mp, 0) AS zmp, coalesce(mr, 0) AS zmr, coalesce(ip, 0) AS zip, coalesce(ir, 0) AS zir, coalesce(ep, 0) AS zep, coalesce(inc, 0) AS zinc FROM parts)"""

ANALYSIS = """count(*) AS total_claims, sum(zinc)::DOUBLE AS total_incurred, sum(zmp + zip + zep)::DOUBLE AS total_paid, sum(zmp)::DOUBLE AS medical_paid, sum(zip)::DOUBLE AS indemnity_paid, sum(zep)::DOUBLE AS expense_paid,
 sum(zmr + zir)::DOUBLE AS total_reserves, sum(zmr)::DOUBLE AS medical_reserve, sum(zir)::DOUBLE AS indemnity_reserve, 0::DOUBLE AS expense_reserve,
 count(*) FILTER (status = 'Open') AS open, count(*) FILTER (status = 'Closed') AS closed, count(*) FILTER (status = 'Reopened') AS reopened, count(*) FILTER (status IS NULL OR status NOT IN ('Open', 'Closed', 'Reopened')) AS other,
 count(*) FILTER (lit) AS litigated_claims, count(*) FILTER (re) AS reopened_claims"""


@query(f"SELECT {ANALYSIS} FROM z", PARTS)
def claim_analysis(spark, d):
    return ops.claim_analysis(_parts(spark, d))


@query(f"SELECT {ANALYSIS}, true AS is_claims, round(sum(zinc)::DOUBLE / count(*), 2) AS average_claim FROM z", PARTS)
def underwriting_statistics(spark, d):
    return ops.underwriting_statistics(_parts(spark, d))


KEY = "claim_number, l_partkey, l_suppkey"


@query(f"SELECT {KEY}, (zmp + zip + zep)::DOUBLE AS total_paid, (zmr + zir)::DOUBLE AS total_reserve, CASE WHEN med_only THEN 0 ELSE ip END::DOUBLE AS indemnity_paid, CASE WHEN med_only THEN 0 ELSE ir END::DOUBLE AS indemnity_reserve FROM z", PARTS)
def component_recompute(spark, d):
    return ops.recomputed(_parts(spark, d)).select("claim_number", "l_partkey", "l_suppkey", *[F.col(c).cast("double").alias(c) for c in ("total_paid", "total_reserve", "indemnity_paid", "indemnity_reserve")])


@query(f"SELECT {KEY}, CASE WHEN zmr = 0 AND em > 0 THEN em - zmp ELSE mr END::DOUBLE AS medical_reserve, CASE WHEN zir = 0 AND ec > 0 THEN ec - zip ELSE ir END::DOUBLE AS indemnity_reserve FROM z", PARTS)
def reserve_fallback(spark, d):
    return ops.reserve_fallback(_parts(spark, d)).select("claim_number", "l_partkey", "l_suppkey", F.col("medical_reserve").cast("double").alias("medical_reserve"), F.col("indemnity_reserve").cast("double").alias("indemnity_reserve"))


@query(f"""SELECT {KEY}, list_filter([CASE WHEN off AND abs(zmp - s) < 2 THEN 'possible mapping leak: medical_paid ' || printf('$%.2f', zmp::DOUBLE) || ' matches the sum' END,
 CASE WHEN off THEN 'total mismatch: calculated ' || printf('$%.2f', s::DOUBLE) || ' != reported ' || printf('$%.2f', zinc::DOUBLE) END,
 CASE WHEN zir < 0 THEN 'indemnity_reserve is negative: ' || printf('$%.2f', zir::DOUBLE) END], lambda x: x IS NOT NULL) AS errors
 FROM (SELECT *, abs(s - zinc) > 2 AS off FROM (SELECT *, zmp + zmr + zip + zir + zep AS s FROM z))""", PARTS)
def financial_errors(spark, d):
    p = _parts(spark, d)
    return p.select("claim_number", "l_partkey", "l_suppkey", ops.financial_errors(p).alias("errors"))


ODD = ["A-17", " None ", "null", "UNKNOWN", "n/a", "[CLAIM_NUMBER_1]", "  ", "00042", None]


@query("SELECT c_custkey, n FROM (SELECT c_custkey, ['A-17', ' None ', 'null', 'UNKNOWN', 'n/a', '[CLAIM_NUMBER_1]', '  ', '00042', NULL][c_custkey % 9 + 1] AS n FROM customer) WHERE c_custkey % 9 IN (0, 7)")
def claim_number_filter(spark, d):
    n = F.get(F.array(*[F.lit(x) for x in ODD]), (F.col("c_custkey") % 9).cast("int"))
    return readers.table(spark, d, "customer").select("c_custkey", n.alias("n")).where(ops.valid_claim_number(F.col("n")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def external_fields(spark, d):
    li = readers.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ops.without_internals(li.withColumns({"confidence_score": F.lit(1), "math_valid": F.lit(True), "math_diff": F.lit(0.5)}))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 1 THEN nullif(t, '') ELSE old END AS employee_name FROM (SELECT *, 'Name ' || CAST(c_custkey AS VARCHAR) || ' b' AS t, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' END AS old FROM customer)""")
def name_backfill(spark, d):
    """Even claims have a name; every third is listed twice under its number with zeros in
    front, except where the listed name is too short to be one."""
    c = readers.table(spark, d, "customer")
    k = F.col("c_custkey")
    claims = c.select("c_custkey", k.cast("string").alias("claim_number"), F.when(k % 2 == 0, F.col("c_name")).when(k % 5 == 0, "N/A").alias("employee_name"))
    listed = c.where(k % 3 == 0).select(F.concat(F.lit("00"), k.cast("string")).alias("claim_number"), F.explode(F.array(F.struct(F.lit("a").alias("x"), F.lit(1).alias("n")), F.struct(F.lit("b").alias("x"), F.lit(2).alias("n")))).alias("v"), "c_custkey")
    names = listed.select("claim_number", F.when(F.col("c_custkey") % 4 == 1, "7").otherwise(F.concat(F.lit("Name "), F.col("c_custkey").cast("string"), F.lit(" "), "v.x")).alias("name"), F.col("v.n").alias("n"))
    return ops.backfilled_names(claims, names, "n").select("c_custkey", "employee_name")


@query("SELECT l_orderkey * 10 + l_linenumber AS claim_number, l_partkey, l_suppkey FROM lineitem WHERE l_extendedprice > 0 AND l_quantity * 1500 > l_extendedprice")
def high_reserves(spark, d):
    c = readers.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_number"), "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("incurred"), (F.col("l_quantity") * 750).alias("reserve"))
    return ops.high_reserve_claims(c).select("claim_number", "l_partkey", "l_suppkey")
