"""Claim analytics.  Columns are named by role:

claim_number, client, state, status (OPEN/CLOSED/...), incurred, paid, reserve (decimal),
litigated (boolean), class_code, class_text, cause, loss_date, carrier, policy, year.

Group keys that are null drop out where the dashboards drop them (states, classes, causes,
clients); carriers without a name are ``Unknown``; years that are null or 0 are left out.
Sums are of decimals, so they do not depend on the order of rows; results are doubles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_bucket
from ..functions.text import no_sentinel

# --- fixed values: score steps (below, points) and category floors ---
FREQUENCY = ((5, 25), (10, 20), (15, 15), (20, 10))
SEVERITY = ((5000, 25), (10000, 20), (20000, 15), (40000, 10))
LITIGATION = ((5, 20), (10, 15), (20, 10), (30, 5))
RESERVE = ((20, 15), (30, 12), (40, 9), (50, 6))
CATEGORIES = ((85, "Preferred"), (70, "Standard"), (55, "Moderate"), (40, "Elevated"))
STATE_FACTORS = {"TX": 1, "FL": 2, "GA": 2, "NC": 3, "PA": 4, "NY": 5, "IL": 6, "CA": 8}
CLASS_FACTORS = {"8810": 1, "8018": 3, "8292": 5, "2002": 6, "7219": 8, "7720": 10, "808": 8}
# --- end of fixed values ---


def has_status(wanted: str) -> Column:
    return F.upper(F.trim("status")) == wanted


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def executive_summary(claims: DataFrame) -> DataFrame:
    n = F.count("*")
    return claims.agg(
        n.alias("total_claims"), F.count_if(has_status("OPEN")).alias("open_claims"), F.count_if(has_status("CLOSED")).alias("closed_claims"),
        total(F.col("incurred")).alias("total_incurred"), total(F.col("paid")).alias("total_paid"), total(F.col("reserve")).alias("outstanding_reserve"),
        F.count_if("litigated").alias("litigated_claims"), (ratio(F.count_if("litigated"), n) * 100).alias("litigation_pct"),
        ratio(F.sum("incurred"), n).alias("average_claim_cost"), F.coalesce(F.max("incurred"), F.lit(0)).cast("double").alias("largest_claim"),
    )


def top_claims(claims: DataFrame, n: int, columns: list[str], tie: list[str]) -> DataFrame:
    """The ``n`` claims with the most incurred; ``tie`` makes the order total."""
    return claims.orderBy(F.desc("incurred"), *tie).limit(n).select(*columns, F.col("incurred").cast("double").alias("incurred"))


def losses_by(claims: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Count, sum and average severity by ``keys``; the ``top`` sums, ties by key."""
    known = claims.dropna(subset=keys)
    g = known.groupBy(*keys).agg(F.count("*").alias("claim_count"), F.sum("incurred").alias("s"))
    return g.orderBy(F.desc("s"), *keys).limit(top).select(*keys, "claim_count", F.col("s").cast("double").alias("total_incurred"), ratio(F.col("s"), F.col("claim_count")).alias("average_severity"))


def losses_by_state(claims: DataFrame, top: int = 10) -> DataFrame:
    """As ``losses_by``, but counts claim numbers and sums paid and reserve as well."""
    g = claims.dropna(subset=["state"]).groupBy("state").agg(
        F.count("claim_number").alias("claim_count"), total(F.col("paid")).alias("total_paid"), total(F.col("reserve")).alias("outstanding_reserve"), F.sum("incurred").alias("s")
    )
    return g.orderBy(F.desc("s"), "state").limit(top).withColumn("total_incurred", F.col("s").cast("double")).drop("s")


def open_aging(claims: DataFrame, valuation: Column | None = None) -> DataFrame:
    """Open claims by age at the valuation date, by default the latest loss date."""
    as_of = claims.agg((F.max(valuation) if valuation is not None else F.max("loss_date")).alias("v"))
    aged = claims.where(has_status("OPEN")).withColumn("bucket", age_bucket(F.datediff(as_of.scalar(), "loss_date")))
    return aged.dropna(subset=["bucket"]).groupBy("bucket").agg(F.count("claim_number").alias("claim_count"), total(F.col("reserve")).alias("total_reserve"), total(F.col("incurred")).alias("total_incurred"))


def stepped(x: Column, steps) -> Column:
    out = F.lit(0)
    for below, points in reversed(steps):
        out = F.when(x < below, points).otherwise(out)
    return out


def category(score: Column) -> Column:
    out = F.lit("Critical")
    for floor, label in reversed(CATEGORIES):
        out = F.when(score >= floor, label).otherwise(out)
    return out


def factor(key: Column, table: Mapping[str, float], default: float) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double"), F.lit(float(default)))


def client_risk(claims: DataFrame, states: Mapping[str, float] = STATE_FACTORS, classes: Mapping[str, float] = CLASS_FACTORS) -> DataFrame:
    """Score of each client from claim frequency, severity, litigation, reserves, main state
    and main class (the most frequent, the least of ties).  The category goes by the score
    before rounding, the score is rounded half to even."""
    known = claims.dropna(subset=["client"])
    n, inc = F.count("*"), F.sum("incurred")
    sums = [n.alias("n"), inc.alias("inc"), F.sum("reserve").alias("res"), F.count_if("litigated").alias("lit")]
    g = known.groupBy("client", "state", "class_code").agg(*sums)  # all that follows is over these few rows
    for c in ("state", "class_code"):
        w = Window.partitionBy("client", c)
        g = g.withColumn(f"n_{c}", F.when(F.col(c).isNotNull(), F.sum("n").over(w)))
    first = lambda c, default: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct((-F.col(f"n_{c}")).alias("n"), c))), F.lit(default))
    g = g.groupBy("client").agg(
        F.sum("n").alias("n"), F.sum("inc").alias("inc"), F.sum("res").alias("res"), F.sum("lit").alias("lit"), first("state", "XX").alias("state"), first("class_code", "0").alias("cls")
    )
    score = (
        stepped(F.col("n"), FREQUENCY) + stepped(ratio(F.col("inc"), F.col("n")), SEVERITY) + stepped(ratio(F.col("lit"), F.col("n")) * 100, LITIGATION)
        + stepped(ratio(F.col("res"), F.col("inc")) * 100, RESERVE)
        + F.greatest(F.lit(0.0), 10 - factor(F.col("state"), states, 5)) + F.greatest(F.lit(0.0), 5 - factor(F.col("cls"), classes, 5) / 2)
    )
    return g.withColumn("raw", score).select(
        "client", F.col("n").alias("claim_count"), F.col("inc").cast("double").alias("total_incurred"), F.bround("raw").cast("long").alias("score"), category(F.col("raw")).alias("category")
    )


def portfolio_score(risk: DataFrame) -> DataFrame:
    s = F.coalesce(F.bround(F.avg("score")).cast("long"), F.lit(0).cast("long"))
    return risk.agg(s.alias("portfolio_score"), F.count("*").alias("clients")).withColumn("classification", category(F.col("portfolio_score")))


def breakdown(claims: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts and sums by any key expression; rows where it is null drop out."""
    g = claims.withColumn(name, key).dropna(subset=[name]).groupBy(name)
    return g.agg(
        F.count("*").alias("claim_count"), total(F.col("incurred")).alias("total_incurred"), total(F.col("paid")).alias("total_paid"), total(F.col("reserve")).alias("total_reserves"),
        F.count_if(has_status("OPEN")).alias("open_count"), F.count_if(has_status("CLOSED")).alias("closed_count"),
    )


def by_year(claims: DataFrame) -> DataFrame:
    return breakdown(claims, F.nullif(F.col("year"), F.lit(0)), "year")


def by_carrier(claims: DataFrame) -> DataFrame:
    return breakdown(claims, F.coalesce(F.nullif(F.col("carrier"), F.lit("")), F.lit("Unknown")), "carrier")


def year_over_year(years: DataFrame) -> DataFrame:
    """Change of total_incurred to the year before, in percent; one row per year."""
    w = Window.orderBy("year")
    before = F.lag("total_incurred").over(w)
    return years.select("year", "total_incurred", F.when(before > 0, (F.col("total_incurred") - before) / before * 100).alias("change_pct"))


def extremes(claims: DataFrame) -> DataFrame:
    """The largest claim, the smallest above 0 (ties: least claim number), and how many
    claims hold over half of their incurred in reserve."""
    number = F.col("claim_number")
    positive = F.col("incurred") > 0
    return claims.agg(
        F.max_by("claim_number", F.struct("incurred", (-number).alias("m"))).alias("highest_claim"), F.max("incurred").cast("double").alias("highest_incurred"),
        F.min_by("claim_number", F.when(positive, F.struct("incurred", "claim_number"))).alias("lowest_claim"),
        F.min(F.when(positive, F.col("incurred"))).cast("double").alias("lowest_incurred"),
        F.count_if(positive & (F.col("reserve") * 2 > F.col("incurred"))).alias("high_reserve_claims"),
    )


def observations(claims: DataFrame, large: float = 100000) -> DataFrame:
    """(category, message count): the conditions that hold over all claims."""
    a = claims.agg(
        F.count_if("litigated").alias("lit"), F.count_if(has_status("OPEN")).alias("open"), F.count_if(F.col("incurred") > large).alias("large"),
        total(F.col("reserve")).alias("res"), total(F.col("paid")).alias("paid"),
    )
    item = lambda kind, topic, n, holds: F.when(holds, F.struct(F.lit(kind).alias("category"), F.lit(topic).alias("topic"), n.cast("long").alias("n")))
    found = F.array(
        item("risk", "litigation", F.col("lit"), F.col("lit") > 0), item("info", "reserves exceed paid", F.lit(1), (F.col("res") > F.col("paid")) & (F.col("paid") > 0)),
        item("info", "open claims", F.col("open"), F.col("open") > 0), item("info", "all closed", F.lit(1), (F.col("res") == 0) & (F.col("open") == 0)), item("risk", "large claims", F.col("large"), F.col("large") > 0),
    )
    return a.select(F.inline(F.array_compact(found)))


def year_filter(claims: DataFrame, year: int | None) -> DataFrame:
    """Claims of one year; 0 or None is all; unknown years drop out when a year is set."""
    return claims.where(F.col("year") == year) if year else claims


def filter_counts(claims: DataFrame, year: int | None) -> DataFrame:
    kept = F.count_if(F.col("year") == year) if year else F.count("*")
    return claims.agg(F.count("*").alias("before_filter"), kept.alias("after_filter")).withColumn("excluded", F.col("before_filter") - F.col("after_filter"))


def year_split(claims: DataFrame, current_year: int, years: int = 5) -> DataFrame:
    """included / excluded / unknown by claim year; unknown years count as included too."""
    label = F.when(F.col("year").isNull(), "unknown").when(F.col("year") >= current_year - years + 1, "included").otherwise("excluded")
    return claims.groupBy(label.alias("split")).agg(F.count("*").alias("claims"), total(F.col("incurred")).alias("total_incurred"))


def summary_level(claims: DataFrame) -> DataFrame:
    """The least policy and carrier of each claim year."""
    return claims.where("year IS NOT NULL").groupBy("year").agg(F.min(F.nullif(F.col("policy"), F.lit(""))).alias("policy"), F.min(F.nullif(F.col("carrier"), F.lit(""))).alias("carrier"))


def missing_totals(claims: DataFrame, total_col: str, parts: list[str]) -> DataFrame:
    """``total_col`` from its parts, if it is 0 over the whole table."""
    whole = claims.agg(F.coalesce(F.sum(total_col), F.lit(0)).alias("s"))
    from_parts = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return claims.withColumn("__whole", whole.scalar()).withColumn(total_col, F.when(F.col("__whole") == 0, from_parts).otherwise(F.col(total_col))).drop("__whole")


PARTS = ("medical", "indemnity", "expense")


def _amount(claims: DataFrame, name: str) -> Column:
    """The column as money, 0 where it is null or the table lacks it."""
    return F.coalesce(F.col(name).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")) if name in claims.columns else F.lit(0).cast("decimal(18,2)")


def _text(claims: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in claims.columns else F.lit("")


def claim_analysis(claims: DataFrame) -> DataFrame:
    """Paid and reserved by part, status counts and flags over all claims, one row.

    Columns: {medical,indemnity,expense}_{paid,reserve}, total_incurred, status (Open, Closed
    or Reopened; all else counts as other), litigation (yes) and reopen (true), both without
    regard to case.  A missing column is null throughout."""
    of = lambda kind: [_amount(claims, f"{p}_{kind}") for p in PARTS]
    status = _text(claims, "status")
    out = [F.count("*").alias("total_claims"), total(_amount(claims, "total_incurred")).alias("total_incurred"), total(sum(of("paid")[1:], of("paid")[0])).alias("total_paid")]
    out += [total(x).alias(f"{p}_paid") for p, x in zip(PARTS, of("paid"), strict=True)]
    out += [total(sum(of("reserve")[1:], of("reserve")[0])).alias("total_reserves"), *[total(x).alias(f"{p}_reserve") for p, x in zip(PARTS, of("reserve"), strict=True)]]
    out += [F.count_if(status == s).alias(s.lower()) for s in ("Open", "Closed", "Reopened")] + [F.count_if(~status.isin("Open", "Closed", "Reopened")).alias("other")]
    out += [F.count_if(F.lower(_text(claims, "litigation")) == "yes").alias("litigated_claims"), F.count_if(F.lower(_text(claims, "reopen")) == "true").alias("reopened_claims")]
    return claims.agg(*out)


def underwriting_statistics(records: DataFrame) -> DataFrame:
    """``claim_analysis`` with the mean claim, and whether the records are claims at all: they
    have a claim number, medical paid or incurred.  Others count as no claims."""
    known = bool({"claim_number", "medical_paid", "total_incurred"} & set(records.columns))
    a = claim_analysis(records if known else records.limit(0))
    return a.withColumn("is_claims", F.lit(known) & (F.col("total_claims") > 0)).withColumn("average_claim", F.round(ratio(F.col("total_incurred"), F.col("total_claims")), 2))


def recomputed(claims: DataFrame) -> DataFrame:
    """total_paid and total_reserve from the parts; then claims that are Medical Only lose
    their indemnity, which stays in the totals."""
    of = lambda kind: sum((_amount(claims, f"{p}_{kind}") for p in PARTS[1:]), _amount(claims, f"{PARTS[0]}_{kind}"))
    c = claims.withColumns({"total_paid": F.round(of("paid"), 2), "total_reserve": F.round(of("reserve"), 2)})
    only = F.coalesce(F.col("injury_type") == "Medical Only", F.lit(False))
    return c.withColumns({x: F.when(only, F.lit(0).cast("decimal(18,2)")).otherwise(F.col(x)) for x in ("indemnity_paid", "indemnity_reserve")})


def reserve_fallback(claims: DataFrame, pairs: tuple = (("medical_reserve", "estimated_medical", "medical_paid"), ("indemnity_reserve", "estimated_comp", "indemnity_paid"))) -> DataFrame:
    """A reserve that is missing or 0 becomes estimate less paid, where there is an estimate.
    Amounts may be text with ``$`` and commas; what is no number counts as 0."""
    num = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c).cast("string"), "[,$]", "")).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    out = {}
    for reserve, estimate, paid in pairs:
        missing = F.col(reserve).isNull() | (num(reserve) == 0)
        out[reserve] = F.when(missing & (num(estimate) > 0), F.round(num(estimate) - num(paid), 2).cast("decimal(18,2)")).otherwise(F.col(reserve).try_cast("decimal(18,2)"))
    return claims.withColumns(out)


def financial_errors(claims: DataFrame, tolerance: float = 2.0) -> Column:
    """What is wrong with a claim's amounts, as texts in order: a part that equals the sum (a
    total read as a part), a total off by more than ``tolerance``, and negative amounts."""
    names = [f"{p}_{k}" for p in PARTS for k in ("paid", "reserve")]
    whole = sum((_amount(claims, n) for n in names[1:]), _amount(claims, names[0]))
    reported, medical = _amount(claims, "total_incurred"), _amount(claims, "medical_paid")
    off = F.abs(whole - reported) > tolerance
    money = lambda c: F.format_string("$%.2f", c.cast("double"))
    found = [
        F.when(off & (F.abs(medical - whole) < tolerance), F.concat(F.lit("possible mapping leak: medical_paid "), money(medical), F.lit(" matches the sum"))),
        F.when(off, F.concat(F.lit("total mismatch: calculated "), money(whole), F.lit(" != reported "), money(reported))),
        *[F.when(_amount(claims, n) < 0, F.concat(F.lit(f"{n} is negative: "), money(_amount(claims, n)))) for n in (*names, "total_incurred")],
    ]
    return F.array_compact(F.array(*found))


def valid_claim_number(number: Column) -> Column:
    """False for null, blank and stand-ins; numbers of any form are valid."""
    t = F.lower(F.trim(number.cast("string")))
    return number.isNotNull() & ~t.isin("none", "null", "unknown", "n/a", "[claim_number_1]", "")


def without_internals(claims: DataFrame, internal: tuple = ("confidence_score", "math_valid", "math_diff")) -> DataFrame:
    return claims.drop(*internal)


def backfilled_names(claims: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """Claims without a name take that of ``names`` (claim_number, name): by the number as it
    is, else by the number in upper case without zeros in front; of several the last in
    ``order``.  Only names of three characters or more with a letter are taken."""
    key = lambda c: F.upper(F.regexp_replace(F.trim(c.cast("string")), "^0+", ""))
    last = lambda k, out: names.groupBy(k.alias(f"__{out}k")).agg(F.max_by("name", order).alias(f"__{out}"))
    c = claims.withColumn("__k", F.trim(F.col("claim_number").cast("string"))).withColumn("__z", key(F.col("claim_number")))
    exact, loose = last(F.trim("claim_number"), "exact"), last(key(F.col("claim_number")), "loose")
    c = c.join(exact, F.col("__k") == F.col("__exactk"), "left").join(loose, F.col("__z") == F.col("__loosek"), "left")
    found = F.trim(F.coalesce(F.nullif(F.trim("__exact"), F.lit("")), "__loose"))
    missing = no_sentinel(F.coalesce("employee_name", F.lit(""))).isNull()
    good = (F.length(found) >= 3) & found.rlike("[A-Za-z]")
    return c.withColumn("employee_name", F.when(missing & F.coalesce(good, F.lit(False)), found).otherwise(F.col("employee_name"))).drop("__k", "__z", "__exact", "__exactk", "__loose", "__loosek")


def high_reserve_claims(claims: DataFrame) -> DataFrame:
    """The claims that hold over half of their incurred in reserve."""
    return claims.where((F.col("incurred") > 0) & (F.col("reserve") * 2 > F.col("incurred")))


def recent_counts(claims: DataFrame, current_year: int, years: int = 5, by: list[str] | None = None) -> DataFrame:
    """Claims of the last years, older ones, and all; unknown years count as recent."""
    recent = F.col("year").isNull() | (F.col("year") >= current_year - years + 1)
    return claims.groupBy(*(by or [])).agg(F.count_if(recent).alias("last_five_years"), F.count_if(~recent).alias("older"), F.count("*").alias("total"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several files as one."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("last_five_years", "older", "total")])
