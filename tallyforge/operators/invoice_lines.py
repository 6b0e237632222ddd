"""Rows of premium invoices from their printed lines, one grammar per layout.

Each reads (doc, pos, line) and gives a row per premium: doc, pos, last, first, member,
plan, kind, tier, current, adjustment; what a layout does not print is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plans
from ..functions.extract import found, money


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    text = lambda n: columns[n] if n in columns else F.lit(None).cast("string")
    cash = lambda n: columns[n].cast("decimal(18,2)") if n in columns else F.lit(None).cast("decimal(18,2)")
    return df.select("doc", "pos", *[text(n).alias(n) for n in ("last", "first", "member", "plan", "kind", "tier")], *[cash(n).alias(n) for n in ("current", "adjustment")])


def _carried(value: Column, doc: str = "doc", pos: str = "pos") -> Column:
    """The last value that is given at or before a line."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))


def _name(full: Column) -> tuple[Column, Column]:
    """(last, first) of ``Last, First`` or ``Last First``."""
    t = F.trim(full)
    comma = t.contains(",")
    return F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(F.substring_index(t, " ", 1)), F.when(comma, F.trim(F.regexp_replace(t, "^[^,]*,", ""))).otherwise(F.trim(F.regexp_replace(t, r"^\S+", "")))


# --- fixed values: plans by invoice and place of the number; signs of the invoices ---
LOCATION_PLANS = {
    "9835": (6, {0: ("DOL ACF", "FEES"), 1: ("ACF CREDIT", "FEES"), 2: ("Medical", "MEDICAL"), 3: ("Dental", "DENTAL"), 4: ("POP Plan Fee", "FEES"), 5: ("Flex Fee", "FEES")}),
    "9832": (6, {1: ("Life", "LIFE"), 2: ("Dep Life", "LIFE"), 3: ("Retiree Life", "LIFE"), 4: ("Retiree Dep Life", "LIFE"), 5: ("HSA Fee", "FEES")}),
    "9833": (7, {0: ("LTD", "DISABILITY"), 3: ("SPD", "DISABILITY"), 6: ("GAP", "MEDICAL")}),
}
LOCATION_SIGNS = (("9832", ("9832", "12901", "DEP LIFE")), ("9833", ("9833", "12902", "SPD90", "LTD")), ("9835", ("9835", "12903", "MEDICAL", "DENTAL", "DOL ACF")))
LOCATION_TOTALS = ("** Location Totals", "* * T O T A L S", "* * I N V O I C E T O T A L", "* * G R A N D T O T A L")
GRID_PLANS = {2: ("Dental", "DENTAL", 3), 4: ("ManagedDentalCare- Mdc", "DENTAL", 5), 6: ("ManagedDentalCare- Mdg", "DENTAL", 7), 8: ("Std", "STD", None), 9: ("Vision", "VISION", 10), 11: ("Voluntary Ad&D", "AD&D", 12), 13: ("Voluntary Term Life", "LIFE", 14)}
GRID_NO_NAMES = ("premium", "ins.", "continued", "")
TIER = r"Participant|Ppt\s*&\s*Dep\s*\(?s?\)?|Ppt\s*&\s*Sps|Ppt\s*&\s*Fam|Ppt|Spouse|Dependent|Sps|Dep|Family"
DETAIL_SKIP = (
    r"(?i)DO\s+NOT\s+RETURN|Group\s+ID:|PARTICIPANT\s+DETAIL|PARTICIPANT\s+ID\s+FAMILY|Invoice\s+Number|Coverage\s+Period|Due\s+Date|Billing\s+Date|\[\[PAGE_\d+\]\]|^\s*Page\s*\d+\s*$|FAMILY\s+INDICATOR|EFF\s+DATE\s+PLAN|VOLUME\s+AMOUNT"
)
# --- end of fixed values ---


def location_rows(lines: DataFrame, page: str = "page") -> DataFrame:
    """``LAST, FIRST 01/31/1980 tier n n n ...``: the numbers are plans, which by which invoice
    the page belongs to.  The invoice is told by the first sign within a page's first 20
    lines, else it is that of the page before.  The result has invoice as well."""
    place = F.row_number().over(Window.partitionBy("doc", page).orderBy("pos"))
    up = F.upper("line")
    sign = F.lit(None).cast("string")
    for inv, words in reversed(LOCATION_SIGNS):
        sign = F.when(plans.has_any(up, words), inv).otherwise(sign)
    seen = lines.withColumn("sign", F.when(place <= 20, sign))
    pages = seen.groupBy("doc", page).agg(F.min_by("sign", F.when(F.col("sign").isNotNull(), F.col("pos"))).alias("own"))
    pages = pages.withColumn("invoice", _carried(F.col("own"), "doc", page)).select("doc", page, "invoice")
    row = r"^\s*([A-Z\s\-]+,\s*[A-Z\s\-]+?)\s*(\d{2}/\d{2}/\d{4})\s+(.+?)\s+((?:[\d.\-]+\s*)+)$"
    part = lambda i: F.regexp_extract("line", row, i)
    numbers = F.transform(F.split(F.trim(part(4)), r"\s+"), lambda x: F.when(x.endswith("-"), -F.regexp_replace(x, "-$", "").try_cast("decimal(18,2)")).otherwise(x.try_cast("decimal(18,2)")))
    read = lines.join(pages, ["doc", page]).where(F.col("line").rlike(row)).withColumn("numbers", numbers)
    entry = lambda n, plan, kind, least, inv: F.when((F.col("invoice") == inv) & (F.size("numbers") >= least), F.struct(F.lit(plan).alias("plan"), F.lit(kind).alias("kind"), F.get("numbers", F.lit(n)).alias("v")))
    entries = F.array(*[entry(n, *p, least, inv) for inv, (least, table) in LOCATION_PLANS.items() for n, p in table.items()])
    out = read.withColumn("e", F.explode(F.filter(entries, lambda e: e["v"] != 0)))
    last, first = _name(part(1))
    tier = F.when(F.trim(part(3)) != "3337", F.trim(part(3)))
    rows = _rows(out.withColumn("inv", F.col("invoice")), last=last, first=first, plan=F.col("e.plan"), kind=F.col("e.kind"), tier=tier, current=F.col("e.v"), adjustment=F.lit(0))
    totals = lines.join(pages, ["doc", page]).where(plans.has_any(F.col("line"), LOCATION_TOTALS)).withColumn("v", F.regexp_replace(F.element_at(F.split(F.trim("line"), r"\s+"), -1), ",", "").try_cast("decimal(18,2)")).where("v IS NOT NULL")
    final = totals.withColumn("k", F.row_number().over(Window.partitionBy("doc", page).orderBy(F.desc("pos")))).where("k = 1")
    return rows.unionByName(_rows(final, first=F.lit("INVOICE TOTAL"), last=F.lit(""), plan=F.lit("REPORTED INVOICE TOTAL (FOR AUDIT)"), kind=F.lit("TOTAL"), current=F.col("v"), adjustment=F.lit(0)))


def _turned_money(text: Column) -> Column:
    return money(F.reverse(F.regexp_replace(text, r"\$", "")))


def turned_rows(lines: DataFrame) -> DataFrame:
    """Lines printed from right to left: a name line with the id, then plan lines, and a totals
    line if there are several.  One row per person: the totals, else the only plan's cost,
    else the plans' sum; STD and LTD are named together."""
    skip = plans.has_any(F.col("line"), ("TSOC EE", "NOITARUDKCIS", "liateD eeyolpmE", "EMAN gnilliB"))
    name, plan, total = r"^\s*(\d+)\s+:ON DI\s+(.+?)\s*:EMAN\s*$", r"^\s*[\d$.]+\s+([\d$.]+)\s+.+?\s+(DTS|DTL)\s*$", r"^.*?\s*([\d$.]+)\s+[\d$.]+\s+SLATOT\s*$"
    l = lines.where(~skip)
    is_name = F.col("line").rlike(name)
    l = l.withColumn("run", F.count_if(is_name).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    l = l.select(
        "doc", "pos", "run", F.when(is_name, F.reverse(F.regexp_extract("line", name, 1))).alias("member"), F.when(is_name, F.reverse(F.regexp_extract("line", name, 2))).alias("full"),
        F.when(~is_name & F.col("line").rlike(total), _turned_money(F.regexp_extract("line", total, 1))).alias("total"), F.when(~is_name & F.col("line").rlike(plan), F.struct("pos", F.when(F.regexp_extract("line", plan, 2) == "DTS", "STD").otherwise("LTD").alias("kind"), _turned_money(F.regexp_extract("line", plan, 1)).alias("cost"))).alias("p"),
    )
    g = l.groupBy("doc", "run").agg(F.min("pos").alias("pos"), F.max("member").alias("member"), F.max("full").alias("full"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("pos"))).alias("total"), F.array_sort(F.collect_list("p")).alias("ps"))
    kinds = F.array_join(F.transform("ps", lambda p: p["kind"]), "+")
    summed = F.aggregate(F.transform("ps", lambda p: p["cost"].cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)"))
    g = g.where("total IS NOT NULL OR size(ps) > 0")
    last, first = _name(F.col("full"))
    single = F.col("total").isNull() & (F.size("ps") == 1)
    return _rows(g, last=last, first=first, member=F.col("member"), plan=F.when(single, F.reverse(F.get("ps", F.lit(0))["kind"])).otherwise("COMBINED"), kind=F.when(F.size("ps") == 0, "COMBINED").otherwise(kinds), tier=F.lit("EE"), current=F.coalesce("total", summed))


def benefit_lines(lines: DataFrame, vertical: Column) -> DataFrame:
    """``id LAST, FIRST date plan premium``, or with a masked social security number for the
    id.  In vertical lists the last premium counts and the text before it is the plan; in
    wide ones each premium that is not 0 is a row."""
    t = F.trim("line")
    by_id, by_ssn = r"^(\d+)\s+([A-Z\-\s,]+?)\s+(\d{1,2}/\d{1,2}/\d{4})", r"^[X\d\-]{11}\s+([A-Z\-\s,]+)"
    has_id = t.rlike(by_id)
    full = F.trim(F.when(has_id, F.regexp_extract(t, by_id, 2)).otherwise(F.regexp_extract(t, by_ssn, 1)))
    tail = F.regexp_replace(t, by_ssn, "")
    rest = F.when(has_id, F.regexp_replace(t, by_id, "")).when(tail.rlike(r"\d{1,2}/\d{1,2}/\d{4}"), F.regexp_replace(tail, r"^.*?\d{1,2}/\d{1,2}/\d{4}", "")).otherwise(tail)
    last, first = _name(full)
    read = lines.where((t != "") & ~t.contains("Totals:") & ~t.contains("Billing Period") & (has_id | t.rlike(by_ssn)))
    read = read.select("doc", "pos", F.when(has_id, F.regexp_extract(t, by_id, 1)).alias("member"), last.alias("last"), first.alias("first"), rest.alias("rest"), vertical.alias("vertical"))
    read = read.withColumn("found", F.regexp_extract_all("rest", F.lit(r"(\(?-?\d{1,5}\.\d{2}\)?)"), F.lit(1))).where("size(found) > 0")
    amount = lambda x: F.regexp_replace(x, "[()-]", "").try_cast("decimal(18,2)")
    named = F.array_join(F.filter(F.split(F.regexp_replace(F.regexp_replace("rest", r"\(?-?\d{1,5}\.\d{2}\)?", ""), "[$,]", ""), r"\s+"), lambda w: w != ""), " ")
    plan = F.coalesce(F.nullif(named, F.lit("")), F.lit("GIS BENEFIT"))
    final = F.element_at("found", -1)
    v = read.where("vertical")
    vertical_rows = _rows(v, last=F.col("last"), first=F.col("first"), member=F.col("member"), plan=plan, kind=plans.plan_type(plan), tier=plans.tier_in_plan(plan), current=F.when(final.rlike("[(-]"), -amount(final)).otherwise(amount(final)), adjustment=F.lit(0))
    w = read.where("NOT vertical").withColumn("x", F.explode("found")).where(amount(F.col("x")) != 0)
    wide = _rows(w, last=F.col("last"), first=F.col("first"), member=F.col("member"), plan=F.lit("GIS BENEFIT"), kind=F.lit("MEDICAL"), tier=F.lit("EE"), current=amount(F.col("x")), adjustment=F.lit(0))
    return vertical_rows.unionByName(wide)


def benefit_header(text: Column) -> Column:
    """(INV_DATE, INV_NUMBER, BILLING_PERIOD) of an invoice's first page; the period is its start."""
    day = r"(\d{1,2}/\d{1,2}/\d{4})"
    return F.struct(
        found(text, rf"(?i)Invoice Date\s*[:\s]*{day}").alias("INV_DATE"), found(text, r"(?i)Invoice\s*#\s*[:\s]*(\S+)").alias("INV_NUMBER"), found(text, rf"(?i)Billing Period\s*[:\s]*{day}\s*-\s*{day}").alias("BILLING_PERIOD"),
    )


def grid_tier(raw: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(t == "", "").when(t.contains("FAM") | (t.contains("SP") & t.contains("CH")), "FAM").when(t.contains("SP"), "ES").when(t.contains("CH"), "EC").otherwise("EE")


def grid_rows(lines: DataFrame) -> DataFrame:
    """A table with bars: a name, then premium and tier columns of seven plans.  A cell may hold
    several premiums, which add up; a line without a name belongs to the one before."""
    t = F.trim("line")
    mark = F.when(t.isin("| Current Premiums |", "| Current Premiums (cont'd.) |"), F.lit(True)).when(t.contains("Summary of Current Premiums"), F.lit(False))
    l = lines.withColumn("inside", F.coalesce(_carried(mark), F.lit(False))).withColumn("head", F.coalesce(mark, F.lit(False)))
    cells = F.transform(F.split(t, r"\|"), lambda c: F.trim(c))
    l = l.withColumn("cells", cells).withColumn("table", F.count_if("head").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    data = F.col("inside") & t.startswith("|") & ~t.rlike(r"^\| (?:Employee|-|TOTAL) \||^\| TotalCurrentPremium") & (F.size("cells") >= 14)
    l = l.where(data).withColumn("own", F.when(~F.lower(F.get("cells", F.lit(1))).isin(*GRID_NO_NAMES), F.get("cells", F.lit(1))))
    l = l.withColumn("full", F.last("own", ignorenulls=True).over(Window.partitionBy("doc", "table").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("full IS NOT NULL")
    total = lambda c: F.aggregate(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+\.\d{2})"), F.lit(1)), lambda x: x.cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)"))
    entry = lambda n, plan, kind, cov: F.struct(F.lit(plan).alias("plan"), F.lit(kind).alias("kind"), grid_tier(F.get("cells", F.lit(cov)) if cov else F.lit("")).alias("tier"), total(F.coalesce(F.get("cells", F.lit(n)), F.lit(""))).alias("v"))
    out = l.withColumn("e", F.explode(F.filter(F.array(*[entry(n, *p) for n, p in GRID_PLANS.items()]), lambda e: e["v"] > 0)))
    comma = F.col("full").contains(",")
    last, first = F.when(comma, F.trim(F.substring_index("full", ",", 1))).otherwise(F.col("full")), F.when(comma, F.trim(F.regexp_replace("full", "^[^,]*,", ""))).otherwise("")
    return _rows(out, last=last, first=first, plan=F.col("e.plan"), kind=F.col("e.kind"), tier=F.col("e.tier"), current=F.col("e.v"))


def detail_tier(raw: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[\s&()\[\]]", "")
    return F.when(t.startswith("par") | t.startswith("ppt"), "EE").when(t.startswith("spo") | t.startswith("sps"), "ES").when(t.startswith("dep"), "EC").when(t.startswith("fam"), "FAM").otherwise("EE")


def detail_rows(lines: DataFrame) -> DataFrame:
    """``Last, First  id tier date plan [volume] amount`` lines, lines without name and id that
    belong to the person before, and retroactive changes, which are adjustments of the plan
    before.  Amounts must be above 0."""
    member = rf"^\s*\*?([A-Za-z][A-Za-z\s,/.]+?)\s{{2,}}(\d{{4,9}})\s+({TIER})\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\s+(.*)$"
    orphan = rf"^\s{{5,}}({TIER})\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\s+(.*)$"
    retro = r"^\s*Retroactive\s+Change\s+\d{1,2}/\d{1,2}/\d{4}\s+(.*)$"
    part = lambda p, i: F.regexp_extract("line", f"(?i){p}", i)
    is_ = lambda p: F.col("line").rlike(f"(?i){p}")
    l = lines.where((F.trim("line") != "") & ~F.col("line").rlike(DETAIL_SKIP))
    kind = F.when(is_(member), "member").when(is_(orphan), "orphan").when(is_(retro), "retro")
    l = l.withColumn("what", kind).where("what IS NOT NULL")
    mine = F.col("what") == "member"
    rest = F.when(mine, part(member, 4)).when(F.col("what") == "orphan", part(orphan, 2)).otherwise(part(retro, 1))
    l = l.withColumns({
        "rest": F.trim(rest), "raw_tier": F.when(mine, part(member, 3)).when(F.col("what") == "orphan", part(orphan, 1)).otherwise("Participant"), "full": _carried(F.when(mine, F.trim(part(member, 1)))), "member": _carried(F.when(mine, part(member, 2))),
    }).where("full IS NOT NULL")
    decimals = F.regexp_extract_all("rest", F.lit(r"([\d,]+\.\d+)"), F.lit(1))
    l = l.withColumn("amount", money(F.element_at(F.concat(F.array(F.lit(None).cast("string")), decimals), -1))).where("amount > 0")
    own = F.when(F.col("what") != "retro", F.trim(F.get(F.split("rest", r"\s+[\d,]+\.?\d*"), F.lit(0))))
    l = l.withColumn("plan", F.coalesce(_carried(own), F.lit("Adjustment")))
    last, first = _name(F.col("full"))
    adj = F.col("what") == "retro"
    return _rows(l, last=last, first=first, member=F.col("member"), plan=F.col("plan"), kind=plans.plan_type(F.col("plan"), "voluntary"), tier=detail_tier(F.col("raw_tier")), current=F.when(~adj, F.col("amount")), adjustment=F.when(adj, F.col("amount")))


def with_identity(lines: DataFrame) -> DataFrame:
    """Lines of tiers or retroactive changes without a name get name and id of the last line
    that has both, in place of their leading spaces; all others stay."""
    tier = r"(?:Participant|Ppt|Spouse|Dependent|Sps|Dep|Family|Ppt/Dep|Ppt/Sps|Sps/Dep|Ppt/Fam)"
    start = rf"(?i)^\s*\*?([A-Z][a-zA-Z\s,]+)\s+(\d{{4,9}})\s+{tier}\s+"
    bare = rf"(?i)^\s+{tier}\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\s+|^\s*Retroactive\s+Change\s+"
    starts = F.col("line").rlike(start)
    l = lines.withColumn("__n", _carried(F.when(starts, F.trim(F.regexp_extract("line", start, 1))))).withColumn("__i", _carried(F.when(starts, F.regexp_extract("line", start, 2))))
    healed = F.concat(F.lit(" "), F.col("__n"), F.lit("  "), F.col("__i"), F.lit(" "), F.regexp_replace("line", r"^\s+", ""))
    fix = ~starts & F.col("line").rlike(bare) & F.col("__n").isNotNull() & F.col("line").rlike(r"^\s")
    return l.withColumn("line", F.when(fix, healed).otherwise(F.col("line"))).drop("__n", "__i")
