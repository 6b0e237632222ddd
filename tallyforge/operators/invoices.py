"""Premium invoices: totals, merges, repairs and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain, plain_key
from . import scan

# --- fixed values: parts of plan names that mark subtotals, in rows and beside placeholders ---
SUBTOTAL_PLANS = (
    "PARTICIPANT PREMIUM", "PARTICIPANT ADJUSTMENT", "CURRENT PREMIUM", "AMOUNT DUE", "BILL BRANCH", "NET AMOUNT", "TOTAL BILLED", "REPORTED INVOICE", "LIFE INSURANCE BENEFITS", "TOTAL FOR BILL BRANCH", "TOTAL FOR ALL BRANCHES",
    "INVOICE SUMMARY",
)
TOTAL_PLANS = ("TOTAL", "AMOUNT DUE", "BILL BRANCH", "NET AMOUNT", "REPORTED INVOICE", "LIFE INSURANCE BENEFITS")
# --- end of fixed values ---
AGGREGATE_PLANS = "|".join(SUBTOTAL_PLANS)


def explode_items(docs: DataFrame, header: str, items: str, inherit: list[str]) -> DataFrame:
    """A row per line item, a row for documents without any; an item's own value wins over the header's."""
    e = docs.select(header, F.explode_outer(items).alias("i"))
    item_fields = [f.name for f in docs.schema[items].dataType.elementType.fields]
    own = [F.coalesce(F.col(f"i.{c}"), F.col(f"{header}.{c}")).alias(c) if c in inherit else F.col(f"i.{c}").alias(c) for c in item_fields]
    return e.select(*own, *[F.col(f"{header}.{f.name}").alias(f.name) for f in docs.schema[header].dataType.fields if f.name not in item_fields])


def merge_rows(rows: DataFrame, first: str, last: str, ids: list[str], plan: Column, dates: list[str], sums: list[str], carry: list[str], order: list[str]) -> DataFrame:
    """Rows of one person, plan and date become one: amounts add up, other fields keep
    their first value.  Rows naming a total, or nobody, stay as they are."""
    f, l, p = (F.col(c) for c in ("__first", "__last", "__plan"))  # each text is cleaned once a row
    total = f.contains("TOTAL") | l.contains("TOTAL") | p.contains("TOTAL") | ((f == "") & (l == ""))
    ident = F.coalesce(*[F.nullif(plain(F.col(c)), F.lit("")) for c in ids], F.lit("NO_ID"))
    keyed = rows.withColumns({"__first": plain(F.col(first)), "__last": plain(F.col(last)), "__plan": plan}).withColumn("__total", total)
    keys = [plain_key(f, l).alias("k_name"), ident.alias("k_id"), p.alias("k_plan"), *[F.coalesce(F.col(d).cast("string"), F.lit("NONE")).alias(f"k_{d}") for d in dates]]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in [first, last, *carry]]
    merged = keyed.where("NOT __total").groupBy(*keys).agg(*firsts, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count("*").alias("merged_rows"))
    kept = keyed.where("__total").select(first, last, *carry, *sums, F.lit(1).cast("long").alias("merged_rows"))
    return merged.select(first, last, *carry, *sums, "merged_rows").unionByName(kept)


def with_totals(rows: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """The rows and one more with the sums over all of them, labelled in ``label``."""
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label, F.lit("GRAND TOTAL"))
    return rows.unionByName(total, allowMissingColumns=True)


def amount_due(rows: DataFrame, invoice: str, due: str, billed: str, adjusted: str, current: str) -> DataFrame:
    """One effective total per invoice: the header's amount, else billed and adjusted, else
    the sum of the rows.  Billed and adjusted win over a smaller header by more than 0.05."""
    g = rows.groupBy(invoice).agg(F.max(due).alias("due"), F.max(billed).alias("billed"), F.max(adjusted).alias("adj"), F.sum(current).alias("rows"))
    both = F.coalesce("billed", F.lit(0)) + F.coalesce("adj", F.lit(0))
    header = F.when(both > F.coalesce("due", F.lit(0)) + F.lit(0.05).cast("decimal(18,2)"), both).otherwise(F.col("due"))
    total = F.coalesce(F.nullif(header, F.lit(0).cast("decimal(18,2)")), F.nullif(both, F.lit(0).cast("decimal(18,2)")), F.col("rows"))
    return g.select(invoice, total.cast("double").alias("invoice_total"))


def reconcile(extracted: Column, targets: list[Column], tolerance: float = 0.05, buffer: float = 0.01) -> Column:
    """(target, gap, needs_review): against the largest target, which is no target if the
    sum exceeds it by more than the buffer, since it is then a subtotal."""
    target = F.greatest(*targets) if len(targets) > 1 else targets[0]
    subtotal = extracted - target > F.greatest(F.lit(1.0), extracted * buffer)
    gap = F.abs(target - extracted)
    return F.struct(target.alias("target"), gap.alias("gap"), (target.isNotNull() & ~subtotal & (gap > tolerance)).alias("needs_review"))


def vendor_line(invoices: DataFrame, vendor: str, amount: str, order: list[str], shown: int = 3) -> DataFrame:
    """The first vendors in order, how many more there are, and the sum."""
    first = invoices.where(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.min(F.struct(*order)).alias("at"))
    head = first.orderBy("at").limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", vendor))), lambda x: x[vendor]), " | ").alias("line"))
    a = invoices.agg(F.count_distinct(vendor).alias("vendors"), F.count("*").alias("invoices"), F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("total_value"))
    more = F.when(F.col("vendors") > shown, F.concat(F.lit(" (+"), (F.col("vendors") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return a.withColumn("line", head.scalar()).select(F.concat("line", more).alias("vendors"), "invoices", "total_value")


def first_vendors(invoices: DataFrame, vendor: str, order: list[str], shown: int = 5) -> DataFrame:
    """One text with the first vendors in order, each once: all that is shown is gathered, no more."""
    first = invoices.where(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.min(F.struct(*order)).alias("at"))
    head = first.orderBy("at").limit(shown)
    return head.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", vendor))), lambda x: x[vendor]), ", ").alias("vendors"))


def unpivot_premiums(wide: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide premium columns to a row each; empty and zero cells give none."""
    return wide.unpivot(ids, values, name, value).where(F.col(value).isNotNull() & (F.col(value) != 0))


def fill_down(rows: DataFrame, part: str, order: list[str], columns: list[str], crowded: int = scan.CROWDED) -> DataFrame:
    """Blank identifier cells take the value of the row above."""
    filled = scan.running(rows, part, order, {f"__{c}": ("last", F.nullif(F.trim(c), F.lit(""))) for c in columns}, crowded=crowded)
    return filled.withColumns({c: F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def repair_orphans(
    rows: DataFrame, part: str, order: list[str], person: str, plan: Column, amounts: list[str], index: str, placeholder: str, late: int = 50, crowded: int = scan.CROWDED
) -> DataFrame:
    """Placeholder rows take the last real person before them.

    Dropped are placeholders that are subtotals, come late in their chunk, repeat a plan of
    that person, have no amount, or have no person before them.  A repaired row neither
    sets the person nor counts as one of their plans.
    """
    is_place = F.col(person) == placeholder
    name = F.upper(F.coalesce(plan, F.lit("")))
    subtotal = name.rlike(AGGREGATE_PLANS)
    total = F.upper(F.concat_ws(" ", person, plan)).contains("TOTAL")
    real = ~is_place & ~subtotal & ~total & F.col(person).isNotNull() & ~F.upper(person).isin("", "NONE", "NAN")
    r = rows.withColumn("__real", real).withColumn("__name", name)
    r = scan.running(r, part, order, {"__last": ("last", F.when(F.col("__real"), F.col(person)))}, inclusive=False, crowded=crowded)
    changes = F.when(F.col("__real") & ~F.col(person).eqNullSafe(F.col("__last")), 1)
    r = scan.running(r, part, order, {"__run": ("count", changes)}, crowded=crowded)
    # whether a real row of the run had the plan before
    of_plan = Window.partitionBy(part, "__run", "__name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__seen", F.count_if("__real").over(of_plan) > 0)
    empty = F.lit(True)
    for a in amounts:
        empty = empty & F.col(a).isNull()
    drop = is_place & (subtotal | (F.col(index) >= late) | ((F.col("__name") != "") & F.col("__seen")) | empty | F.col("__last").isNull())
    fixed = r.where(~F.coalesce(drop, F.lit(False)))
    return fixed.withColumn("repaired", F.coalesce(is_place, F.lit(False))).withColumn(person, F.when(is_place, F.col("__last")).otherwise(F.col(person))).drop("__real", "__last", "__run", "__seen", "__name")


def move_adjustments(rows: DataFrame, plan: str, current: str, adjustment: str) -> DataFrame:
    """Negative amounts, and those of plans named adjustment or retro, move to the adjustment column."""
    c, a = F.coalesce(current, F.lit(0)), F.coalesce(adjustment, F.lit(0))
    moves = (c != 0) & (a == 0) & (F.upper(plan).rlike("ADJUSTMENT|RETRO") | (c < 0))
    return rows.withColumns({adjustment: F.when(moves, F.col(current)).otherwise(F.col(adjustment)), current: F.when(moves, F.lit(None)).otherwise(F.col(current))})


def missing_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.avg((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("double")).alias(c) for c in columns])


ABSENT = ("n/a", "none", "")


def given(value: Column) -> Column:
    """The value, or null where it stands for nothing."""
    return F.when(~F.lower(F.trim(value.cast("string"))).isin(*ABSENT), value)


def three_totals(rows: DataFrame, label: str, current: str, adjustment: str) -> DataFrame:
    """The rows and three more: all current premiums, all adjustments, and both together."""
    s = rows.agg(F.coalesce(F.sum(current), F.lit(0)).alias("c"), F.coalesce(F.sum(adjustment), F.lit(0)).alias("a"))
    line = lambda name, c, a: F.struct(F.lit(name).alias(label), c.alias(current), a.alias(adjustment))
    none = F.lit(None).cast(rows.schema[current].dataType)
    c, a = F.col("c").cast(rows.schema[current].dataType), F.col("a").cast(rows.schema[adjustment].dataType)
    totals = s.select(F.inline(F.array(line("TOTAL CURRENT PREMIUM", c, none), line("TOTAL ADJUSTMENTS", none, a), line("GRAND TOTAL", (c + a).cast(rows.schema[current].dataType), none))))
    return rows.unionByName(totals, allowMissingColumns=True)


#: Labels of a row with the invoice's total, the best first.
TOTAL_LABELS = ("AMOUNT DUE", "INVOICED AMOUNT", "BALANCE DUE", "REPORTED INVOICE TOTAL", "GRAND TOTAL")


def display_total(rows: DataFrame, doc: str, order: str, stated: str, plan: str, first: str, current: str) -> DataFrame:
    """One total per document: the first stated total above 0, else the last row that the best
    label names, else the sum over rows with a first name.  Texts may have ``$`` and commas."""
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), "[,$]", "").try_cast("decimal(18,2)")
    value, total = num(current), num(stated)
    names = F.concat_ws("\n", F.upper(plan), F.upper(first))
    rank = F.lit(None).cast("int")
    for k, label in reversed(list(enumerate(TOTAL_LABELS))):
        rank = F.when(names.contains(label), k).otherwise(rank)
    g = rows.groupBy(doc).agg(
        F.min_by(total, F.when(total > 0, F.col(order))).alias("stated"),
        F.min_by(value, F.when((value > 0) & rank.isNotNull(), F.struct(rank.alias("r"), (-F.col(order)).alias("o")))).alias("labelled"),
        F.sum(F.when(F.coalesce(F.col(first), F.lit("")) != "", F.coalesce(value, F.lit(0)))).alias("summed"),
    )
    return g.select(doc, F.coalesce("stated", "labelled", "summed", F.lit(0)).cast("double").alias("display_total"))


def merged_header(headers: DataFrame, doc: str, order: str, amounts: list[str], others: list[str]) -> DataFrame:
    """One header per document from its chunks': the largest of each amount above 0, the first
    given value in chunk order of all else."""
    top = [F.max(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in amounts]
    return headers.groupBy(doc).agg(*top, *[F.min_by(given(F.col(c)), F.when(given(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in others])


def inject_headers(items: DataFrame, headers: DataFrame, chunk: str, fields: list[str], invoice: str, due: str, dues: DataFrame) -> DataFrame:
    """Items take from their chunk's header what they lack; then all items of an invoice in
    ``dues`` (invoice, amount) take its amount."""
    h = headers.select(chunk, *[given(F.col(c)).alias(f"__{c}") for c in fields])
    out = items.join(h, chunk, "left").withColumns({c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"__{c}")) for c in fields}).drop(*[f"__{c}" for c in fields])
    known = dues.select(F.col("invoice").alias("__inv"), F.col("amount").alias("__amount"))
    return out.join(known, F.col(invoice) == F.col("__inv"), "left").withColumn(due, F.coalesce("__amount", due)).drop("__inv", "__amount")


SYNTHETIC = "REPORTED INVOICE TOTAL (FOR AUDIT)"


def synthetic_totals(rows: DataFrame, doc: str, invoice: str, due: str, plan: str, first: str, current: str, header_due: str) -> DataFrame:
    """The total rows that documents lack: one per invoice that states an amount and has no
    total row; for a document without invoice numbers, or where none came of it and no plan
    names a total, one from the header's amount."""
    inv = F.coalesce(F.nullif(F.col(invoice).cast("string"), F.lit("")), F.lit("global"))
    in_plan = F.upper(F.coalesce(F.col(plan), F.lit(""))).contains("TOTAL")
    has = in_plan | F.upper(F.coalesce(F.col(first), F.lit(""))).contains("TOTAL")
    g = rows.groupBy(doc, inv.alias("inv")).agg(F.max(F.coalesce(F.col(due), F.lit(0))).alias("amount"), F.bool_or(has).alias("has"), F.bool_or(in_plan).alias("in_plan"), F.max(header_due).alias("header"))
    by_doc = Window.partitionBy(doc)
    clustered = (F.count("*").over(by_doc) > 1) | (F.max("inv").over(by_doc) != "global")
    g = g.withColumn("adds", clustered & ~F.col("has") & (F.col("amount") > 0))
    g = g.withColumn("any_added", F.max("adds").over(by_doc)).withColumn("any_total", F.max("in_plan").over(by_doc)).withColumn("header", F.max("header").over(by_doc)).withColumn("n", F.row_number().over(by_doc.orderBy("inv")))
    from_header = ~F.col("any_added") & ~F.col("any_total") & (F.col("n") == 1) & (F.coalesce("header", F.lit(0)) > 0)
    out = g.where(F.col("adds") | from_header)
    return out.select(
        doc, F.when(F.col("adds") & (F.col("inv") != "global"), F.col("inv")).alias(invoice), F.lit("TOTAL").alias(plan), F.lit(SYNTHETIC).alias(first), F.when(F.col("adds"), F.col("amount")).otherwise(F.col("header")).alias(current)
    )


def invoice_list(docs: DataFrame, doc: str, invoices: str, number: str, amount: str) -> DataFrame:
    """Per document its invoices' numbers in order, how many there are, and their sum."""
    amounts = F.transform(F.col(invoices), lambda x: F.coalesce(x[amount].cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")))
    return docs.select(
        doc, F.coalesce(F.transform(F.col(invoices), lambda x: x[number]), F.array()).alias("numbers"), F.coalesce(F.size(invoices), F.lit(0)).alias("invoices"),
        F.coalesce(F.aggregate(amounts, F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + x).cast("decimal(38,2)")), F.lit(0)).cast("double").alias("total_value"),
    )


def fill_rate(rows: DataFrame, doc: str, texts: list[str], premiums: list[str]) -> DataFrame:
    """How many of a document's slots are filled: one per row for each text, one for any premium."""
    filled = [F.coalesce(~F.trim(F.col(c).cast("string")).isin("", "null", "None"), F.lit(False)).cast("int") for c in texts]
    paid = F.lit(False)
    for p in premiums:
        paid = paid | (F.coalesce(p, F.lit(0)) != 0)
    slots = sum(filled[1:], filled[0]) + paid.cast("int")
    return rows.groupBy(doc).agg((F.sum(slots) / (F.count("*") * (len(texts) + 1))).alias("fill_rate"))


def member_audit(rows: DataFrame, part: str, last: str, name: str, current: str) -> DataFrame:
    """Rows and premiums of a person, by part, and over all parts (null)."""
    found = rows.where(F.contains(F.lower(last), F.lit(name.lower())))
    return found.rollup(part).agg(F.count("*").alias("rows"), F.coalesce(F.sum(current), F.lit(0)).cast("double").alias("subtotal"))


# --- fixed values: words of total rows, of fees, and of plans that only sound like totals ---
TOTAL_WORDS = ("TOTAL", "GRAND TOTAL", "SUBTOTAL", "SUB TOTAL", "INVOICE TOTAL", "BALANCE DUE", "AMOUNT DUE", "EAP FEE", "MONTHLY PREMIUM STATEMENT SUMMARY", "ADJUSTMENTS/FEES")
FEE_WORDS = ("FEE", "ADJUSTMENT", "CREDIT", "CHARGE")
NO_TOTALS = ("TOTAL PET", "SUBSCRIBER TOTAL", "MEMBER TOTAL", "PERSON TOTAL", "EE TOTAL")
SUMMARY_WORDS = ("TOTAL", "SUMMARY", "SUBTOTAL", "BALANCE DUE", "GRAND TOTAL", "INVOICE TOTAL")
BLANK_NAMES = ("", "NONE", "NAN", "N/A", "UNKNOWN")
HEADER_CELLS = ("last name", "first name", "lastname", "firstname", "name")
DUMMY_IDS = ("123456789", "987654321", "000000000", "111223344", "556677889", "112233445")
# --- end of fixed values ---


def names_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text as a whole word."""
    return F.upper(F.coalesce(text, F.lit(""))).rlike(r"\b(" + "|".join(words) + r")\b")


def summary_row(columns: list[str], first: str, last: str, plan: str, premium: str) -> Column:
    """Rows that sum others: a total word in any column, unless the column says TOTAL PET, or
    the row is a reported invoice total; or a premium that nobody and no plan goes with."""
    out = (lambda blank: blank(first) & blank(last) & blank(plan) & F.col(premium).isNotNull())(lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin("none", "", "nan"))
    for c in reversed(columns):  # the first column with a word decides
        v = F.upper(F.coalesce(F.col(c), F.lit("")))
        hit = ~v.contains("TOTAL PET") & names_word(F.col(c), SUMMARY_WORDS)
        out = F.when(hit, ~v.contains("REPORTED INVOICE TOTAL")).otherwise(out)
    return out


def header_echo(last: Column) -> Column:
    """A repeated header line: its name cell holds the heading."""
    return F.coalesce(F.lower(F.trim(last)).isin(*HEADER_CELLS), F.lit(False))


def dummy_id(*ids: Column) -> Column:
    """Whether an id holds one of the digit rows that stand for no one."""
    out = F.lit(False)
    for i in ids:
        out = out | F.coalesce(i.cast("string"), F.lit("")).rlike("|".join(DUMMY_IDS))
    return out


def without_subscriber_totals(rows: DataFrame, doc: str, ids: list[str], plan: str) -> DataFrame:
    """Rows without a person's subscriber total where the person has other rows."""
    pid = F.coalesce(*[F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit("")) for c in ids])
    r = rows.withColumn("__pid", pid).withColumn("__n", F.count("__pid").over(Window.partitionBy(doc, "__pid")))
    return r.where(~(F.col("__pid").isNotNull() & F.upper(F.coalesce(plan, F.lit(""))).contains("SUBSCRIBER TOTAL") & (F.col("__n") > 1))).drop("__pid", "__n")


def initial_matches(left: DataFrame, right: DataFrame, key: str, id_col: str, first: str, last: str) -> DataFrame:
    """(key, match): the least ``id_col`` of ``right`` with the same last name and the same
    first name, or one of the two an initial of the other; spaces and case do not count."""
    squeezed = lambda c: F.lower(F.regexp_replace(F.trim(c), " ", ""))
    keys = lambda t, k: t.select(F.col(k).alias(k), squeezed(F.col(last)).alias("l"), squeezed(F.col(first)).alias("f")).where("l <> '' AND f <> ''")
    a, b = keys(left, key), keys(right, id_col)
    # equal joins only: on the whole first name, and on its first letter where either is an initial
    whole = a.join(b.groupBy("l", "f").agg(F.min(id_col).alias("match")), ["l", "f"])
    letter = lambda t: t.withColumn("i", F.left("f", F.lit(1)))
    short = letter(a).where("length(f) > 1").join(letter(b).where("length(f) = 1").groupBy("l", "i").agg(F.min(id_col).alias("match")), ["l", "i"])
    long = letter(a).where("length(f) = 1").join(letter(b).groupBy("l", "i").agg(F.min(id_col).alias("match")), ["l", "i"])
    both = whole.select(key, "match").unionByName(short.select(key, "match")).unionByName(long.select(key, "match"))
    return both.groupBy(key).agg(F.min("match").alias("match"))


def legal_plans(rows: DataFrame, member: str, plan: str, kind: str, current: str, adjustment: str, dates: list[str], invoice_date: Column) -> DataFrame:
    """Legal plans by the member id: 101 and 700 name the plan where it is missing; a premium
    on a row with a date of its own, not the invoice's, is an adjustment."""
    m, p = F.trim(F.coalesce(F.col(member), F.lit(""))), F.upper(F.trim(F.coalesce(F.col(plan), F.lit(""))))
    named = F.when(p.isin("", "INVOICE") & m.startswith("101"), "Legal Plan").when(p.isin("", "INVOICE") & m.startswith("700"), "Identity Theft Plan")
    own = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in dates])
    digits = lambda c: F.regexp_replace(F.regexp_replace(c, r"\D", ""), "^0+", "")
    dated = F.coalesce(own.rlike("[/-]") & F.coalesce(digits(own) != digits(invoice_date), F.lit(True)), F.lit(False))
    c, a = F.coalesce(F.col(current), F.lit(0)), F.coalesce(F.col(adjustment), F.lit(0))
    moves = dated & (c != 0) & (a == 0)
    zero = F.lit(0).cast(rows.schema[current].dataType)
    return rows.withColumns({
        plan: F.coalesce(named, F.col(plan)), kind: F.when(named.isNotNull(), "VOLUNTARY").otherwise(F.col(kind)),
        adjustment: F.when(moves, F.col(current)).otherwise(F.col(adjustment)), current: F.when(moves, zero).otherwise(F.col(current)),
    })


def single_fees(rows: DataFrame, doc: str, order: str, plan: str, kind: str, last: str, first: str, tier: str, current: str, adjustment: str) -> DataFrame:
    """Each fee or credit of a document once, named alike and after the members: the result has
    ``is_fee`` and ``place`` within the document."""
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    value = F.coalesce(F.when(F.col(current) != 0, F.col(current)), F.col(adjustment), F.lit(0)).cast("decimal(18,2)")
    billing = (up(plan).contains("BILLING FEE") | (up(plan) == "FEES") | up(plan).contains("SETUP FEE") | (up(last) == "BILLING FEE")) & (value == 25)
    name = F.when(billing, "Billing Fee").when(up(plan).contains("SURPLUS REIMBURSEMENT"), "Surplus Reimbursement").when(up(plan).contains("PACKAGED SAVINGS"), "Packaged Savings Credit")
    fee = name.isNotNull() | (up(kind) == "FEES") | (up(last) == "CREDIT/FEE")
    key = F.when(billing, F.struct(F.lit("billing").alias("k"), F.lit(None).cast("decimal(18,2)").alias("v"))).when(fee, F.struct(F.coalesce(name, F.concat(F.lit("other "), up(plan))).alias("k"), value.alias("v")))
    r = rows.withColumn("__name", name).withColumn("is_fee", fee).withColumn("__key", key)
    n = F.row_number().over(Window.partitionBy(doc, "__key").orderBy(order))
    r = r.withColumn("__n", F.when(F.col("is_fee"), n).otherwise(1)).where("__n = 1")
    named = F.col("__name").isNotNull()
    none = F.lit(None).cast("string")
    r = r.withColumns({
        plan: F.when(named, F.col("__name")).otherwise(F.col(plan)), kind: F.when(named, "FEES").otherwise(F.col(kind)), last: F.when(named, "Credit/Fee").otherwise(F.col(last)),
        first: F.when(named, none).otherwise(F.col(first)), tier: F.when(named, none).otherwise(F.col(tier)),
    })
    return r.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("is_fee", order))).drop("__name", "__key", "__n")


def own_member_id(member: Column, ssn: Column) -> Column:
    """The member id, unless it is the social security number again or both are masked."""
    m, s = F.trim(F.coalesce(member, F.lit(""))), F.trim(F.coalesce(ssn, F.lit("")))
    same = (m != "") & (s != "") & ((m == s) | (m.startswith("***") & s.startswith("***")))
    return F.when(~same, member)


def row_class(plan: str, first: str, last: str, member: str, ssn: str, kind: str, current: str, most: float = 6000) -> Column:
    """member, adjustment or total: totals by their words, by an amount over ``most``, or as a
    name without id and plan, or as neither name nor plan; a row of a person with an id is no
    total by its words alone."""
    up = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    there = lambda c: ~up(c).isin(*BLANK_NAMES)
    names = (up(first) != "") & (up(last) != "") & ~up(first).isin("NONE", "NAN", "N/A")
    words = names_word(F.col(plan), TOTAL_WORDS) | names_word(F.col(first), TOTAL_WORDS) | names_word(F.col(last), TOTAL_WORDS)
    sounds = F.lit(False)
    for x in NO_TOTALS:
        sounds = sounds | up(plan).contains(x)
    by_words = words & ~sounds & ~((there(member) | there(ssn)) & names)
    fee = ~by_words & (names_word(F.col(plan), FEE_WORDS) | names_word(F.col(last), FEE_WORDS) | (up(kind) == "FEES") | (up(last) == "CREDIT/FEE"))
    nobody = (names & ~there(member) & ~there(plan)) | (~names & ~there(plan) & ~fee)
    is_total = by_words | (F.coalesce(F.col(current), F.lit(0)) > most) | nobody
    return F.when(is_total, "total").when(fee, "adjustment").otherwise("member")


def partitioned(rows: DataFrame, doc: str, order: str, class_: Column) -> DataFrame:
    """Rows with their class and place: members first, then adjustments, then totals."""
    rank = F.when(F.col("row_class") == "member", 0).when(F.col("row_class") == "adjustment", 1).otherwise(2)
    return rows.withColumn("row_class", class_).withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(rank, order)))


def member_order(invoice: str, last: str, first: str) -> list[Column]:
    """By invoice, last and first name; missing ones last."""
    return [F.col(c).asc_nulls_last() for c in (invoice, last, first)]


def empty_items(items: Column, fields: list[str]) -> Column:
    """Whether no item of a list has any of the fields."""
    said = lambda x, f: F.coalesce(~F.lower(F.trim(x[f].cast("string"))).isin("", "none", "null", "nan"), F.lit(False))

    def any_field(x: Column) -> Column:
        out = said(x, fields[0])
        for f in fields[1:]:
            out = out | said(x, f)
        return out

    return ~F.coalesce(F.exists(items, any_field), F.lit(False))


def benefit_rows(rows: DataFrame, description: str, premium: str, type_of) -> DataFrame:
    """A row per benefit: rows without a description, or that repeat the heading or a total, drop out."""
    text = F.trim(F.coalesce(F.col(description), F.lit("")))
    kept = rows.where(~F.lower(text).isin("", "nan", "benefit description", "total"))
    return kept.withColumns({"PLAN_NAME": text, "PLAN_TYPE": type_of(text), "CURRENT_PREMIUM": F.coalesce(F.col(premium).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")), "ADJUSTMENT_PREMIUM": F.lit(0).cast("decimal(18,2)")})


def amount_by_invoice(rows: DataFrame, invoice: str, amount: str, name: str = "amount_due") -> DataFrame:
    """Every row with the largest amount that any row of its invoice states."""
    return rows.withColumn(name, F.max(amount).over(Window.partitionBy(invoice)))


def vendor_statistics(invoices: DataFrame, vendor: str, amount: str, item: str) -> DataFrame:
    """Per vendor: sum, largest amount, and the item that has it (the least of ties)."""
    return invoices.groupBy(vendor).agg(F.sum(amount).cast("double").alias("total"), F.max(amount).cast("double").alias("largest"), F.min_by(item, F.struct((-F.col(amount)).alias("a"), item)).alias("largest_item"))


def grand_total(rows: DataFrame, plan: str, current: str) -> DataFrame:
    """The rows without total rows, and one total: what the invoice reports, if it does (the
    largest such row), else the sum."""
    name = F.upper(F.coalesce(F.col(plan), F.lit("")))
    kept = rows.where(~name.contains("TOTAL"))
    reported = rows.where(name.contains("REPORTED")).agg(F.max(current).alias("v"))
    total = kept.agg(F.coalesce(F.sum(current), F.lit(0)).alias("s")).withColumn("v", reported.scalar())
    label = F.when(F.col("v").isNotNull(), "REPORTED GRAND TOTAL").otherwise("CALCULATED GRAND TOTAL")
    return kept.select(plan, current).unionByName(total.select(label.alias(plan), F.coalesce("v", "s").cast(rows.schema[current].dataType).alias(current)))


def flagged_rates(rates: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Missing rates, a row per field, and whether each is over its limit."""
    rows = rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("rate"), (F.col(c) > limit).alias("over")) for c, limit in limits.items()])))
    return rows


def merge_integrity(before: DataFrame, after: DataFrame, amount: str, tolerance: float = 0.1) -> DataFrame:
    """The sums before and after a merge of rows, and whether they agree to the tolerance."""
    b = before.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("before_sum"))
    a = after.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("after_sum"))
    return b.withColumn("after_sum", a.scalar()).withColumn("intact", F.abs(F.col("before_sum") - F.col("after_sum")) < tolerance)


def repair_placeholders(rows: DataFrame, doc: str, order: str, last: str, first: str, plan: str, premiums: list[str], carry: list[str]) -> DataFrame:
    """Rows of a person who is named on a page before: names that stand in for one, or a missing
    name beside a premium, take name and ``carry`` from the last real person; those that sum
    others, and those with no person before them, drop out."""
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    weak = (up(first) == "") | up(last).isin("", "UNKNOWN", "NONE", "N/A", "PARTICIPANT", "MISSING")
    place = (
        (up(last).isin("MISSING", "UNKNOWN", "N/A", "PARTICIPANT", "PPT", "PPT/DEP", "DEPENDENT", "SPOUSE") & up(first).isin("FROM_PREVIOUS_PAGE", "UNKNOWN", "N/A", "PARTICIPANT")) | (up(last) == "MISSING") | (up(first) == "FROM_PREVIOUS_PAGE")
        | (up(last).isin("PARTICIPANT", "PPT", "SPOUSE", "DEPENDENT") & (up(first) == "")) | ((up(first) == "") & (up(last) == ""))
    )
    paid = F.lit(False)
    for p in premiums:
        paid = paid | (F.coalesce(p, F.lit(0)) != 0)
    place = place | (weak & paid)
    total = up(plan).rlike("|".join(TOTAL_PLANS))
    sums = total | up(first).contains("TOTAL") | up(last).contains("TOTAL")
    real = ~place & ~sums & (up(last) != "") & (up(last) != "MISSING")
    fields = [last, first, *carry]
    r = rows.withColumns({"__place": place, "__named": F.when(real, F.struct(*fields))})
    r = scan.running(r, doc, [order], {"__person": ("last", F.col("__named"))}, inclusive=False).drop("__named")
    r = r.where(~F.col("__place") | (~total & F.col("__person").isNotNull()))
    return r.withColumn("repaired", F.col("__place")).withColumns({c: F.when(F.col("__place"), F.col(f"__person.{c}")).otherwise(F.col(c)) for c in fields}).drop("__place", "__person")
