"""Facts from text: carriers, numbers, amounts, periods, answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: labels of a carrier, words of insurers' names, and words that names of insurers never hold ---
CARRIER_LABELS = ("Policy Company", "Carrier", "Insurer", "Underwritten by", "Insurance Company")
INSURER_WORDS = "Insurance|Indemnity|Assurance|Accident|Casualty|Guarantee|Underwriters"
INSURER_ENDS = r"Company|Co\.?|Fund|Group|Services?"
NOT_INSURERS = (
    "confidentiality", "privileged", "intended", "authorized", "representatives", "reliance", "communication", "error", "remove", "notify", "immediately", "subject to", "laws", "disclosure", "distribution",
    "claimant", "employee", "insured name", "loss date", "claim number",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
AMOUNT = r"([\d,]+\.\d{2})"
STATEMENT = ("opening_balance", "total_deposits", "total_withdrawals", "total_checks", "ending_balance")
#: How statements print their sums, in the order in which they are tried, and which group is what.
STATEMENT_LAYOUTS = (
    (
        rf"Opening Ledger Balance\s+\${AMOUNT}\s+Deposits and Credits\s+\d+\s+\${AMOUNT}\s+Withdrawals and Debits\s+\d+\s+\${AMOUNT}\s+Checks Paid\s+\d+\s+\${AMOUNT}\s+Ending Ledger Balance\s+\${AMOUNT}",
        {"opening_balance": 1, "total_deposits": 2, "total_withdrawals": 3, "total_checks": 4, "ending_balance": 5},
    ),
    (
        rf"(?s)Previous Balance \${AMOUNT} Payments and Other Credits \(-\) \${AMOUNT} Purchases and Other Debits \(\+\) \${AMOUNT}.*?New Balance \${AMOUNT}",
        {"opening_balance": 1, "total_deposits": 2, "total_withdrawals": 3, "ending_balance": 4},
    ),
    (rf"Amount:\s+{AMOUNT}\s+{AMOUNT}\s+{AMOUNT}-\s+{AMOUNT}-\s+{AMOUNT}", {"opening_balance": 1, "total_deposits": 2, "total_withdrawals": 3, "total_checks": 4, "ending_balance": 5}),
    (rf"Beginning Balance:\s+\${AMOUNT}\s+Ending Balance:\s+\${AMOUNT}", {"opening_balance": 1, "ending_balance": 2}),
    (
        r"Beginning\s+Deposits and\s+Checks and\s+Ending\s+balance\s+other credits\s+other debits\s+balance\s+([\d,.]*)\s+([\d,.]+)\s+([\d,.]+)\s+([\d,.]*)",
        {"opening_balance": 1, "total_deposits": 2, "total_withdrawals": 3, "ending_balance": 4},
    ),
    (rf"Total\s+\d+\s+{AMOUNT}\s+Total\s+\d+\s+{AMOUNT}", {"total_deposits": 1, "total_withdrawals": 2}),
)
#: What else stands beside the fourth layout.
BOTH_TOTALS = rf"Total Debits/Credits\s+{AMOUNT}\s+{AMOUNT}"
CHECKS_PAID = rf"Number Checks Paid: \d+ Totaling: \${AMOUNT}"
#: Words for either balance, where no layout fits.
OPENING_WORDS = rf"(?i)(?:Opening|Beginning|Previous) Balance[:\s]*\$?{AMOUNT}"
ENDING_WORDS = rf"(?i)(?:Ending|Ending Ledger|New) Balance[:\s]*\$?{AMOUNT}"
#: Words for an amount due, for other totals, and for totals that read from right to left.
DUE_WORDS = r"AMOUNT\s*DUE|BALANCE\s*DUE|TOTAL\s*DUE|TOTAL\s*AMOUNT\s*DUE|INVOICED?\s*AMOUNT"
TOTAL_WORDS = r"INVOICE\s*TOTAL|GRAND\s*TOTAL|TOTAL\s*PREMIUM|TOTALCURRENTPREMIUM|CURRENT\s*PREMIUM\s*DUE|TOTAL"
TURNED_TOTAL_WORDS = r"LATOT|EUD\s*LATOT|EUD\s*TNUOMA|EUD\s*TNUOMA\s*LATOT"
# --- end of fixed values ---


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def money(text: Column) -> Column:
    return F.regexp_replace(text, "[,$ ]", "").try_cast("decimal(18,2)")


def carrier(text: Column, not_sites: Sequence[str] = ()) -> Column:
    """The insurer that the first 120 lines name: by a label, else the longest name of a
    company (one that begins with a capital before others), else the web address, unless
    that holds one of ``not_sites``, patterns of addresses that are no insurer's."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, 120), "\n")

    def labelled(label: str) -> Column:
        c = F.regexp_replace(found(head, rf"(?i){label}:\s*([A-Z][A-Za-z&,.\s]{{2,80}})"), r"\s+$", "")
        return F.when((F.length(c) > 5) & ~F.lower(c).rlike("insured|claimant"), c)

    names = F.regexp_extract_all(head, F.lit(rf"(?i)([A-Z][A-Za-z&,.\s]{{2,80}}?\s+(?:{INSURER_WORDS})(?:\s+(?:{INSURER_ENDS}))?)"), F.lit(1))
    wide = lambda x: x.rlike("\t|  ") & ~F.lower(x).rlike(r"company|co\.|fund|group")
    fits = lambda x: (F.length(F.trim(x)).between(5, 100)) & ~F.lower(x).rlike("|".join(NOT_INSURERS)) & ~wide(x)
    good = F.transform(F.filter(names, fits), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    ranked = F.transform(good, lambda x, i: F.struct((~x.rlike("^[A-Z]")).cast("int").alias("r"), (-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    best = F.array_min(ranked)["x"]
    domain = F.regexp_replace(F.regexp_replace(F.regexp_extract(head, r"(?i)(https?://\S+|www\.\S+)", 1), "(?i)^https?://", ""), "/.*$", "")
    domain = F.regexp_replace(F.regexp_replace(domain, r"[.,);]+$", ""), r"(?i)^www\.", "")
    parts = F.filter(F.split(F.substring_index(domain, ".", 1), "[_-]+"), lambda t: t != "")
    pretty = F.array_join(F.transform(parts, lambda t: F.when(F.length(t) <= 4, F.upper(t)).otherwise(F.initcap(t))), " ")
    site = F.when((domain != "") & ~F.lower(domain).rlike("|".join(not_sites) or "^$"), F.coalesce(F.nullif(pretty, F.lit("")), domain))
    return F.coalesce(*[labelled(x) for x in CARRIER_LABELS], best, site)


def claim_numbers(text: Column) -> Column:
    """The distinct numbers that follow the word claim, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)Claim#?\s*(\d+)"), F.lit(1))))


def estimated_annual(text: Column) -> Column:
    """The amount behind ``Estimated Annual``, 0 if there is none."""
    return F.coalesce(money(found(text, r"(?i)Estimated\s+Annual\s*([$\s]*[0-9][0-9,]*(?:\.[0-9]{1,2})?)")), F.lit(0).cast("decimal(18,2)"))


def stated_totals(text: Column) -> Column:
    """(due, other): the amounts behind words for an amount due, and behind other words for
    totals, to which come those that read from right to left."""
    up = F.upper(F.coalesce(text, F.lit("")))
    every = lambda words, amount: F.regexp_extract_all(up, F.lit(rf"(?:{words})\s*[:$]*\s*{amount}"), F.lit(1))
    due = every(DUE_WORDS, r"([0-9,]+\.[0-9]{2})")
    other = every(TOTAL_WORDS, r"([0-9,]+\.[0-9]{2})")
    turned = F.transform(every(TURNED_TOTAL_WORDS, r"([0-9]{2}\.[0-9,]+)\$"), lambda x: F.reverse(x))
    values = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())
    return F.struct(values(due).alias("due"), values(F.concat(other, turned)).alias("other"))


def form_answers(text: Column, questions: int = 24) -> Column:
    """A map q1, q2, ... to Y or N of the form's fields that are answered."""
    answer = lambda i: F.upper(F.left(found(text, rf"(?i)P3_GIO_Q{i}:\s*(Y(?:es)?|N(?:o)?)"), F.lit(1)))
    entries = F.filter(F.array(*[F.struct(F.lit(f"q{i}").alias("key"), answer(i).alias("value")) for i in range(1, questions + 1)]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def statement_metadata(text: Column) -> Column:
    """(account_number, period_start, period_end) of a statement, in either of two forms."""
    day = rf"(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}"
    numeric = r"(?i)For\s+the\s+period\s+(\d{2}/\d{2}/\d{4})\s+to\s+(\d{2}/\d{2}/\d{4})"
    worded = rf"(?i)({day})\s+through\s+({day})"
    return F.struct(
        F.trim(found(text, r"(?i)Account\s+Number:\s*([A-Z0-9X\-]+)")).alias("account_number"), F.coalesce(found(text, numeric, 1), found(text, worded, 1)).alias("period_start"),
        F.coalesce(found(text, numeric, 2), found(text, worded, 2)).alias("period_end"),
    )


#: Heading cells of an invoice's facts.
CELL_KEYS = {"INV_NUMBER": "INVOICE_NUMBER|INV_NUMBER|INVOICE_NUM|BILL_NUMBER", "INV_DATE": "INVOICE_DATE|INV_DATE|BILL_DATE|STATEMENT_DATE", "BILLING_PERIOD": "BILLING_PERIOD|COVERAGE_PERIOD|PERIOD"}


def cell_facts(cells: Column) -> Column:
    """Facts from a row of cells that names and values take in turn; of two names the last counts."""
    full = F.filter(F.transform(cells, lambda c: F.trim(c.cast("string"))), lambda c: c.isNotNull() & (c != ""))
    pairs = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.regexp_replace(F.upper(F.get(xs, i * 2)), "[ -]", "_").alias("k"), F.get(xs, i * 2 + 1).alias("v")))

    def fact(name: str) -> Column:
        earlier = list(CELL_KEYS.values())[: list(CELL_KEYS).index(name)]
        taken = lambda p: reduce(lambda a, b: a | b, [p["k"].rlike(e) for e in earlier], F.lit(False))
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(pairs(full), lambda p: p["k"].rlike(CELL_KEYS[name]) & ~taken(p) & p["v"].isNotNull()), lambda p: p["v"])), -1).alias(name)

    return F.struct(*[fact(n) for n in CELL_KEYS])


def with_year(start: Column, period: Column) -> Column:
    """A month and day in digits takes the year that its period ends with, if the period has
    one; a date of any other form stays."""
    year = F.regexp_extract(period, r"(\d{4})\s*$", 1)
    return F.when((year != "") & start.rlike(r"^\d{1,2}[/-]\d{1,2}$"), F.concat(F.replace(start, F.lit("-"), F.lit("/")), F.lit("/"), year)).otherwise(start)


def period_start(text: Column) -> Column:
    """The first date of a period: before to, thru or through, before a spaced dash, before any
    dash where dates have slashes or dots, or the first of two ISO dates; else the text.  A
    start without a year takes that of the end."""
    t = F.trim(text)
    cut = lambda p: with_year(F.trim(F.get(F.split(t, p), F.lit(0))), t)
    word, spaced, dash = r"(?i)\s+\b(?:to|thru|through)\b\s+", r"\s+[-–—]\s*|[-–—]\s+", "[-–—]"
    iso = F.regexp_extract(t, r"^([^-]*-[^-]*-[^-]*)-", 1)
    return (
        F.when(F.lower(t).isin("", "n/a", "none"), text).when(t.rlike(word), cut(word)).when(t.rlike(spaced), cut(spaced)).when(t.rlike("[/.]") & t.rlike(dash), cut(dash))
        .when(F.length(t) - F.length(F.replace(t, F.lit("-"), F.lit(""))) >= 5, iso).otherwise(t)
    )


def both_ends(text: Column, parse) -> Column:
    """Both dates of a period as ``m/d/yyyy - m/d/yyyy``, one date as ``m/d/yyyy``; what is no date stays."""
    us = lambda x: F.concat_ws("/", F.month(x).cast("string"), F.dayofmonth(x).cast("string"), F.year(x).cast("string"))
    t = F.trim(text)
    ends = F.transform(F.split(t, "-"), lambda p: parse(with_year(F.trim(p), t)))
    ranged = t.contains("-") & ~t.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~t.rlike(r"^\d{1,2}-\d{1,2}-\d{2,4}$") & (F.size(ends) == 2) & F.get(ends, F.lit(0)).isNotNull() & F.get(ends, F.lit(1)).isNotNull()
    one = parse(t)
    return F.when(ranged, F.concat(us(F.get(ends, F.lit(0))), F.lit(" - "), us(F.get(ends, F.lit(1))))).when(one.isNotNull(), us(one)).otherwise(text)


def timestamp(text: Column) -> Column:
    """Timestamps as logs write them, plain ones in UTC, others with Z or an offset; null if none."""
    t = F.trim(text)
    plain = t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    return F.when(plain, F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(t).try_cast("timestamp")


def statement_summary(text: Column) -> Column:
    """Opening and ending balance and totals, by the first of the known layouts that fits, else
    by the words for either balance."""
    t = F.coalesce(text, F.lit(""))
    none = F.lit(None).cast("decimal(18,2)")

    def fields(pattern: str, groups: dict[str, int]) -> Column:
        found_ = {n: money(found(t, pattern, groups[n])) if n in groups else none for n in STATEMENT}
        if set(groups) == {"opening_balance", "ending_balance"}:  # the totals stand elsewhere
            found_ |= {"total_deposits": money(found(t, BOTH_TOTALS, 2)), "total_withdrawals": money(found(t, BOTH_TOTALS, 1)), "total_checks": money(found(t, CHECKS_PAID))}
        return F.when(t.rlike(pattern), F.struct(*[found_[n].alias(n) for n in STATEMENT]))

    words = {"opening_balance": money(found(t, OPENING_WORDS)), "ending_balance": money(found(t, ENDING_WORDS))}
    return F.coalesce(*[fields(p, g) for p, g in STATEMENT_LAYOUTS], F.struct(*[words.get(n, none).alias(n) for n in STATEMENT]))
