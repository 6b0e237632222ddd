"""Names, codes and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
SENTINELS = ("", "none", "null", "n/a", "nan", "not provided", "unknown", "not available")
STATUS = {
    "C": "Closed", "CL": "Closed", "CLOSED": "Closed", "RECLOSED": "Closed",
    "O": "Open", "OP": "Open", "OPEN": "Open",
    "R": "Reopened", "RC": "Reopened", "REOP": "Reopened", "REOPENED": "Reopened", "REOPEN": "Reopened",
}
INJURY = (("Indemnity", "COMP|TTD|TPD|PPD|INDEM"), ("Medical Only", "MED"), ("Expense", "EXP"))
COVERAGE = {
    "E": "EE", "ES": "ES", "ESC": "FAM", "EC": "EC", "F": "FAM", "S": "ES", "C": "EC", "E E": "EE", "EE": "EE", "FAM": "FAM",
    "EMPLOYEE ONLY": "EE", "EMPLOYEE AND SPOUSE": "ES", "EMPLOYEE AND FAMILY": "FAM", "EMPLOYEE AND CHILD": "EC", "EMPLOYEE AND CHILD(REN)": "EC",
    "EMPLOYEE & ONE OR MORE DEPENDENT": "EC", "EMPLOYEE & TWO OR MORE DEPENDENTS": "EC", "EMPLOYEE & THREE OR MORE DEPENDENTS": "EC",
    "EMPLOYEE & FOUR OR MORE DEPENDENTS": "EC", "EMPLOYEE & FIVE OR MORE DEPENDENTS": "EC",
    "E1D": "EC", "E2D": "EC", "E3D": "EC", "E4D": "EC", "E5D": "EC", "E6D": "EC", "E7D": "EC", "E8D": "EC", "E9D": "EC",
}
PHANTOMS = (
    "john smith", "smith john", "john doe", "doe john", "jane smith", "smith jane", "jane doe", "doe jane", "alice johnson", "johnson alice", "michael johnson", "johnson michael", "escort service", "insurance company",
    "employers insurance", "policy total", " llc", " corp", " inc", "placeholder", "test person",
)
CORPORATE = "LLC|INC|CORP|CORPORATION|LIMITED|SERVICES|PLC|COMPANY|INSURED"
# --- end of fixed values ---


def no_sentinel(text: Column) -> Column:
    """Null where the text stands for nothing."""
    return F.when(F.lower(F.trim(text)).isin(*SENTINELS), F.lit(None)).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_parts(name: Column) -> Column:
    """(last, first, middle) of ``Last, First Middle`` or ``First Middle Last``."""
    t = squeeze(name)
    comma = t.contains(",")
    head = F.trim(F.substring_index(t, ",", 1))
    tail = F.split(F.trim(F.regexp_replace(t, r"^[^,]*,", "")), " ")
    spaced = F.split(t, " ")
    n = F.size(spaced)
    rest = lambda a, lo, n: F.nullif(F.array_join(F.slice(a, lo, F.greatest(n, F.lit(0))), " "), F.lit(""))
    last = F.when(comma, head).otherwise(F.element_at(spaced, -1))
    first = F.when(comma, F.nullif(F.get(tail, F.lit(0)), F.lit(""))).when(n > 1, F.get(spaced, F.lit(0)))
    middle = F.when(comma, rest(tail, 2, F.size(tail) - 1)).when(n > 2, rest(spaced, 2, n - 2))
    return F.when(t.isNotNull() & (t != ""), F.struct(last.alias("last"), first.alias("first"), middle.alias("middle")))


def last_first(name: Column) -> Column:
    """``John M. Smith`` to ``Smith, John M.``; null for stand-ins of no name."""
    t = squeeze(name)
    turned = F.concat(F.regexp_extract(t, r"(\S+)$", 1), F.lit(", "), F.regexp_replace(t, r"\s+\S+$", ""))
    return F.when(no_sentinel(t).isNull(), F.lit(None)).when(t.contains(",") | ~t.contains(" "), t).otherwise(turned)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for the upper-case key, else null; a literal map, one expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(key)))


def claim_status(raw: Column) -> Column:
    return F.coalesce(lookup(raw, STATUS), F.upper(F.trim(raw)))


def yes_no(raw: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit("N")))).isin("Y", "YES", "TRUE", "1"), yes).otherwise(no)


def injury_type(raw: Column) -> Column:
    out = raw
    for label, words in reversed(INJURY):
        out = F.when(F.upper(raw).rlike(words), label).otherwise(out)
    return out


def coverage(raw: Column) -> Column:
    """Coverage codes to EE, ES, EC or FAM; others stay."""
    return F.coalesce(lookup(raw, COVERAGE), raw)


def coverage_from_text(text: Column) -> Column:
    t = F.upper(text)
    return (
        F.when(t.rlike("FAM|SPOUSE.*CHILD"), "FAM").when(t.rlike("CHILD|CH\\b|DEPENDENT"), "EC").when(t.rlike("SPOUSE|SP\\b"), "ES").when(t.rlike("EMP|EE|SINGLE"), "EE")
    )


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def name_key(first: Column, last: Column) -> Column:
    """A key that does not depend on which part is the first name."""
    return plain_key(plain(first), plain(last))


def plain_key(first: Column, last: Column) -> Column:
    """``name_key`` of parts that are plain already."""
    return F.concat(F.least(first, last), F.greatest(first, last))


def id_text(raw: Column) -> Column:
    """Ids as text: no ``.0`` tail; four or more leading zeros go if three digits are left."""
    t = F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")
    return F.when(t.rlike(r"^0{4,}[1-9][0-9]{2,}$"), F.regexp_replace(t, "^0+", "")).otherwise(t)


def invoice_number(raw: Column, total: Column) -> Column:
    """Invoice numbers as text: none where it is the invoice's total in cents, padded with
    zeros; without four or more zeros in front if three digits or more are left."""
    t = raw.cast("string")
    bare = F.regexp_replace(t, "^0+", "")
    amount = (F.length(t) > 8) & (total > 0) & (bare == F.round(total * 100, 0).cast("decimal(18,0)").cast("string"))
    short = F.regexp_replace(t, "[.-]", "").rlike(r"^\d+$") & (F.length(t) - F.length(bare) >= 4) & (F.length(bare) >= 3)
    return F.when(~F.coalesce(amount, F.lit(False)), F.when(short, bare).otherwise(t))


def stands_in(name: Column) -> Column:
    """Whether a name stands for nobody: an example's name, or a business."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[,.]", "")
    out = F.lit(False)
    for p in PHANTOMS:
        out = out | t.contains(p)
    return out


def sheet_coverage(raw: Column) -> Column:
    """Coverage as sheets word it; numbers are none, and what fits no rule stays."""
    t = F.upper(F.coalesce(raw, F.lit("")))
    has = lambda *w: F.forall(F.array(*[F.lit(x) for x in w]), lambda x: t.contains(x))
    return (
        F.when(F.regexp_replace(t, r"\.", "").rlike(r"^\d+$"), F.lit(None)).when(has("EMP", "CH"), "EC").when(has("EMP", "SP"), "ES").when(has("EE", "ONLY"), "EE").when(has("FAM"), "FAM").when(has("EE + SP"), "ES")
        .when(has("EE + CH"), "EC").when(has("EMP"), "EE").when(has("CH"), "EC").when(has("SP"), "ES").otherwise(raw)
    )


def zero_stripped(raw: Column) -> Column:
    return F.regexp_replace(raw.cast("string"), "^0+", "")


def file_name(raw: Column) -> Column:
    return F.regexp_replace(raw, r'[\\/:*?"<>|]', "_")


def is_summary_label(text: Column, keywords: str = "total|summary|subtotal|legend|balance due|previous balance|grand total") -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(keywords)


def is_corporate(name: Column) -> Column:
    return F.upper(F.coalesce(name, F.lit(""))).rlike(rf"\b({CORPORATE})\b")


def mirrored(line: Column) -> Column:
    """The line read from right to left."""
    return F.reverse(line)
