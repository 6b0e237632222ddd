"""Dates as text, months without years, and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "yyyyMM", "M/yyyy", "MMMM yyyy", "MMM yyyy")
# --- fixed values: labels of ages and their last days ---
AGE_LABELS = ("0-30 Days", "31-90 Days", "91-180 Days", "181-365 Days", "Over 365 Days")
AGE_ENDS = (30, 90, 180, 365)
# --- end of fixed values ---


def loose_date(text: Column) -> Column:
    """The first of the known formats that fits; day and month change places if the month
    would be over 12; null if none fits."""
    t = F.trim(text)
    swapped = F.regexp_replace(t, r"^(1[3-9]|2[0-9]|3[01])[/-](\d{1,2})[/-](\d{4})$", "$2/$1/$3")
    return F.coalesce(*[F.try_to_timestamp(swapped, F.lit(f)).cast("date") for f in FORMATS])


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def us_date(text: Column) -> Column:
    """``m/d/yyyy`` without leading zeros, of a date or of the first one inside a text; a month
    alone is its first day; a day beyond 12 in front changes places with the month.  Text
    without a date stays."""
    d, t = loose_date(text), F.trim(text)
    n = lambda p, i: F.regexp_extract(t, p, i).try_cast("int").cast("string")
    month = lambda p, i: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(F.regexp_extract(t, p, i), F.lit(3)))), F.lit(0)).cast("string")
    joined = lambda *parts: F.when(F.forall(F.array(*parts), lambda x: x.isNotNull()), F.concat_ws("/", *parts))
    ymd, mdy, named, my = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", r"([A-Za-z]+)\.?\s+(\d{1,2})[,\s]+(\d{4})", r"(\d{1,2})[/-](\d{4})"
    year = F.when(F.length(F.regexp_extract(t, mdy, 3)) == 4, F.regexp_extract(t, mdy, 3)).otherwise(F.concat(F.lit("20"), F.regexp_extract(t, mdy, 3)))
    first, second = n(mdy, 1), n(mdy, 2)
    turned = (first.cast("int") > 12) & (second.cast("int") <= 12)
    inside = (
        F.when(t.rlike(ymd), joined(n(ymd, 2), n(ymd, 3), F.regexp_extract(t, ymd, 1))).when(t.rlike(mdy), joined(F.when(turned, second).otherwise(first), F.when(turned, first).otherwise(second), year))
        .when(t.rlike(named), joined(month(named, 1), n(named, 2), F.regexp_extract(t, named, 3))).when(t.rlike(my), joined(n(my, 1), F.lit("1"), F.regexp_extract(t, my, 2)))
    )
    whole = F.concat_ws("/", F.month(d).cast("string"), F.dayofmonth(d).cast("string"), F.year(d).cast("string"))
    return F.when(d.isNotNull(), whole).otherwise(F.coalesce(inside, text))


def claim_year(text: Column) -> Column:
    """The leading four digits, else any year of 19xx or 20xx in the text."""
    t = F.trim(text)
    return F.coalesce(F.left(t, F.lit(4)).try_cast("int"), F.nullif(F.regexp_extract(t, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int"))


def month_day(text: Column) -> Column:
    """``MM/DD`` in the leap year 2000; null if it is no day."""
    p = F.split(F.regexp_replace(F.trim(text), r"[-.]", "/"), "/")
    m, d = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
    return F.when(F.size(p) == 2, F.try_to_timestamp(F.format_string("2000-%02d-%02d", m, d), F.lit("yyyy-MM-dd")).cast("date"))


def month_day_gap(a: Column, b: Column) -> Column:
    """Days between two ``MM/DD``, round the turn of the year; 999 if one is no day."""
    gap = F.abs(F.datediff(month_day(a), month_day(b)))
    return F.coalesce(F.when(gap > 300, F.abs(gap - 365)).otherwise(gap), F.lit(999))


def age_bucket(days: Column) -> Column:
    """The label of an age in days; null for ages below zero."""
    out = F.lit(AGE_LABELS[-1])
    for end, label in reversed(list(zip(AGE_ENDS, AGE_LABELS, strict=False))):
        out = F.when(days <= end, label).otherwise(out)
    return F.when(days > -1, out)
