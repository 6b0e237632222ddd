"""Currency text to numbers.  Each source of text has its own habits, so each has its own parser.

All are Column expressions; text that is no number gives 0 (or null where said).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)  # the text "nan" is no number


def sheet_money(text: Column) -> Column:
    """``$1,234.50`` to 1234.5; anything else that is no number to 0."""
    return F.coalesce(_number(F.regexp_replace(text.cast("string"), r"[$,]", "")), F.lit(0.0))


def signed_money(text: Column) -> Column:
    """As ``sheet_money``, with ``(12.00)`` negative and a lone dash 0."""
    t = F.trim(F.regexp_replace(text.cast("string"), r"[$,]", ""))
    inner = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    return F.when(t.isNull() | t.isin("", "-") | (F.lower(t) == "nan"), F.lit(0.0)).otherwise(F.coalesce(_number(inner), F.lit(0.0)))


def bracketed_money(text: Column) -> Column:
    """Negative if there are parentheses anywhere; all but digits, point and minus dropped."""
    t = text.cast("string")
    v = F.coalesce(_number(F.regexp_replace(t, r"[^0-9.\-]", "")), F.lit(0.0))
    return F.when(t.contains("(") & t.contains(")"), -F.abs(v)).otherwise(v)


def claim_amount(text: Column, keep_sign: bool = True) -> Column:
    """Digits and point of a claim amount.  The sign is kept; ``keep_sign=False`` gives the
    historical reading, which loses it."""
    return F.coalesce(_number(F.regexp_replace(text.cast("string"), r"[^0-9.\-]" if keep_sign else r"[^0-9.]", "")), F.lit(0.0))


def form_number(text: Column) -> Column:
    """Numbers of application forms: digits, point and minus."""
    return F.coalesce(_number(F.regexp_replace(text.cast("string"), r"[^0-9.\-]", "")), F.lit(0.0))


def statement_amount(text: Column) -> Column:
    """Amounts of statements: ``(x)`` and ``x-`` are negative, ``.50`` is 0.5; null if no number."""
    t = F.regexp_replace(F.trim(text.cast("string")), r"[$,\s]", "")
    negative = t.rlike(r"^\(.*\)$") | t.endswith("-")
    v = _number(F.regexp_replace(t, r"[()]|-$", ""))
    return F.when(negative, -F.abs(v)).otherwise(v)


def cents(x: Column) -> Column:
    """Exact two-place decimals: sums of these do not depend on their order."""
    return x.cast("decimal(18,2)")
