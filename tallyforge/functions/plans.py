"""Benefit plans: types, names and tiers from free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: plan types by words of the plan's name, the first that fits; what no rule names ---
PLAN_RULES: dict[str, tuple[tuple[tuple[str, tuple[str, ...]], ...], str | None]] = {
    "product": ((("DENTAL", ("DENTAL",)), ("VISION", ("VISION",)), ("LIFE", ("LIFE", "AD&D")), ("STD", ("STD", "SHORT TERM")), ("LTD", ("LTD", "LONG TERM"))), "MEDICAL"),
    "row": ((("DENTAL", ("DENTAL",)), ("VISION", ("VISION",)), ("LIFE", ("LIFE",)), ("AD&D", ("AD&D",)), ("MEDICAL", ("POS", "EPO", "PPO", "HMO", "CHC", "NHP", "MEDICAL", "HEALTH"))), None),
    "voluntary": ((("AD&D", ("AD&D",)), ("LIFE", ("LIFE",)), ("STD", ("STD",)), ("LTD", ("LTD",)), ("DENTAL", ("DEN",)), ("VISION", ("VIS",))), "VOLUNTARY"),
    "benefit": ((("ACCIDENT", ("ACCIDENT",)), ("DENTAL", ("DENTAL",)), ("VISION", ("VISION",)), ("LIFE", ("LIFE",)), ("LTD", ("LTD",)), ("STD", ("STD",)), ("MEDICAL", ("MEDICAL",))), "OTHER"),
    "colonial": ((("ACCIDENT", ("ACCIDENT",)), ("CRITICAL ILLNESS", ("CRITICAL",)), ("HOSPITAL INDEMNITY", ("HOSPITAL",)), ("LIFE", ("LIFE",))), None),
}
#: Plan types that stand for none: a tier in the wrong column, or nothing.
NO_TYPE = ("", "NONE", "NOT FOUND", "EE", "FAM", "SP", "CH", "DEP", "NAN", "UNKNOWN")
LOCATIONS = ("SAND", "MARV", "BEAC", "JAX")
TIERS_IN_NAME = ("REN", "SE", "USE")
PLAIN_CATEGORIES = ("HEALTH", "DENTAL", "VISION", "LIFE", "AD&D", "STD", "LTD")
# --- end of fixed values ---


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def plan_type(name: Column, rules: str = "product", otherwise: Column | None = None) -> Column:
    """The plan's type by its name, under one of the rule sets."""
    kinds, default = PLAN_RULES[rules]
    p = F.upper(F.coalesce(name, F.lit("")))
    out = otherwise if otherwise is not None else F.lit(default)
    for kind, words in reversed(kinds):
        out = F.when(has_any(p, words), kind).otherwise(out)
    return out


def repaired_type(plan: Column, kind: Column) -> Column:
    """The type as given, or by the plan's name if it stands for none."""
    return F.when(F.upper(F.coalesce(kind, F.lit(""))).isin(*NO_TYPE), plan_type(plan, "row", kind)).otherwise(kind)


def tier_in_plan(name: Column) -> Column:
    p = F.upper(F.coalesce(name, F.lit("")))
    return F.when(p.contains("SPOUSE"), "ES").when(p.contains("CHILD"), "EC").when(p.contains("FAMILY"), "FAM").otherwise("EE")


def spaced_plan(name: Column) -> Column:
    """Single spaces; ``TGLife`` to ``TG Life``, ``P7330`` to ``P 7330``."""
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(t, r"^(?i:TG)([A-Za-z&])", "TG $1"), r"(\bP)(\d{4})", "$1 $2")


def blue_type(name: Column) -> Column:
    """A blue plan has no type of its own, but a bare category is its own type."""
    return F.when(F.upper(name).isin(*PLAIN_CATEGORIES), name)


def blue_plan(name: Column) -> Column:
    """A blue plan's name: no location in front, no tier words, BLUECARE first, NFO read as
    NFQ.  Bare categories stay as they are."""
    t = F.trim(F.regexp_replace(name, rf"^(?i:{'|'.join(LOCATIONS)})\s*", ""))
    t = F.trim(F.regexp_replace(t, rf"\b(?i:{'|'.join(TIERS_IN_NAME)})\b", ""))
    t = F.regexp_replace(t, r"\s+", " ")
    turned = F.concat(F.lit("BLUECARE "), F.trim(F.regexp_replace(t, "(?i)BLUECARE", "")))
    t = F.when(F.upper(t).contains("BLUECARE") & ~F.upper(t).startswith("BLUECARE"), turned).otherwise(t)
    fixed = F.trim(F.regexp_replace(t, r"\b(?i:NFO|INFO)\b", "NFQ"))
    return F.when(F.upper(name).isin(*PLAIN_CATEGORIES), name).otherwise(fixed)
