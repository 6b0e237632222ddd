"""Whether extracted text can be used, what kind of document it is, and how to repair it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once
from .documents import char_counts

# --- fixed values: words to expect, and words read from right to left ---
CLAIM_WORDS = ("claim", "policy", "insured", "date", "amount", "paid", "reserve", "total")
BANK_WORDS = (
    "account", "statement", "balance", "date", "amount", "transaction", "deposit", "withdrawal", "credit", "debit", "summary", "check", "posting", "effective", "description",
)
TURNED_CLAIM_WORDS = (
    "tropeR", "mialC", "ycailoP", "oitaR", "ssoL", "diap", "redloHyciioP", "tnebmucnI", "enO", "emaN", "rebuN", "etaD", "7OSS", "GZOZ", "GCOC", "Ayjuwapu|", "wield", "sisAjeuy", "eyeq", "ebeg",
    "OQUINN", "awWeN", "JUNODDY", "uonwaop", "uoniiep", "YOSBIA9S", "YOSOIAOS", "COCG", "ZOZG",
)
TURNED_WORDS = ("tropeR", "mialC", "ycailoP", "ssoL", "diap", "ecnarusnI", "noitazilitu", "eciovni", "arboC", "egarevoC", "namuH", "atneD", "noisiV", "gnilliB")
TURNED_INVOICE_WORDS = (
    "sdioani", "s0iovui", "adiovui", "eciovni", "eciovnu", "esos", "szoz", "scoz", "ezos", "voitaat2", "240ivaa2", "evitatneserper", "sssal9", "anig", "auie", "anigruoc", "anamuh", "ytnuoc",
)
# --- end of fixed values ---


@dataclass(frozen=True)
class Limits:
    """What a text may have at most or must have at least."""

    chars_per_page: int = 200
    cids: int = 30
    noise: float = 0.20
    words: int = 4
    noisy_lines: float = 0.15
    expected: Sequence[str] = CLAIM_WORDS
    turned: Sequence[str] = TURNED_CLAIM_WORDS


CLAIMS = Limits()
BANK = Limits(100, 15, 0.18, 4, 0.25, BANK_WORDS, ())


def _kept(text: Column, chars: str) -> Column:
    """How many characters of a class a text has; runs of others go in one step."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur, as they are or without regard to case."""
    return once(F.coalesce(F.lower(text), F.lit("")), lambda low: _found(low, words))


def _found(low: Column, words: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(w.lower()) for w in words]) if words else F.array().cast("array<string>")
    return F.size(F.filter(wanted, lambda w: F.contains(low, w)))


def measured(text: Column, pages: Column, limits: Limits = CLAIMS) -> Column:
    """The eight measures of a text, as a struct.  Each pass over the text is made once."""

    def of_text(t: Column) -> Column:
        odd = F.filter(F.regexp_extract_all(t, F.lit("[a-zA-Z]{9,}"), F.lit(0)), lambda w: (F.length(w) - F.length(F.translate(w, "aeiouAEIOU", ""))) / F.length(w) < 0.15)
        words = once(F.lower(t), lambda low: F.struct(_found(low, limits.expected).alias("expected"), _found(low, limits.turned).alias("turned")))
        return once(F.struct(char_counts(t, " \t\r\x0b\x0c").alias("c"), words.alias("w")), lambda m: F.struct(
            m["c"]["cids"].alias("cids"), F.when(m["c"]["dense"] > 0, 1 - m["c"]["alnum"] / m["c"]["dense"]).otherwise(F.lit(1.0)).alias("noise"),
            F.floor(F.length(t) / F.greatest(pages, F.lit(1))).cast("int").alias("chars_per_page"), m["w"]["expected"].alias("words"),
            (m["c"]["vowels"] / F.greatest(m["c"]["alpha"], F.lit(1))).alias("vowels"), m["c"]["alpha"].alias("letters"), F.size(odd).alias("nonsense"),
            (m["c"]["noisy"] / F.greatest(m["c"]["lines"], F.lit(1))).alias("noisy_lines"), m["w"]["turned"].alias("turned"),
        ))

    return once(F.coalesce(text, F.lit("")), of_text)


def shown(m: Column) -> Column:
    """The measures with shares rounded to three places, as reports and the score have them."""
    for c in ("noise", "vowels", "noisy_lines"):
        m = m.withField(c, F.round(m[c], 3))
    return m


def reasons(m: Column, limits: Limits = CLAIMS) -> Column:
    """What speaks against a text, in order; ``m`` are its measures, not rounded."""
    return F.array_compact(F.array(
        F.when(m["cids"] > limits.cids, "cids"), F.when(m["noise"] > limits.noise, "noise"), F.when(m["chars_per_page"] < limits.chars_per_page, "sparse"), F.when(m["words"] < limits.words, "words"),
        F.when((m["letters"] > 100) & (m["vowels"] < 0.22), "vowels"), F.when(m["nonsense"] > 3, "nonsense"), F.when(m["noisy_lines"] > limits.noisy_lines, "lines"), F.when(m["turned"] >= 2, "turned"),
    ))


def score(text: Column, m: Column, limits: Limits = CLAIMS) -> Column:
    """From 0 (unusable) to 1; it goes by the measures as they are shown."""
    m = shown(m)
    penalty = (
        F.when(m["cids"] > limits.cids, 0.4).otherwise(0.0) + F.when(m["noise"] > limits.noise, F.least(F.lit(0.3), m["noise"])).otherwise(0.0) + F.when(m["vowels"] < 0.22, 0.2).otherwise(0.0)
        + F.when(m["noisy_lines"] > limits.noisy_lines, F.least(F.lit(0.2), m["noisy_lines"])).otherwise(0.0) + F.greatest(F.lit(0), limits.words - m["words"]) * 0.05
    )
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - penalty, 3)))


def recommendation(text: Column, m: Column, limits: Limits = CLAIMS) -> Column:
    """ok, dpi_fallback (read again, finer) or full_vision (read the picture)."""
    ok = (F.size(reasons(m, limits)) == 0) & (F.coalesce(text, F.lit("")) != "")
    return F.when(ok, "ok").when(score(text, m, limits) < 0.4, "full_vision").otherwise("dpi_fallback")


def amounts_missing(text: Column) -> Column:
    """Whether a statement's amounts are cut off: a heading within the first 25 lines names an
    amount, and of two or more dated rows behind it one has none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    heading = r"(?i)\b(Amount|Total|Balance|Charge|Credit|Debit)\b"
    day = r"\b\d{1,2}[/\-]\d{1,2}\b|(?i:\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}\b)"

    def verdict(ls: Column) -> Column:
        at = F.array_position(F.transform(F.slice(ls, F.lit(1), F.lit(25)), lambda x: x.rlike(heading)), F.lit(True)).cast("int")
        dated = F.filter(F.slice(ls, at + 1, F.size(ls)), lambda x: x.rlike(day))
        bare = F.filter(dated, lambda x: ~x.rlike(r"\b\d[\d,]*\.\d{2}\b"))
        return (at > 0) & (F.size(dated) >= 2) & (F.size(bare) >= 1)

    return once(lines, verdict)


def page_health(text: Column, limits: Limits = BANK) -> Column:
    """(needs_patch, force): whether a statement's page must be read again, and in full."""
    t = F.coalesce(text, F.lit(""))
    m = measured(text, F.lit(1), limits)

    def verdict(m: Column) -> Column:
        marks = t.rlike("(?i)Date|Amount|Description|Balance|Transaction|Deposit|Withdrawal")
        heads = t.contains("Beginning Balance") | t.contains("ACCOUNT SUMMARY") | t.contains("Direct Deposit Information")
        shredded = F.size(F.filter(F.split(t, "\n"), lambda x: (F.length(F.trim(x)) < 15) & x.rlike("[0-9]"))) > 20
        advice, points = recommendation(text, m, limits), score(text, m, limits)
        sparse = (F.length(F.trim(t)) < 200) & marks
        patch = (m["cids"] > 10) | shredded | sparse | (marks & ~heads) | (advice == "full_vision") | ((advice == "dpi_fallback") & ((m["cids"] > 50) | (points < 0.7)))
        return F.struct(patch.alias("needs_patch"), (patch & (shredded | (advice == "full_vision"))).alias("force"), points.alias("score"), advice.alias("advice"))

    return once(m, verdict)


def unreadable_page(text: Column, least: int = 100) -> Column:
    """A page without readable text: too short, few letters, or full of glyph codes."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.length(t)
    garbage = (_kept(t, "a-zA-Z0-9") < n * 0.3) | (F.regexp_count(t, F.lit("/[0-9]")) > n * 0.05) | (F.regexp_count(t, F.lit(r"\(cid:")) * 7 > n * 0.1)
    return (n < least) | garbage


def without_watermarks(text: Column, marks: Sequence[str]) -> Column:
    """The text without the marks, whatever their case."""
    for m in marks:
        if m.strip():
            text = F.regexp_replace(text, F.lit("(?i)\\Q" + m + "\\E"), F.lit(""))
    return text


def as_table_lines(text: Column) -> Column:
    """Lines of three cells or more, three spaces or more apart, with bars around the cells."""

    def one(line: Column) -> Column:
        cells = F.split(line, " {3,}")
        full = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
        return F.when((F.size(cells) >= 3) & (F.size(full) > 0), F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def tabs_as_cells(text: Column, more_than: int = 5) -> Column:
    """Lines of many tab-parted cells with bars, empty cells kept."""

    def one(line: Column) -> Column:
        cells = F.split(line, "\t")
        return F.when(F.size(cells) > more_than, F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.when(F.trim(c) == "", F.lit("   ")).otherwise(c)), " | "), F.lit(" |"))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def is_turned(text: Column, words: Sequence[str] = TURNED_WORDS, least_length: int = 50) -> Column:
    """Whether two words or more read from right to left."""
    return (F.length(F.coalesce(text, F.lit(""))) >= least_length) & (word_hits(F.coalesce(text, F.lit("")), words) >= 2)


def turned_back(text: Column) -> Column:
    """Every line read from its end."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.reverse(x)), "\n")


def pages_turned_back(text: Column, marker: str = r"--- PAGE|\[\[PAGE_\d+\]\]") -> Column:
    """Text with page marks in which the pages that read backwards are turned."""

    def read(page: Column) -> Column:
        # a word that stands unbroken stays so without what is between words: most are told by that
        backwards = (word_hits(page, TURNED_INVOICE_WORDS) >= 2) | (word_hits(F.regexp_replace(page, "[^a-zA-Z0-9]+", ""), TURNED_INVOICE_WORDS) >= 2)
        return F.when(backwards, turned_back(page)).otherwise(page)

    def marked(piece: Column) -> Column:  # a mark and the page behind it; the first has no mark
        return once(F.regexp_extract(piece, f"^(?:{marker})", 0), lambda mark: F.concat(mark, read(F.substr(piece, F.length(mark) + 1))))

    return F.array_join(F.transform(F.split(text, f"(?={marker})"), marked), "")


# --- fixed values: words that tell document types, in names and in contents ---
NAME_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("INVOICE", ("legal shield", "legalshield")),
    ("WORK_COMPENSATION", ("acord",)),
    ("INSURANCE_CLAIMS", ("loss run", "lossrun", "claims report", "claim_report", "claim summary", "loss analysis", "loss_run", "lossanalysis")),
    ("INVOICE", (
        "medlink", "medsupp", "cobra", "group benefit", "beneficiary", "uhc", "unitedhealthcare", "bcbs", "bluecross", "blue cross", "blueshield", "anthem", "humana", "aetna", "cigna", "angle",
        "angle health", "principal", "guardian", "metlife", "wellmark",
    )),
    ("BANK_STATEMENT", (
        "chase.com", "chase bank", "bank of america", "wells fargo", "citibank", "capital one", "pnc bank", "td bank", "us bank", "usbank", "regions bank", "truist", "fifth third", "key bank", "keybank",
        "huntington bank", "bank statement", "bankstatement", "checking statement", "savings statement", "operating account",
    )),
    ("VENDOR_INVOICE", ("internet bill", "subscription invoice", "utility bill", "phone bill", "electricity bill", "water bill", "tax invoice")),
)
PREMIUM_SIGNS = (
    "medlink", "group med sup", "group medical supplement", "amount billed", "premium period", "medsupp", "cobra", "benefit billing", "enrollment bill", "american public life", "apl", "member premium",
    "subscriber premium", "unitedhealthcare", "uhc", "bluecross", "blueshield", "bcbs", "humana", "aetna", "cigna", "angle", "angle health", "legal shield", "legalshield", "policy no.", "subscriber id",
    "member id", "benefit invoice", "premium statement", "billing summary", "billing statement", "premium amount", "hmo blue", "hmo", "blue cross", "blue shield", "hmo blue ne", "hmo blue ne saver",
    "group number", "invoice number", "billing period", "account number", "current rates", "current premium", "due date",
)
STRONG_PREMIUM_SIGNS = ("hmo blue", "hmo blue ne", "unitedhealthcare", "uhc", "bcbs", "blue cross", "blue shield", "medlink", "medsupp", "cobra", "subscriber premium", "member premium", "benefit billing")
LOSS_SIGNS = ("loss run", "wc loss run", "policy summary", "med only", "lost time", "claimant", "adjustor", "date of loss", "incurred", "outstanding", "paid losses", "reserve", "claim number", "claim status")
ACORD_SIGNS = ("workers compensation application", "acord 130", "acord 133", "rating by state", "class code", "total estimated annual premium", "employers liability", "payroll", "experience modification")
BANK_SIGNS = {
    "account summary": 3, "beginning balance": 3, "ending balance": 3, "routing number": 3, "deposits and other credits": 3, "checks and other debits": 3, "daily balance summary": 3, "statement period": 3,
    "transaction date": 1, "withdrawal": 1, "deposit": 1, "checking account": 1, "savings account": 1, "overdraft": 1, "item description": 1, "account number": 1,
}
VENDOR_SIGNS = (
    "tax invoice", "gstin", "gst number", "cgst", "sgst", "irn:", "hsn code", "sac:", "zoho", "spectra", "quickbooks", "freshbooks", "stripe", "razorpay", "recurring charges", "amount payable", "due date",
    "date due", "unit price", "unit cost", "qty", "quantity", "description", "subtotal", "bill to", "ship to", "bandwidth", "internet access", "mbps", "software license", "subscription", "balance due",
    "avanquest", "pdfescape", "software",
)
ID_SIGNS = ("passport", "driver's license", "driver license", "date of birth", "expiration date", "ssn", "social security", "state of", "license number", "id number", "identification")
# --- end of fixed values ---


def document_type(name: Column, text: Column) -> Column:
    """The document's type by its name, else by its contents, else null.

    Contents: three signs of an application, four of a loss run, one strong or two weak ones
    of premium billing; then a bank statement by weighted signs, of which more are needed
    where there are insurance signs; then a vendor's invoice; then an identity document."""
    low, found = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))

    def by_content(x: Column) -> Column:
        premium, loss, vendor = x["premium"], x["loss"], x["vendor"]
        return (
            F.when(x["acord"] >= 3, "WORK_COMPENSATION").when(loss >= 4, "INSURANCE_CLAIMS").when((x["strong"] > 0) | (premium >= 2), "INVOICE")
            .when(x["bank"] >= F.when((premium > 0) | (loss > 0), 10).otherwise(5), "BANK_STATEMENT").when(vendor >= F.when(premium > 0, 5).otherwise(3), "VENDOR_INVOICE").when(x["id"] >= 3, "IDENTIFICATION")
        )

    bank = sum((F.when(found.contains(k), w).otherwise(0) for k, w in BANK_SIGNS.items()), F.lit(0))
    hits = F.struct(
        word_hits(found, ACORD_SIGNS).alias("acord"), word_hits(found, LOSS_SIGNS).alias("loss"), word_hits(found, STRONG_PREMIUM_SIGNS).alias("strong"), word_hits(found, PREMIUM_SIGNS).alias("premium"),
        bank.alias("bank"), word_hits(found, VENDOR_SIGNS).alias("vendor"), word_hits(found, ID_SIGNS).alias("id"),
    )
    out = once(hits, by_content)
    for kind, words in reversed(NAME_RULES):
        out = F.when(word_hits(low, words) > 0, kind).otherwise(out)
    return out


def canonical_type(label: Column) -> Column:
    """A type as a model words it, to the type's name; null if it is none."""
    r = F.upper(F.trim(label))
    return (
        F.when(r.contains("INSURANCE_CLAIMS") | (r == "INSURANCE"), "INSURANCE_CLAIMS").when(r.contains("WORK_COMPENSATION"), "WORK_COMPENSATION").when(r.contains("IDENTIFICATION"), "IDENTIFICATION")
        .when(r.contains("BANK_STATEMENT"), "BANK_STATEMENT").when(r.contains("VENDOR_INVOICE") | r.contains("INVOICE_POC_EXTRACTOR"), "VENDOR_INVOICE").when(r.contains("INVOICE"), "INVOICE")
    )


def form_type(states: Column) -> Column:
    """The application form's name by the states it is for."""
    listed = F.filter(F.split(F.upper(F.regexp_replace(F.coalesce(states, F.lit("")), ",", " ")), r"\s+"), lambda s: s != "")
    has = lambda s: F.array_contains(listed, s)
    return (
        F.when(has("CA"), "California ACORD").when(has("FL"), "Florida ACORD").when(F.size(listed) > 0, F.concat(F.lit("ACORD ("), F.array_join(F.slice(listed, 1, 3), ", "), F.lit(")"))).otherwise("Standard ACORD 130")
    )


def is_single_policy_form(text: Column) -> Column:
    """Applications that list prior policies without being cut by them."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(30000))
    up = F.upper(head)
    return (
        (head.contains("FORM FIELD DATA") & head.contains("P3_GIO_")) | up.contains("ACORD 130") | up.contains("ACORD130") | up.contains("WORKERS COMPENSATION APPLICATION") | up.contains("WORKERS' COMPENSATION APPLICATION")
        | (up.contains("APPLICANT NAME") & up.contains("AGENCY NAME"))
    )
