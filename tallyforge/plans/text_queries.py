"""Queries of text quality, document types, extraction and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, extract
from ..functions.text import once
from ..operators import text_checks as ops
from ..sources import readers
from .catalog import query
from .invoice_queries import pick, sql_pick


def _documents(spark, d):
    return readers.table(spark, d, "documents").select("doc_id", "text")


def _hits(t: str, words) -> str:
    return "(" + " + ".join(f"(contains(lower({t}), '{w.lower().replace(chr(39), chr(39) * 2)}'))::INT" for w in words) + ")"


LETTERS = "length(regexp_replace({t}, '[^{c}]', '', 'g'))"
MEASURES = f"""t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' claim policy date paid (cid:1)(cid:2)' WHEN 1 THEN repeat('|||||=====', 40) WHEN 2 THEN ' xzkrtvbnmq brrrrrrrrrrr sttttttttttt wqrtpsdfgh claim total amount paid mialC etaD' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, t, length(t) - length(replace(t, '(cid:', 'cid:')) AS cids, CASE WHEN length(dense) > 0 THEN 1 - {LETTERS.format(t='t', c='a-zA-Z0-9')} / length(dense) ELSE 1 END AS noise, length(t) // 2 AS cpp, {_hits('t', ops.CLAIM_WORDS)} AS words,
 {LETTERS.format(t='t', c='aeiouAEIOU')} / greatest(letters, 1) AS vowels, letters, len(list_filter(regexp_extract_all(t, '[a-zA-Z]{{9,}}'), lambda w: {LETTERS.format(t='w', c='aeiouAEIOU')} / length(w) < 0.15)) AS nonsense,
 len(list_filter(ls, lambda x: {LETTERS.format(t='x', c='a-zA-Z0-9')} * 2 < length(x) OR regexp_matches(x, '[|_]{{3,}}'))) / greatest(len(ls), 1) AS nl, {_hits('t', ops.TURNED_CLAIM_WORDS)} AS turned
 FROM (SELECT *, regexp_replace(t, '[\\s$.,/\\-:]', '', 'g') AS dense, {LETTERS.format(t='t', c='a-zA-Z')} AS letters, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: length(x) >= 5) AS ls FROM t)),
q AS (SELECT *, list_filter([CASE WHEN cids > 30 THEN 'cids' END, CASE WHEN noise > 0.2 THEN 'noise' END, CASE WHEN cpp < 200 THEN 'sparse' END, CASE WHEN words < 4 THEN 'words' END, CASE WHEN letters > 100 AND vowels < 0.22 THEN 'vowels' END,
 CASE WHEN nonsense > 3 THEN 'nonsense' END, CASE WHEN nl > 0.15 THEN 'lines' END, CASE WHEN turned >= 2 THEN 'turned' END], lambda x: x IS NOT NULL) AS reasons,
 CASE WHEN trim(t) = '' THEN 0 ELSE greatest(0, round(1 - (CASE WHEN cids > 30 THEN 0.4 ELSE 0 END + CASE WHEN round(noise, 3) > 0.2 THEN least(0.3, round(noise, 3)) ELSE 0 END + CASE WHEN round(vowels, 3) < 0.22 THEN 0.2 ELSE 0 END + CASE WHEN round(nl, 3) > 0.15 THEN least(0.2, round(nl, 3)) ELSE 0 END + greatest(0, 4 - words) * 0.05), 3)) END::DOUBLE AS score FROM m)"""


def _spiced(spark, d):
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " claim policy date paid (cid:1)(cid:2)").when(k == 1, "|||||=====" * 40).when(k == 2, " xzkrtvbnmq brrrrrrrrrrr sttttttttttt wqrtpsdfgh claim total amount paid mialC etaD").otherwise("")
    return _documents(spark, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))


@query("SELECT doc_id, cids::INTEGER AS cids, round(noise, 3) AS noise, cpp::INTEGER AS chars_per_page, words::INTEGER AS words, round(vowels, 3) AS vowels, letters::INTEGER AS letters, nonsense::INTEGER AS nonsense, round(nl, 3) AS noisy_lines, turned::INTEGER AS turned, reasons, score, CASE WHEN len(reasons) = 0 AND t <> '' THEN 'ok' WHEN score < 0.4 THEN 'full_vision' ELSE 'dpi_fallback' END AS advice FROM q", MEASURES)
def quality_report(spark, d):
    """All eight measures, the reasons against a text, its score and what to do."""
    m = _spiced(spark, d).select("doc_id", "text", ops.measured(F.col("text"), F.lit(2)).alias("m"))
    m = m.withColumn("shown", ops.shown(F.col("m")))
    return m.select("doc_id", "shown.*", ops.reasons(F.col("m")).alias("reasons"), ops.score(F.col("text"), F.col("m")).alias("score"), ops.recommendation(F.col("text"), F.col("m")).alias("advice"))


@query("SELECT user_id, c > 1 AND bare > 0 AND user_id % 4 <> 0 AS missing FROM (SELECT user_id, count(*) AS c, count(*) FILTER (event_id % 5 = 0 AND user_id % 2 = 0) AS bare FROM events GROUP BY 1)")
def amounts_missing(spark, d):
    """Statements of dated rows, of which every fifth of every second user has lost its amount;
    every fourth user's has no heading."""
    k = F.col("event_id")
    amount = F.when((k % 5 == 0) & (F.col("user_id") % 2 == 0), "").otherwise(F.concat(F.lit("  "), F.format_number((k + 0.25).cast("double"), 2)))
    line = F.concat(F.when(k % 2 == 0, F.date_format("ts", "MM/dd")).otherwise(F.date_format("ts", "MMM d")), F.lit("  Shop No "), F.lit("seven"), amount)
    s = readers.table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    head = F.when(F.col("user_id") % 4 == 0, "POST TRANS DETAILS").otherwise("POST TRANS DETAILS AMOUNT")
    return s.select("user_id", ops.amounts_missing(F.concat(F.lit("\n"), head, F.lit("\n\n"), "rows")).alias("missing"))


PAGES = ["Beginning Balance\n" + "deposit of the month and the account statement with balance and date " * 5, "Amount " + "account statement balance date amount transaction deposit " * 6, "\n".join(f"{i}.5" for i in range(30)), "(cid:7)" * 20 + " words of a page without any marks at all", "a page of plain prose that is long enough. " * 8, "Date 1"]


@query("SELECT c_custkey, k IN (1, 2, 3, 5) AS needs_patch, k IN (2, 3) AS forced FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)")
def page_health(spark, d):
    k = F.col("c_custkey")
    c = readers.table(spark, d, "customer").select("c_custkey", ops.page_health(pick(PAGES, k)).alias("h"))
    return c.select("c_custkey", F.col("h.needs_patch").alias("needs_patch"), F.col("h.force").alias("forced"))


@query("""SELECT doc_id, n < 100 OR an < n * 0.3 OR sl > n * 0.05 OR cid * 7 > n * 0.1 AS unreadable FROM (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^a-zA-Z0-9]', '', 'g')) AS an, len(regexp_extract_all(t, '/[0-9]')) AS sl, len(regexp_extract_all(t, '[(]cid:')) AS cid
 FROM (SELECT doc_id, trim(coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN repeat('/114 ', 40) WHEN 1 THEN repeat('(cid:9)', 10) ELSE '' END, ' ') AS t FROM documents))""")
def unreadable_pages(spark, d):
    more = F.when(F.col("doc_id") % 3 == 0, "/114 " * 40).when(F.col("doc_id") % 3 == 1, "(cid:9)" * 10).otherwise("")
    return _documents(spark, d).select("doc_id", ops.unreadable_page(F.concat(F.coalesce("text", F.lit("")), more)).alias("unreadable"))


@query("SELECT doc_id, text || ' end' AS text FROM documents")
def watermarks(spark, d):
    marked = F.concat("text", F.lit(" C.o(n)fidential?endc.O(N)FIDENTIAL?"))
    return _documents(spark, d).select("doc_id", ops.without_watermarks(marked, ["c.o(n)fidential?", "  "]).alias("text"))


@query("SELECT c_custkey, '| ' || c_name || ' | ' || c_mktsegment || ' | x |' || chr(10) || 'a  b   c' || chr(10) || '| 1 |     | ' || c_name || ' | 4 | 5 | 6 |' AS text FROM customer")
def table_lines(spark, d):
    spaced = ops.as_table_lines(F.concat("c_name", F.lit("    "), "c_mktsegment", F.lit("   x\na  b   c")))
    tabs = ops.tabs_as_cells(F.concat(F.lit("1\t\t"), "c_name", F.lit("\t4\t5\t6")))
    return readers.table(spark, d, "customer").select("c_custkey", F.concat(spaced, F.lit("\n"), tabs).alias("text"))


@query("""SELECT doc_id, 'p' || chr(10) || '[[PAGE_1]]' || t AS text, length(rt) >= 50 AS turned FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(text, '') || ' Claim Report' AS rt FROM documents)""")
def mirrored_pages(spark, d):
    """Pages printed backwards, with words that tell so, and read back."""
    def read(back):
        page = ops.pages_turned_back(F.concat(F.lit("p\n[[PAGE_1]]"), back, F.lit("\neciovni anamuh")))
        return F.struct(once(page, lambda p: F.left(p, F.length(p) - len("\nhumana invoice"))).alias("text"), ops.is_turned(F.concat(back, F.lit(" mialC tropeR"))).alias("turned"))

    return _documents(spark, d).select("doc_id", once(ops.turned_back(F.coalesce("text", F.lit(""))), read).alias("r")).select("doc_id", "r.text", "r.turned")


ALL_SIGNS = list(dict.fromkeys([*ops.ACORD_SIGNS, *ops.LOSS_SIGNS, *ops.PREMIUM_SIGNS, *ops.BANK_SIGNS, *ops.VENDOR_SIGNS, *ops.ID_SIGNS]))
FILES = ["scan_0017.pdf", "Legal Shield June.pdf", "ACORD form.pdf", "loss_run 2024.pdf", "Humana.pdf", "Chase Bank march.pdf", "water bill.pdf", "", None, "statement.pdf", "x.pdf", "file.pdf", "y.pdf", "z.pdf", "acordion cobra.pdf"]
SIGNS = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in ALL_SIGNS) + "]"
BANK = "(" + " + ".join(f"(contains(t, '{k}'))::INT * {w}" for k, w in ops.BANK_SIGNS.items()) + ")"


def _name_case() -> str:
    return " ".join(f"WHEN {_hits('nm', words)} > 0 THEN '{kind}'" for kind, words in ops.NAME_RULES)


@query(f"""SELECT event_id, CASE {_name_case()} WHEN {_hits('t', ops.ACORD_SIGNS)} >= 3 THEN 'WORK_COMPENSATION' WHEN {_hits('t', ops.LOSS_SIGNS)} >= 4 THEN 'INSURANCE_CLAIMS' WHEN {_hits('t', ops.STRONG_PREMIUM_SIGNS)} > 0 OR {_hits('t', ops.PREMIUM_SIGNS)} >= 2 THEN 'INVOICE'
 WHEN {BANK} >= CASE WHEN {_hits('t', ops.PREMIUM_SIGNS)} > 0 OR {_hits('t', ops.LOSS_SIGNS)} > 0 THEN 10 ELSE 5 END THEN 'BANK_STATEMENT'
 WHEN {_hits('t', ops.VENDOR_SIGNS)} >= CASE WHEN {_hits('t', ops.PREMIUM_SIGNS)} > 0 THEN 5 ELSE 3 END THEN 'VENDOR_INVOICE' WHEN {_hits('t', ops.ID_SIGNS)} >= 3 THEN 'IDENTIFICATION' END AS kind
 FROM (SELECT event_id, coalesce({sql_pick(FILES, 'event_id')}, '') AS nm, lower(array_to_string(list_filter(list_transform(range(0, {len(ALL_SIGNS)}), lambda i: CASE WHEN (event_id * 7 + i * 31) % (9 + event_id % 23) = 0 THEN {SIGNS}[i + 1] END), lambda x: x IS NOT NULL), ' ; ')) AS t FROM events)""")
def document_types(spark, d):
    """Documents with signs of many types in their text, and names that tell some."""
    k = F.col("event_id")
    signs = F.transform(F.array(*[F.lit(s) for s in ALL_SIGNS]), lambda s, i: F.when((k * 7 + i * 31) % (9 + k % 23) == 0, s))
    e = readers.table(spark, d, "events").select("event_id", pick(FILES, k).alias("name"), F.array_join(F.array_compact(signs), " ; ").alias("text"))
    return e.select("event_id", ops.document_type(F.col("name"), F.col("text")).alias("kind"))


LABELS = {"insurance_claims ": "INSURANCE_CLAIMS", "Insurance": "INSURANCE_CLAIMS", "type: WORK_COMPENSATION.": "WORK_COMPENSATION", "identification": "IDENTIFICATION", "Bank_Statement": "BANK_STATEMENT", "vendor_invoice": "VENDOR_INVOICE", "invoice_poc_extractor": "VENDOR_INVOICE", "benefit_invoice": "INVOICE", "insurance form": None, "": None}
STATES = {"ca, fl": "California ACORD", "NY FL": "Florida ACORD", "tx,ny, oh,ga": "ACORD (TX, NY, OH)", "": "Standard ACORD 130", None: "Standard ACORD 130"}
FORMS = {"see Acord 130 form": True, "FORM FIELD DATA P3_GIO_Q1": True, "form field data P3_GIO_Q1": False, "Applicant name / agency NAME": True, "policy 17": False}


@query(f"SELECT c_custkey, {sql_pick(list(LABELS.values()), 'c_custkey')} AS kind, {sql_pick(list(STATES.values()), 'c_custkey')} AS form, [true, true, false, true, false][c_custkey % 5 + 1] AS single FROM customer")
def label_rules(spark, d):
    k = F.col("c_custkey")
    return readers.table(spark, d, "customer").select("c_custkey", ops.canonical_type(pick(list(LABELS), k)).alias("kind"), ops.form_type(pick(list(STATES), k)).alias("form"), ops.is_single_policy_form(pick(list(FORMS), k)).alias("single"))


CARRIERS = {
    "Report\nCarrier: Stone Trust Commercial\n": "Stone Trust Commercial", "State Compensation Insurance Fund\nand ABC Insurance\n": "State Compensation Insurance Fund", "Claimant Jones Indemnity\nwww.fcbi-fund.com/x": "FCBI FUND",
    "see https://www.berkley.com,\n": "Berkley", "nothing here": None, "www.mirrorsite.com": None, "this Acme Casualty Company of old": "this Acme Casualty Company",
}


@query(f"SELECT c_custkey, {sql_pick(list(CARRIERS.values()), 'c_custkey')} AS carrier, [CAST(c_custkey AS VARCHAR)] AS claims, (1000 + c_custkey)::DOUBLE AS annual, [c_custkey + 1.5, 7.25]::DOUBLE[] AS due, [c_custkey + 0.5, 134.38]::DOUBLE[] AS other FROM customer")
def extracted_facts(spark, d):
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    totals = extract.stated_totals(text("Amount Due ", (k + 1).cast("string"), ".50\nBalance due: 7.25\nGrand Total $", k.cast("string"), ".50\n83.431$ latot\nLATOT 83.431$"))
    return readers.table(spark, d, "customer").select(
        "c_custkey", extract.carrier(pick(list(CARRIERS), k), ["mirrorsite"]).alias("carrier"), extract.claim_numbers(text("claim# ", k.cast("string"), " and Claim ", k.cast("string"), " claims")).alias("claims"),
        extract.estimated_annual(text("Estimated  annual $ ", F.format_number(k + 1000, 0), " or so")).cast("double").alias("annual"), totals["due"].alias("due"), totals["other"].alias("other"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS q1, CASE WHEN c_custkey % 3 = 0 THEN 'N' END AS q12, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS answers FROM customer")
def form_answers(spark, d):
    k = F.col("c_custkey")
    a = extract.form_answers(F.concat(F.lit("P3_GIO_Q1: "), F.when(k % 2 == 0, "yes").otherwise("n"), F.when(k % 3 == 0, "\nP3_GIO_Q12:No").otherwise("\nP3_GIO_Q12: maybe")))
    return readers.table(spark, d, "customer").select("c_custkey", F.try_element_at(a, F.lit("q1")).alias("q1"), F.try_element_at(a, F.lit("q12")).alias("q12"), F.size(a).alias("answers"))


PERIODS = {
    "02/01/26-02/28/26": "02/01/26", "March 1 to March 31": "March 1", "1/1/2026 THRU 1/31/2026": "1/1/2026", "2026-01-01-2026-01-31": "2026-01-01", "2026-01-01": "2026-01-01", "Jan 1 - Jan 31": "Jan 1", "n/a": "n/a",
    "01.02.2026–28.02.2026": "01.02.2026", "2026-01-01 – 2026-01-31": "2026-01-01", "12/01 - 12/31/2025": "12/01/2025", "04/01-04/30/2026": "04/01/2026", "2-1 to 2-28-2026": "2/1/2026", "Jan 1 to Jan 31, 2025": "Jan 1", None: None,
}
BOTH = {"1/2/2026 - 1/31/2026": "1/2/2026 - 1/31/2026", "2026-01-05": "1/5/2026", "Jan 5, 2026": "1/5/2026", "next week": "next week", "01/05/2026-02/07/2026": "1/5/2026 - 2/7/2026", "12/01 - 12/31/2025": "12/1/2025 - 12/31/2025"}
STAMPS = {"2026-01-05 10:30:00": 10, "2026-01-05T10:30:00Z": 10, "2026-01-05T10:30:00+02:00": 8, "soon": None, "2026-01-05 10:30:00.5": 10}


@query(f"SELECT c_custkey, {sql_pick(list(PERIODS.values()), 'c_custkey')} AS period, {sql_pick(list(BOTH.values()), 'c_custkey')} AS both_ends, [10, 10, 8, NULL, 10][c_custkey % 5 + 1] AS hour FROM customer")
def period_dates(spark, d):
    k = F.col("c_custkey")
    return readers.table(spark, d, "customer").select("c_custkey", extract.period_start(pick(list(PERIODS), k)).alias("period"), extract.both_ends(pick(list(BOTH), k), dates.loose_date).alias("both_ends"), F.hour(extract.timestamp(pick(list(STAMPS), k))).alias("hour"))


@query("SELECT o_orderkey, 'N' || CAST(o_orderkey AS VARCHAR) AS \"INV_NUMBER\", CASE WHEN o_orderkey % 2 = 0 THEN '01/02/2026' END AS \"INV_DATE\", 'May' AS \"BILLING_PERIOD\" FROM orders")
def cell_facts(spark, d):
    k = F.col("o_orderkey")
    cells = F.array(F.lit("Invoice Number"), F.concat(F.lit("N"), k.cast("string")), F.lit(None), F.lit(" "), F.when(k % 2 == 0, "Bill-Date").otherwise("Note"), F.lit("01/02/2026"), F.lit("coverage period"), F.lit("May"))
    return readers.table(spark, d, "orders").select("o_orderkey", extract.cell_facts(cells).alias("f")).select("o_orderkey", "f.*")
