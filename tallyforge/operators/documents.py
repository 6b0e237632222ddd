"""Text quality, noise, classes, and the order and extent of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once


def alnum_ratio(text: Column) -> Column:
    """Letters and digits among all characters, 0 for empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^a-zA-Z0-9]+", "")) / n).otherwise(F.lit(0.0))


def char_counts(text: Column, blanks: str) -> Column:
    """(cids, dense, alnum, alpha, vowels, lines, noisy) of a text: glyph codes; characters but
    white space and the signs of amounts and dates; letters and digits, letters, vowels; lines of
    five characters or more, and those of them with few letters or a rule.  The text is read
    for its other signs once, line by line, and these are few."""

    def of_line(x: Column) -> Column:
        return F.struct(F.btrim(x, F.lit(blanks)).alias("x"), F.regexp_replace(x, "[a-zA-Z0-9]+", "").alias("rest"), F.length(x).alias("n"))

    def noisy(r: Column) -> Column:
        ruled = (F.contains(r["rest"], F.lit("|")) | F.contains(r["rest"], F.lit("_"))) & r["x"].rlike(r"[|_]{3,}")
        return ((r["n"] - F.length(r["rest"])) * 2 < F.length(r["x"])) | ruled

    def counted(rows: Column) -> Column:
        long = F.filter(rows, lambda r: F.length(r["x"]) >= 5)
        rest = F.array_join(F.transform(rows, lambda r: r["rest"]), "\n")
        return F.struct(rest.alias("rest"), F.size(long).alias("lines"), F.size(F.filter(long, noisy)).alias("noisy"))

    def of_text(t: Column, c: Column) -> Column:
        gone = F.length(c["rest"]) - F.length(F.regexp_replace(c["rest"], r"[\s$.,/\-:]+", ""))
        n = F.length(t)
        return F.struct(
            F.when(F.contains(t, F.lit("(cid:")), F.regexp_count(t, F.lit(r"\(cid:"))).otherwise(F.lit(0)).alias("cids"), (n - gone).alias("dense"), (n - F.length(c["rest"])).alias("alnum"),
            (F.length(F.regexp_replace(t, "[0-9]+", "")) - F.length(c["rest"])).alias("alpha"), (n - F.length(F.regexp_replace(t, "[aeiouAEIOU]+", ""))).alias("vowels"), c["lines"].alias("lines"), c["noisy"].alias("noisy"),
        )

    return once(text, lambda t: once(once(F.transform(F.split(t, "\n"), of_line), counted), lambda c: of_text(t, c)))


def quality(text: Column) -> Column:
    """Counts and ratios that tell readable text from damaged text, as a struct."""
    return once(char_counts(F.coalesce(text, F.lit("")), " \t\r"), lambda c: F.struct(
        c["cids"].cast("long").alias("cid_count"), F.round(F.when(c["dense"] > 0, 1 - c["alnum"] / c["dense"]).otherwise(F.lit(1.0)), 4).alias("noise_ratio"),
        F.round(c["vowels"] / F.greatest(c["alpha"], F.lit(1)), 4).alias("vowel_ratio"), c["alpha"].cast("long").alias("alpha_count"), F.round(c["noisy"] / F.greatest(c["lines"], F.lit(1)), 4).alias("noisy_line_ratio"),
    ))


def quality_reasons(q: Column) -> Column:
    """The reasons against a text, in order."""
    return once(q, lambda m: F.array_compact(F.array(
        F.when(m["cid_count"] > 5, "cid"), F.when(m["noise_ratio"] > 0.3, "noise"), F.when((m["alpha_count"] > 100) & (m["vowel_ratio"] < 0.22), "vowels"), F.when(m["noisy_line_ratio"] > 0.15, "lines"),
    )))


def is_noise(text: Column) -> Column:
    """Damaged text by any of four signs: font codes, symbols, symbols with few words, and
    runs of one character.  Texts below 50 characters are never noise."""

    def of_text(t: Column) -> Column:
        n = F.length(t)
        signs = F.regexp_replace(t, r"[\x20-\x7E&&[^/\\|@#$%&<>={}\[\]^~`]]+", "")  # symbols, and what is not printable ASCII
        counts = once(signs, lambda x: F.struct(n.alias("n"), F.length(x).alias("both"), (F.length(x) - F.length(F.regexp_replace(x, r"[\x20-\x7E]+", ""))).alias("symbols")))
        codes = F.contains(t, F.lit("(cid:")) & (F.regexp_count(t, F.lit(r"\(cid:")) / F.greatest(n / 8, F.lit(1.0)) > 0.25)
        words = F.regexp_count(t, F.lit("[a-zA-Z]{3,}")) / F.greatest(n / 5, F.lit(1.0))
        runs = F.regexp_count(t, F.lit(r"(.)\1{9,}")) > 3

        def verdict(c: Column) -> Column:
            noise = c["both"] / F.greatest(c["n"], F.lit(1))
            return (noise > 0.15) | (c["symbols"] / F.greatest(c["n"], F.lit(1)) > 0.10) | ((noise > 0.08) & (words < 0.20)) | codes | runs

        return (n >= 50) & once(counts, verdict)

    return once(F.coalesce(text, F.lit("")), of_text)


def keyword_hits(text: Column, words: list[str]) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((t.contains(w).cast("int") for w in words[1:]), t.contains(words[0]).cast("int"))


def classify(name: Column, text: Column, name_rules: list[tuple[str, list[str]]], content_rules: list[tuple[str, list[str], int]]) -> Column:
    """The class of the first rule that fires: names before contents, in order; content
    rules need a number of different keywords."""
    out = F.lit("UNKNOWN")
    for label, words, least in reversed(content_rules):
        out = F.when(keyword_hits(text, words) >= least, label).otherwise(out)
    for label, words in reversed(name_rules):
        out = F.when(keyword_hits(name, words) > 0, label).otherwise(out)
    return out


def ranges(pages: DataFrame, doc: str, page: str, text: str, patterns: list[str]) -> DataFrame:
    """(doc, first_page, last_page) of the parts of a document.  A part begins where header
    patterns occur and none of them did on the page before; a document without such a page
    is one part."""
    w = Window.partitionBy(doc).orderBy(page)
    hits = F.filter(F.array(*[F.when(F.upper(F.coalesce(text, F.lit(""))).contains(p.upper()), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    p = pages.select(doc, page, hits.alias("m")).withColumn("before", F.lag("m").over(w)).withColumn("last", F.max(page).over(Window.partitionBy(doc))).withColumn("zero", F.min(page).over(Window.partitionBy(doc)))
    starts = (F.size("m") > 0) & (F.col("before").isNull() | (F.size("before") == 0) | ~F.arrays_overlap("m", "before"))
    s = p.where(starts).withColumn("next", F.lead(page).over(w)).select(doc, F.col(page).alias("first_page"), F.coalesce(F.col("next") - 1, F.col("last")).alias("last_page"))
    whole = p.where(~starts | starts.isNull()).join(s.select(doc).distinct(), doc, "left_anti").groupBy(doc).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    return s.unionByName(whole)


def tag_sections(pages: DataFrame, doc: str, page: str, marks: list[tuple[str, Column]]) -> DataFrame:
    """Each page with the last section mark at or before it."""
    own = F.coalesce(*[F.when(c, F.lit(label)) for label, c in marks])
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.last(own, ignorenulls=True).over(w))


def page_pairs(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Two-page windows with stride one; a document of one page is one window."""
    w = Window.partitionBy(doc).orderBy(page)
    p = pages.withColumn("next", F.lead(text).over(w)).withColumn("n", F.count("*").over(Window.partitionBy(doc)))
    return p.where(F.col("next").isNotNull() | (F.col("n") == 1)).select(doc, page, F.concat_ws("\n", text, "next").alias("window"))


def overlapping_chunks(docs: DataFrame, doc: str, text: str, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` characters, each with the last ``overlap`` of the one before."""
    n = F.greatest(F.length(text), F.lit(1))
    at = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk")
    c = docs.select(doc, text, at)
    begin = F.greatest(F.col("chunk") * size - overlap, F.lit(0))
    return c.select(doc, "chunk", F.substring(F.col(text), begin + 1, F.col("chunk") * size + size - begin).alias("part"))


def split_pages(docs: DataFrame, doc: str, text: str, marker: str = r"\[\[PAGE_\d+\]\]") -> DataFrame:
    """Text with page markers to rows; what stands before the first marker is dropped if blank."""
    p = docs.select(doc, F.posexplode(F.split(text, marker)).alias("page", "text"))
    return p.where((F.col("page") > 0) | (F.trim("text") != ""))


def clean_lines(text: Column, least_ratio: float = 0.2) -> Column:
    """Lines of two characters or more with enough letters and digits; wide gaps become cell bars."""
    kept = F.filter(F.split(text, "\n"), lambda x: (F.length(F.trim(x)) >= 2) & (F.length(F.regexp_replace(x, "[^a-zA-Z0-9]+", "")) >= F.length(x) * least_ratio))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.trim(x), r"\s{3,}", " | ")), "\n")


def policy_chunks(docs: DataFrame, doc: str, text: str, boundary: str, overlap: int = 0, least: int = 10) -> DataFrame:
    """(doc, chunk, policy, part): text cut where ``boundary`` matches, whose group 1 is the
    policy.  What stands before the first match, if longer than ``least``, is the initial
    section; later chunks begin with the last ``overlap`` characters of the one before; a text
    without a match is one chunk of an unknown policy.  Parts are trimmed."""
    heads, policies = F.regexp_extract_all(text, F.lit(f"({boundary})"), F.lit(1)), F.regexp_extract_all(text, F.lit(boundary), F.lit(1))
    pieces = F.split(F.col(text), boundary)
    d = docs.select(doc, F.col(text).alias("__t"), heads.alias("h"), policies.alias("p"), pieces.alias("s"))
    before = F.aggregate(F.slice("s", F.lit(1), F.col("i") + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("h", F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + F.length(x))
    cut = d.where("size(h) > 0").select(doc, "__t", "h", "p", "s", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("i")).withColumn("begin", before)
    size = F.length(F.get("h", F.col("i"))) + F.length(F.get("s", F.col("i") + 1))
    lead = F.when(F.col("i") > 0, F.least(F.lit(overlap), F.col("begin"))).otherwise(0)
    spaces = F.lit(" \t\r\n\x0b\x0c")
    out = cut.select(doc, (F.col("i") + 1).alias("chunk"), F.get("p", F.col("i")).alias("policy"), F.btrim(F.substring("__t", F.col("begin") - lead + 1, size + lead), spaces).alias("part"))
    first = d.where(f"size(h) > 0 AND length(s[0]) > {least}").select(doc, F.lit(0).alias("chunk"), F.lit("Initial Section").alias("policy"), F.btrim(F.get("s", F.lit(0)), spaces).alias("part")).where("part <> ''")
    whole = d.where("size(h) = 0").select(doc, F.lit(0).alias("chunk"), F.lit("Unknown").alias("policy"), F.col("__t").alias("part"))
    return out.unionByName(first).unionByName(whole)


def split_oversized(chunks: DataFrame, keys: list[str], policy: str, part: str, most: int, page: str = r"(?i)\n={5,}\s*\n\s*PAGE\s+(\d+)\s*\n\s*={5,}") -> DataFrame:
    """Chunks longer than ``most`` cut at page headings, each piece named by the heading it ends
    at, the last by the heading it begins with; without headings they are cut by length."""
    long = F.length(part) > most
    fits = chunks.where(~long).select(*keys, F.lit(0).alias("piece"), policy, part)
    marks, numbers = F.regexp_extract_all(part, F.lit(f"({page})"), F.lit(1)), F.regexp_extract_all(part, F.lit(page), F.lit(1))
    c = chunks.where(long).select(*keys, policy, F.col(part).alias("__t"), marks.alias("h"), numbers.alias("n"), F.split(F.col(part), page).alias("s"))
    spaces = F.lit(" \t\r\n\x0b\x0c")
    paged = c.where("size(h) > 0").select(*keys, policy, "h", "n", F.posexplode("s").alias("piece", "x"))
    text = F.btrim(F.concat(F.coalesce(F.get("h", F.col("piece") - 1), F.lit("")), "x"), spaces)
    label = F.when(F.col("piece") < F.size("h"), F.concat(F.col(policy), F.lit(" (page "), F.get("n", F.col("piece")), F.lit(")"))).otherwise(F.concat(F.col(policy), F.lit(" (page "), F.element_at("n", -1), F.lit("+)")))
    paged = paged.select(*keys, "piece", label.alias(policy), text.alias(part)).where(f"`{part}` <> ''")
    cut = c.where("size(h) = 0").select(*keys, policy, "__t", F.explode(F.sequence(F.lit(0), F.floor((F.length("__t") - 1) / most).cast("int"))).alias("piece"))
    cut = cut.select(*keys, "piece", F.concat(F.col(policy), F.lit(" (part "), (F.col("piece") + 1).cast("string"), F.lit(")")).alias(policy), F.substring(F.col("__t"), F.col("piece") * most + 1, F.lit(most)).alias(part))
    return fits.unionByName(paged).unionByName(cut)


def chunk_report(chunks: DataFrame, doc: str, part: str) -> DataFrame:
    """Per document: chunks, their characters in all, the longest and the shortest."""
    n = F.length(part)
    return chunks.groupBy(doc).agg(F.count("*").alias("num_chunks"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_chars"), F.max(n).alias("longest"), F.min(n).alias("shortest"))


#: Where a mixed page's summary begins, the first that occurs.
SUMMARY_STARTS = ("All Employees Totals:", "Invoice Sub Total", "Invoice Summary", "ADJUSTMENT DETAIL", "Adjustment Totals")


def structural_chunks(pages: DataFrame, doc: str, page: str, text: str, merge: int = 2, most: int = 6000) -> DataFrame:
    """(doc, first_page, type, part): pages with totals are cut into detail and summary at the
    line of the first summary heading, or stay mixed without one; up to ``merge`` detail pages
    in a row are one chunk, and chunks of over ``most`` characters are cut at line ends."""
    t = F.col(text)
    mixed = t.contains("Totals:") | t.contains("Invoice Summary")
    at = F.lit(0)
    for s in reversed(SUMMARY_STARTS):
        here = F.regexp_instr(t, F.lit(r"\n[^\n]*\Q" + s + r"\E"))
        at = F.when(here > 0, here).otherwise(at)
    p = pages.select(doc, page, t.alias("t"), mixed.alias("mixed"), F.when(mixed, at).otherwise(0).alias("at"))
    spaces = F.lit(" \t\r\n\x0b\x0c")
    cut = p.where("mixed AND at > 0").select(doc, page, F.explode(F.array(F.struct(F.lit("detail").alias("type"), F.btrim(F.substring("t", F.lit(1), F.col("at") - 1), spaces).alias("part")), F.struct(F.lit("summary").alias("type"), F.btrim(F.substring("t", F.col("at"), F.length("t")), spaces).alias("part")))).alias("x"))
    cut = cut.select(doc, F.col(page).alias("first_page"), "x.type", "x.part", F.lit(0).alias("piece")).where("part <> ''")
    whole = p.where("mixed AND at = 0").select(doc, F.col(page).alias("first_page"), F.lit("mixed").alias("type"), F.col("t").alias("part"), F.lit(0).alias("piece"))
    w = Window.partitionBy(doc).orderBy(page)
    detail = p.withColumn("block", F.count_if("mixed").over(w)).where("NOT mixed")
    detail = detail.withColumn("k", F.floor((F.row_number().over(Window.partitionBy(doc, "block").orderBy(page)) - 1) / merge))
    joined = detail.groupBy(doc, "block", "k").agg(F.min(page).alias("first_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    # a piece is closed by the line that takes it over the limit
    fold = F.aggregate(
        F.split("t", "\n"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("of")),
        lambda a, x: F.struct(F.when(a["n"] + F.length(x) + 1 > most, 0).otherwise(a["n"] + F.length(x) + 1).alias("n"), F.when(a["n"] + F.length(x) + 1 > most, a["piece"] + 1).otherwise(a["piece"]).alias("piece"), F.array_append(a["of"], a["piece"]).alias("of")),
    )["of"]
    cutting = joined.withColumn("of", F.when(F.length("t") > most, fold))
    long = cutting.where("of IS NOT NULL").select(doc, "first_page", F.explode(F.arrays_zip(F.split("t", "\n").alias("line"), "of", F.sequence(F.lit(1), F.size("of")).alias("i"))).alias("x"))
    long = long.groupBy(doc, "first_page", F.col("x.of").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.i", "x.line"))), lambda x: x["line"]), "\n").alias("part"))
    short = cutting.where("of IS NULL").select(doc, "first_page", F.lit(0).alias("piece"), F.col("t").alias("part"))
    details = short.unionByName(long).withColumn("type", F.lit("detail"))
    return details.unionByName(cut).unionByName(whole).select(doc, "first_page", "piece", "type", "part")


def text_table(rows: DataFrame, doc: str, order: str, cells: list[str]) -> DataFrame:
    """(doc, table): the rows as text with cells padded to their column's widest, bars between
    them, and a rule under the first row."""
    v = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells}
    r = rows.select(doc, order, *[x.alias(c) for c, x in v.items()])
    by = Window.partitionBy(doc)
    wide = r.withColumns({f"__{c}": F.max(F.length(c)).over(by) for c in cells})
    line = F.concat_ws(" | ", *[F.rpad(F.col(c), F.col(f"__{c}"), F.lit(" ")) for c in cells])
    rule = F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col(f"__{c}")) for c in cells])
    g = wide.select(doc, order, line.alias("line"), rule.alias("rule")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"), F.first("rule").alias("rule"))
    lines = F.transform("l", lambda x: x["line"])
    return g.select(doc, F.array_join(F.concat(F.slice(lines, 1, 1), F.array("rule"), F.slice(lines, F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))), "\n").alias("table"))
