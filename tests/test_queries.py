"""Every query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from tallyforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    if name not in catalog.SQL:
        assert got
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def test_header_gaps_against_brute_force(spark, duck):
    want = []
    for doc, text in duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        last = None
        for at, _ in enumerate(text.split("\n")):
            if last is None or at - last > 5:
                want.append((doc, at))
                last = at
    assert sorted((r["doc_id"], r["pos"]) for r in catalog.QUERIES["header_gaps"](spark, FOLDER).collect()) == sorted(want)


def test_duplicate_transactions_against_brute_force(spark, duck):
    import datetime
    import re
    from collections import defaultdict

    def day(t):
        return datetime.date(2000, *map(int, t.split("/")))

    def near(a, b):
        gap = abs((day(a) - day(b)).days)
        return (abs(gap - 365) if gap > 300 else gap) <= 1

    rows = duck.sql("""SELECT CAST(round(CAST(value AS DECIMAL(18,2)), 0) AS INTEGER), event_id, strftime(ts, '%m/%d'), CASE event_type WHEN 'purchase' THEN 'Card purchase' WHEN 'error' THEN 'Check payment' ELSE 'Deposit ' || event_type END FROM events ORDER BY event_id""").fetchall()
    kept = defaultdict(list)
    for amount, event, date, text in rows:
        have, text = kept[amount], re.sub(r"\s+", " ", text.upper()).strip()
        if any(near(date, d) and text in t for _, d, t in have):
            continue
        kept[amount] = [(e, d, t) for e, d, t in have if not (near(date, d) and t in text)] + [(event, date, text)]
    assert sorted(r["event_id"] for r in catalog.QUERIES["fuzzy_tx_dedupe"](spark, FOLDER).collect()) == sorted(e for v in kept.values() for e, _, _ in v)


def test_duplicates_across_the_new_year_and_longer_texts(spark):
    from tallyforge.operators import bank

    rows = [(1, 5, "12/31", "RENT"), (2, 5, "01/01", "rent  january"), (3, 5, "01/03", "RENT"), (4, 5, "06/01", "x"), (5, 5, "06/02", "x"), (6, 5, None, "x"), (7, 5, None, "x"), (8, 6, "06/01", "x")]
    got = bank.drop_duplicates(spark.createDataFrame(rows, "id int, amount int, date string, description string"), ["amount"], "id")
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4, 6, 8]


def test_text_noise_against_brute_force(spark, duck):
    import re

    def noise(t):
        n, count = len(t), lambda p: len(re.findall(p, t))
        symbols, odd = count(r"[/\\|@#$%&<>={}\[\]^~`]"), count(r"[^\x20-\x7E]")
        share = (symbols + odd) / max(n, 1)
        words = count("[a-zA-Z]{3,}") / max(n / 5, 1)
        return n >= 50 and (count(r"\(cid:") / max(n / 8, 1) > 0.25 or share > 0.15 or symbols / max(n, 1) > 0.10 or (share > 0.08 and words < 0.20) or sum(1 for _ in re.finditer(r"(.)\1{9,}", t)) > 3)

    want = {d: noise(t or "") for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r["doc_id"]: r["is_noise"] for r in catalog.QUERIES["text_noise"](spark, FOLDER).collect()} == want


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
