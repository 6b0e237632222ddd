"""Scalar functions and operators on inline rows: nulls, ties, odd text."""

from pyspark.sql import functions as F

from tallyforge.functions import dates, money, text
from tallyforge.operators import bank, claims, cleaning, invoices, monitoring, setops, workers_comp


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_money(spark):
    rows = ["$1,234.50", "(12.00)", "-", "nan", None, "abc", "12.00-", ".5"]
    assert values(spark, rows, money.sheet_money)[:2] == [1234.5, 0.0]
    assert values(spark, rows, money.signed_money)[:6] == [1234.5, -12.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, rows, money.statement_amount) == [1234.5, -12.0, None, None, None, None, -12.0, 0.5]
    assert values(spark, ["-5.00"], money.claim_amount) == [-5.0]
    assert values(spark, ["-5.00"], lambda c: money.claim_amount(c, keep_sign=False)) == [5.0]


def test_names(spark):
    got = values(spark, ["Smith, John M", "John M Smith", "Cher", "", None], text.name_parts)
    assert [tuple(g) if g else None for g in got] == [("Smith", "John", "M"), ("Smith", "John", "M"), ("Cher", None, None), None, None]
    assert values(spark, ["John M. Smith", "Not provided", "A, B", None], text.last_first) == ["Smith, John M.", None, "A, B", None]
    assert values(spark, ["cl", "REOP", "odd"], text.claim_status) == ["Closed", "Reopened", "ODD"]
    assert values(spark, ["e2d", "ESC", "??"], text.coverage) == ["EC", "FAM", "??"]
    assert values(spark, ["00000123.0", "0012"], text.id_text) == ["123", "0012"]
    assert values(spark, ["TTD claim", "medical", "other"], text.injury_type) == ["Indemnity", "Medical Only", "other"]


def test_dates(spark):
    assert values(spark, ["03/06/2026", "25/12/2025", "February 19, 2026", "202603", "03/2026", "n/a", None], dates.us_date) == ["3/6/2026", "12/25/2025", "2/19/2026", "3/1/2026", "3/1/2026", "n/a", None]
    assert values(spark, ["2021-05-06", "on 5 May 1999", "x"], dates.claim_year) == [2021, 1999, None]
    assert values(spark, ["1/2", "13/40"], lambda c: dates.month_day_gap(c, F.lit("01/03"))) == [1, 999]


def test_round_half_even_and_category_before_rounding(spark):
    df = spark.createDataFrame([(39.5,), (62.5,)], "raw double")
    assert [tuple(r) for r in df.select(F.bround("raw").cast("long"), claims.category(F.col("raw"))).collect()] == [(40, "Critical"), (62, "Moderate")]


def test_groups_drop_null_keys_and_take_the_least_mode(spark):
    rows = [("a", "x", "c1", 10), ("a", "y", "c1", 10), (None, "x", "c1", 10)]
    df = spark.createDataFrame(rows, "client string, state string, class_code string, incurred int").selectExpr("*", "incurred AS reserve", "false AS litigated")
    got = claims.client_risk(df).collect()
    assert len(got) == 1 and got[0]["claim_count"] == 2


def test_best_version_takes_date_and_fills_details(spark):
    rows = [(1, 1, 1, None, None), (1, 2, 0, "2020", "burn"), (2, 1, 0, "2019", None)]
    df = spark.createDataFrame(rows, "k int, o int, score int, day string, detail string")
    got = {r["k"]: r for r in cleaning.best_version(df, "k", ["o"], "score", "day", ["detail"]).collect()}
    assert (got[1]["day"], got[1]["detail"], got[1]["best_score"], got[1]["copies"]) == ("2020", "burn", 1, 2)
    assert got[2]["detail"] is None


def test_duplicates_fold(spark):
    rows = [(1, "01/01", "ACME", 5), (2, "01/02", "ACME LTD", 5), (3, "01/09", "ACME", 5), (4, "01/02", "acme", 5)]
    df = spark.createDataFrame(rows, "id int, date string, description string, amount int")
    assert sorted(r["id"] for r in bank.drop_duplicates(df, ["amount"], "id").collect()) == [2, 3]


def test_balance_audit_against_a_loop(spark):
    import random

    rng = random.Random(2)
    for _ in range(3):
        rows, state, want = [], 100.0, []
        for i in range(25):
            amount = rng.randrange(1, 50)
            printed = rng.choice([None, None, state + amount, state + 7])
            want.append(state)
            state = printed if printed is not None else state + amount
            rows.append((1, i, float(amount), "deposit", printed))
        df = spark.createDataFrame(rows, "p int, i int, amount double, description string, running_balance double")
        got = bank.audit_balance(df, "p", ["i"], F.lit(100.0)).orderBy("i").collect()
        assert [r["prior"] for r in got] == want


def test_orphans(spark):
    rows = [(1, 0, "MISSING", "P", 1.0), (1, 1, "Ann", "P", 1.0), (1, 2, "MISSING", "Q", 1.0), (1, 3, "MISSING", "P", 1.0), (1, 4, "MISSING", "R", None), (1, 60, "MISSING", "S", 1.0)]
    df = spark.createDataFrame(rows, "f int, i int, person string, plan string, premium double")
    got = invoices.repair_orphans(df, "f", ["i"], "person", F.col("plan"), ["premium"], "i", "MISSING").orderBy("i").collect()
    assert [(r["i"], r["person"], r["repaired"]) for r in got] == [(1, "Ann", False), (2, "Ann", True)]


def test_merge_keeps_totals_and_sums(spark):
    rows = [("Ann", "Lee", "7", "A", 1.0, 1), ("Lee", "Ann", "7", "A", 2.0, 2), ("TOTAL", "", None, "A", 3.0, 3)]
    df = spark.createDataFrame(rows, "first string, last string, id string, plan string, amount double, o int")
    got = invoices.merge_rows(df, "first", "last", ["id"], F.col("plan"), [], ["amount"], ["id"], ["o"]).collect()
    assert sorted((r["first"], r["amount"], r["merged_rows"]) for r in got) == [("Ann", 3.0, 2), ("TOTAL", 3.0, 1)]


def test_rating_and_stitch(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", 5.0, 2), ("a", 5.0, 3), ("b", 0.0, 4), ("b", None, 5)], "k string, pay double, i int")
    assert sorted(r["i"] for r in workers_comp.dedupe_rating(df, ["k"], "pay", ["i"]).collect()) == [2, 4]
    df = spark.createDataFrame([(1, 1, "c1", None), (1, 2, None, 9.0), (1, 3, "c2", 4.0)], "d int, i int, code string, amount double")
    assert [(r["i"], r["amount"]) for r in workers_comp.stitch(df, "d", "i", "code", "amount").orderBy("i").collect()] == [(1, 9.0), (3, 4.0)]


def test_json_merge_and_diff(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b": 3}'), (None, '{"c": 4}')], "o string, n string")
    assert [r[0] for r in df.select(monitoring.json_merge(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}]
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, "y")], "k int, v string")
    assert sorted((r["k"], r["kind"]) for r in setops.record_diff(a, b, ["k"], ["v"]).collect()) == [(1, "removed"), (2, "added")]
    assert tuple(setops.same_rows(a, a.union(a)).first()) == (True, False)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "client string, state string, class_code string, status string, claim_number long, incurred decimal(18,2), paid decimal(18,2), reserve decimal(18,2), litigated boolean, loss_date date, year int, carrier string, cause string")
    assert claims.executive_summary(none).first()["total_claims"] == 0
    assert claims.client_risk(none).count() == claims.open_aging(none).count() == claims.by_year(none).count() == 0
    assert claims.portfolio_score(claims.client_risk(none)).first()["portfolio_score"] == 0


def test_classification_verdicts(spark):
    from tallyforge.operators import text_checks

    good = "POST TRANS TRANSACTION REFERENCE AMOUNT\n2/01 2/01 BOOKSHOP 2480394 44.48\n2/02 2/03 GROCER LLC 734 180.00\n"
    cut = "POST TRANS TRANSACTION REFERENCE AMOUNT\n2/01 2/01 BOOKSHOP 2480394\n2/02 2/03 GROCER LLC 734\n"
    df = spark.createDataFrame([(good,), (cut,), (None,), ("Amount\n2/01 x\n",)], "t string")
    assert [r["m"] for r in df.select(text_checks.amounts_missing(F.col("t")).alias("m")).collect()] == [False, True, False, False]


def test_quality_of_readable_and_damaged_text(spark):
    from tallyforge.operators import text_checks as t

    fine = "The insured reported a claim under the policy; the total amount paid and the reserve are dated below. " * 5
    bad = "(cid:12)(cid:7)|||=== " * 40
    df = spark.createDataFrame([(fine,), (bad,), ("",), (None,)], "t string").withColumn("m", t.measured(F.col("t"), F.lit(1)))
    got = df.select(t.reasons(F.col("m")).alias("r"), t.score(F.col("t"), F.col("m")).alias("s"), t.recommendation(F.col("t"), F.col("m")).alias("a")).collect()
    assert got[0]["r"] == [] and got[0]["a"] == "ok" and got[0]["s"] == 1.0
    assert {"cids", "noise", "words"} <= set(got[1]["r"]) and got[1]["a"] == "full_vision"
    assert got[2]["a"] == got[3]["a"] == "full_vision" and got[2]["s"] == got[3]["s"] == 0.0


def test_empty_tables_of_the_new_operators(spark):
    from tallyforge.operators import invoice_lines, invoices, statements

    none = spark.createDataFrame([], "doc long, pos long, line string, page int")
    for f in (invoice_lines.location_rows, invoice_lines.turned_rows, invoice_lines.grid_rows, invoice_lines.detail_rows, invoice_lines.with_identity):
        assert f(none).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "no section")], "doc long, text string")
    assert statements.deposits(texts, "doc", "text").count() == 0 and statements.debits(texts, "doc", "text").count() == 0
    rows = spark.createDataFrame([], "doc long, n long, plan string, current decimal(18,2), adjustment decimal(18,2)")
    assert invoices.three_totals(rows, "plan", "current", "adjustment").count() == 3


def test_pages_are_turned_with_words_broken_or_not(spark):
    from tallyforge.operators import text_checks as t

    rows = [("a\n[[PAGE_1]]eciovni\nan.am-uh x[[PAGE_22]]upright\ntext--- PAGE", "a\n[[PAGE_1]]inv\n"), ("[[PAGE_3]]abc", None), ("", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, x string").select(t.pages_turned_back(F.col("t"))).collect()]
    assert got == ["a\n[[PAGE_1]]invoice\nx hu-ma.na[[PAGE_22]]upright\ntext--- PAGE", "[[PAGE_3]]abc", "", None]


def test_passes_over_a_text_do_not_repeat(spark):
    """Each pattern stands in the plan a bounded number of times: it was there for every word or use."""
    from tallyforge.operators import documents as d, text_checks as t

    df = spark.createDataFrame([("x",)], "t string")
    times = lambda c, sign: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count(sign)
    assert times(t.pages_turned_back(F.col("t")), "[^a-zA-Z0-9]+") == 1
    assert times(d.quality_reasons(d.quality(F.col("t"))), "[\\s$.,/\\-:]+") == 1
    assert times(t.measured(F.col("t"), F.lit(1)), "[\\s$.,/\\-:]+") == 1


def test_cascade_reads_its_rows_once(spark):
    from tallyforge.operators import lines

    left = spark.createDataFrame([(1, "a", "x"), (2, "", "x"), (3, None, "y"), (4, "zz", None), (4, "a", ""), (5, "b", "y")], "k int, p string, q string")
    right = spark.createDataFrame([(9, "a", "x"), (7, "a", "y"), (8, "", "x"), (3, None, "y")], "id int, p string, q string")
    out = lines.cascade_match(left, right, "k", [(c, F.col(c), F.col(c)) for c in "pq"])
    assert sorted(map(tuple, out.collect())) == [(1, 7, "p"), (2, 8, "q"), (3, 3, "q"), (4, 7, "p"), (5, 3, "q")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_statements_are_printed_once(spark):
    from tallyforge.plans import catalog

    plan = catalog.QUERIES["statement_debits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" not in plan
