"""Scans, versions, gaps and duplicates with hot parts, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import bank, cleaning, invoices, lines, scan


def hot_rows(seed=1, n=900):
    """(part, at, id, value, anchor): one part holds two thirds of all rows; ties in ``at``."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), rng.randint(0, 400), i, rng.choice([None, rng.randint(-50, 50)]), rng.choice([None, None, None, None, rng.randint(0, 999)])) for i in range(n)]


SCHEMA = "part string, at int, id int, value int, anchor int"


@pytest.mark.parametrize("crowded", [10, 10**6])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_the_loop(spark, crowded, inclusive):
    rows = hot_rows()
    wanted = {"last": ("last", F.col("anchor")), "most": ("max", F.col("value")), "total": ("sum", F.col("value")), "n": ("count", F.col("value"))}
    got = scan.running(spark.createDataFrame(rows, SCHEMA).repartition(5), "part", ["at", "id"], wanted, inclusive, crowded, 16).collect()
    state, want = {}, {}
    for part, at, i, value, anchor in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(part, [None, None, None, 0])
        before = tuple(s)
        if anchor is not None:
            s[0] = anchor
        if value is not None:
            s[1], s[2], s[3] = max(value, s[1]) if s[1] is not None else value, (s[2] or 0) + value, s[3] + 1
        want[i] = tuple(s) if inclusive else before
    assert {r["id"]: (r["last"], r["most"], r["total"], r["n"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("crowded", [10, 10**6])
def test_since_anchor_equals_the_loop(spark, crowded):
    rows = hot_rows(2)
    df = spark.createDataFrame(rows, SCHEMA.replace("anchor", "printed")).repartition(5)
    got = scan.since_anchor(df, "part", ["at", "id"], F.col("printed"), F.col("value"), crowded, 16).collect()
    state, want = {}, {}
    for part, at, i, value, anchor in sorted(rows, key=lambda r: (r[1], r[2])):
        a, s = state.get(part, (None, 0))
        want[i] = (a, s)
        state[part] = (anchor, 0) if anchor is not None else (a, s + (value or 0))
    assert {r["id"]: (r["anchor"], r["since"]) for r in got} == want


def test_a_hot_part_is_cut_into_bounded_ranges(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("part"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    sizes = scan.cut(rows, "ts", 50).groupBy("part", "__block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 2 * 20000 / 50
    assert scan.cut(rows.limit(0), "ts", 50).count() == 0


@pytest.mark.parametrize("crowded", [10, 10**6])
def test_users_of_scans_with_a_hot_part(spark, crowded):
    rows = hot_rows(3)
    events, anchors = [(p, a, i) for p, a, i, _, _ in rows if i % 3], [(p, a, f"n{i}") for p, a, i, _, _ in rows if i % 3 == 0]
    anchors = list({(p, a): (p, a, v) for p, a, v in anchors}.values())
    got = cleaning.nearest_before(spark.createDataFrame(events, "part string, at int, id int"), spark.createDataFrame(anchors, "part string, at int, name string"), "part", "at", "name", crowded=crowded)
    for r in got.collect():
        best = max(((a, v) for p, a, v in anchors if p == r["part"] and a <= r["at"]), default=(0, None))
        assert r["name"] == best[1]
    cells = [(p, a, i, f"v{i}" if v is not None and v > 30 else " ") for p, a, i, v, _ in rows]
    filled = invoices.fill_down(spark.createDataFrame(cells, "part string, at int, id int, cell string"), "part", ["at", "id"], ["cell"], crowded=crowded)
    last, want = {}, {}
    for p, _, i, c in sorted(cells, key=lambda r: (r[1], r[2])):
        last[p] = c if c.strip() else last.get(p)
        want[i] = last[p]
    assert {r["id"]: r["cell"] for r in filled.collect()} == want


@pytest.mark.parametrize("crowded", [10, 10**6])
def test_turned_statements(spark, crowded):
    rng, rows = random.Random(5), []
    for part, way in (("as read", 1), ("turned", -1), ("hot", -1)):
        balance = 100
        for i in range(600 if part == "hot" else 30):
            v = rng.choice([-7, 5, 11, 20])
            balance += v
            rows.append((part, i, v * way, "other", balance if i % 3 == 2 else None))
    df = spark.createDataFrame(rows, "part string, i int, amount int, description string, running_balance int")
    got = bank.audit_balance(df, "part", ["i"], F.lit(100), turn=True, crowded=crowded).collect()
    assert not any(r["fixed"] for r in got) and all(r["turned"] == (r["part"] != "as read") for r in got)
    assert {r["part"] for r in bank.audit_balance(df, "part", ["i"], F.lit(100), crowded=crowded).where("fixed").collect()} == {"turned", "hot"}


@pytest.mark.parametrize("crowded", [5, 10**6])
def test_best_version_equals_the_fold(spark, crowded):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, None, f"d{i}"]), rng.choice([None, f"x{i}"]), rng.choice([None, None, None, f"y{i}"])) for i in range(400)]
    rows += [(100 + k, 10 * k + j, rng.randint(0, 3), rng.choice([None, f"d{j}"]), rng.choice([None, f"x{j}"]), None) for k in range(80) for j in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "k int, o int, score int, day string, x string, y string").repartition(4)
    want = {}
    for k, _, score, *fields in sorted(rows, key=lambda r: r[1]):
        if k not in want:
            want[k] = [1, score, *fields]
            continue
        a = want[k]
        new, old = fields[0] is not None, a[2] is not None
        takes = (score is not None and a[1] is not None and score > a[1] and (new or not old)) or (new and not old)
        merged = [f if f is not None else g for f, g in zip(*((fields, a[2:]) if takes else (a[2:], fields)))]
        want[k] = [a[0] + 1, max((s for s in (a[1], score) if s is not None), default=None), *merged]
    got = {r["k"]: [r["copies"], r["best_score"], r["day"], r["x"], r["y"]] for r in cleaning.best_version(df, "k", ["o"], "score", "day", ["x", "y"], crowded=crowded).collect()}
    assert got == want


@pytest.mark.parametrize("crowded", [0, 40, 4096])
def test_header_gaps_by_pointers(spark, crowded):
    rng = random.Random(4)
    marks = [(d, p) for d in range(6) for p in range(400 if d == 0 else 30) if rng.random() < 0.5]
    want = []
    for d in range(6):
        last = None
        for p in sorted(p for e, p in marks if e == d):
            if last is None or p - last > 5:
                want.append((d, p))
                last = p
    got = lines.headers_apart(spark.createDataFrame(marks + marks[:9], "doc int, at int").repartition(3), "doc", "at", 5, crowded=crowded)
    assert sorted(map(tuple, got.collect())) == want


def plain_duplicates(rows):
    def day(t):
        try:
            return datetime.date(2000, *map(int, t.split("/"))).toordinal()
        except (ValueError, AttributeError, TypeError):
            return None

    def near(a, b):
        a, b = day(a), day(b)
        if a is None or b is None:
            return a is b
        gap = abs(a - b)
        return (abs(gap - 365) if gap > 300 else gap) <= 1

    kept = {}
    for i, amount, date, text in sorted(rows):
        have, text = kept.setdefault(amount, []), " ".join((text or "").upper().split())
        if any(near(date, d) and text in t and (day(date) is not None or text == t) for _, d, t in have):
            continue
        kept[amount] = [(j, d, t) for j, d, t in have if not (near(date, d) and t in text and day(date) is not None)] + [(i, date, text)]
    return sorted(i for have in kept.values() for i, _, _ in have)


def test_duplicates_of_a_hot_amount_equal_the_loop(spark):
    rng, rows = random.Random(6), []
    words = ["ACME", "RENT", "FEE", "A", "", "card 12", "payment of the month", "ltd"]
    for i in range(1500):
        d = datetime.date(2000, 1, 1) + datetime.timedelta(rng.choice([rng.randrange(366), 0, 1, 363, 364, 365]))
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
        rows.append((i, rng.choice([5, 5, 5, 7, None]), rng.choice([f"{d.month:02d}/{d.day:02d}", f"{d.month}/{d.day}", f"{d.month:02d}/{d.day:02d}", None if i % 50 == 0 else f"{d.month}/{d.day}"]), rng.choice([text, text, None])))
    df = spark.createDataFrame(rows, "id int, amount int, date string, description string").repartition(4)
    assert sorted(r["id"] for r in bank.drop_duplicates(df, ["amount"], "id").collect()) == plain_duplicates(rows)


def test_a_year_of_different_texts_of_one_amount(spark):
    rows = spark.range(60000).select("id", F.lit(9).alias("amount"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 366).cast("int")), "MM/dd").alias("date"), F.concat(F.lit("PAYMENT "), F.md5(F.col("id").cast("string"))).alias("description"))
    more = spark.createDataFrame([(70000, 9, "06/01", "payment")], rows.schema)
    assert bank.drop_duplicates(rows.unionByName(more), ["amount"], "id").count() == 60000


def test_orphans_with_a_hot_part(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["f", "f", "g"]), i, i % 45, rng.choice(["MISSING", "MISSING", "Ann", "Bob", None, "TOTAL"]), rng.choice(["P", "Q", "R", None, "AMOUNT DUE"]), rng.choice([None, 1.0, 2.0])) for i in range(500)]
    schema = "f string, i int, idx int, person string, plan string, premium double"
    run = lambda crowded: sorted(map(str, invoices.repair_orphans(spark.createDataFrame(rows, schema), "f", ["i"], "person", F.col("plan"), ["premium"], "idx", "MISSING", crowded=crowded).collect()))
    want, last, seen = [], {}, {}
    for f, i, idx, person, plan, premium in rows:
        name = (plan or "").upper()
        sub = "AMOUNT DUE" in name
        if person == "MISSING":
            if not (sub or idx >= 50 or (name and name in seen.get(f, ())) or premium is None or last.get(f) is None):
                want.append((i, last[f], True))
            continue
        if person is not None and not sub and person != "TOTAL":
            if person != last.get(f):
                seen[f] = set()
            last[f] = person
            seen[f].add(name)
        want.append((i, person, False))
    got = invoices.repair_orphans(spark.createDataFrame(rows, schema), "f", ["i"], "person", F.col("plan"), ["premium"], "idx", "MISSING", crowded=20)
    assert sorted((r["i"], r["person"], r["repaired"]) for r in got.collect()) == sorted(want)
    assert run(20) == run(10**6)
