"""Streams with state, ledgers, pacing and merged tables, with replays and restarts."""

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import store, tables
from tallyforge.streaming import ledger, pacing, requests, streams

SCHEMA = "id string, ts timestamp, status string"


def add(spark, path, rows):
    spark.createDataFrame(rows, "id string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def at(h, m=0):
    return f"2026-01-01 {h:02d}:{m:02d}:00"


def test_requests_over_batches_with_a_restart(spark, tmp_path):
    src, ck, got = str(tmp_path / "in"), str(tmp_path / "ck"), []
    run = lambda: streams.run_available(requests.lifecycles(streams.new_rows(spark, src, SCHEMA), "id", "ts", "status"), ck, lambda b, _: got.extend(tuple(r) for r in b.select("id", "event", "status", "updates").collect()), "update")
    add(spark, src, [("a", at(1), "pending"), ("a", at(1, 5), "reading"), ("b", at(1), "pending"), ("x", at(1), "reading"), ("q", at(1), "pending")])
    run()
    assert sorted(got) == [("a", "active", "reading", 2), ("b", "active", "pending", 1), ("q", "active", "pending", 1)]
    got.clear()
    add(spark, src, [("a", at(1, 9), "completed"), ("a", at(1, 10), "reading"), ("b", at(1, 8), "reading"), ("x", at(1, 8), "completed")])
    run()  # a restart: the state comes from the checkpoint
    assert sorted(got) == [("a", "completed", "completed", 3), ("b", "active", "reading", 2)]
    got.clear()
    add(spark, src, [("c", at(9), "pending"), ("c", at(9, 1), "failed"), ("c", at(9, 2), "pending")])
    run()
    assert {("c", "failed", "failed", 2), ("c", "active", "pending", 1)} <= set(got)
    add(spark, src, [("d", at(9, 3), "pending")])
    run()
    assert {("b", "expired", "reading", 2), ("q", "expired", "pending", 1)} <= set(got) and not any(r[:2] == ("a", "expired") for r in got)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.range(10).withColumn("v", F.lit("x"))
    write = ledger.once_into(path, "q")
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert ledger.committed(spark, path, df.schema).count() == 20
    # cut off before the ledger: not seen, then written over
    df.write.parquet(f"{path}/rows/query=q/batch=2")
    assert ledger.committed(spark, path, df.schema).count() == 20
    write(df, 2)
    assert ledger.committed(spark, path, df.schema).count() == 30
    # a damaged entry is set aside, its batch is written anew
    (tmp_path / "sink" / "ledger" / "q-1.json").write_text("{")
    (tmp_path / "sink" / "ledger" / ".q-1.json.crc").unlink(missing_ok=True)
    assert ledger.committed(spark, path, df.schema).count() == 20
    write(df, 1)
    assert ledger.committed(spark, path, df.schema).count() == 30
    assert any(n.endswith(".corrupt") for n in store.names(spark, f"{path}/ledger"))


def test_keys_enter_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = ledger.once_into(path, "mail", key="id")
    write(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), 1)
    assert sorted((r["id"], r["v"]) for r in ledger.committed(spark, path, "id int, v string").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert ledger.committed(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_a_crash_between_rows_and_checkpoint(spark, tmp_path):
    src, ck, path = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "sink")
    spark.range(5).write.parquet(src)
    write = ledger.once_into(path, "q")

    def crash(b, n):
        write(b, n)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        streams.run_available(streams.new_rows(spark, src, "id long"), ck, crash)
    streams.run_available(streams.new_rows(spark, src, "id long"), ck, write)
    assert ledger.committed(spark, path, "id long").count() == 5


def test_pace():
    p = pacing.Pace(60)
    assert [p.after(n) for n in (1, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0)] == [60, 60, 60, 120, 240, 300, 300, 60, 60, 60, 120]


def test_following_waits_longer_while_nothing_comes(spark, tmp_path):
    src, got, waits = str(tmp_path / "in"), [], []
    spark.range(3).write.parquet(src)

    def pause(seconds):
        waits.append(seconds)
        if len(waits) == 5:
            spark.range(4).write.mode("append").parquet(src)

    seen = pacing.follow(lambda: streams.new_rows(spark, src, "id long"), str(tmp_path / "ck"), lambda b, _: got.append(b.count()), base=1, looks=7, pause=pause)
    assert [n for n, _ in seen] == [3, 0, 0, 0, 0, 4, 0] and waits == [1, 1, 1, 2, 4, 1] and sum(got) == 7


def test_a_merged_table(spark, tmp_path):
    t = tables.KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    assert t.read() is None
    t.merge(spark.createDataFrame([(i, "a", 1) for i in range(50)] + [(7, "late", 0)], "k int, v string, at int"), "at", "q-0")
    first = {r["k"]: r["v"] for r in t.read().collect()}
    assert first == {i: "a" for i in range(50)}
    assert t.merge(spark.createDataFrame([(1, "zzz", 9)], "k int, v string, at int"), "at", "q-0") == 1  # a replay
    t.merge(spark.createDataFrame([(3, "b", 2, True), (4, "old", 0, True), (99, "new", 1, None)], "k int, v string, at int, more boolean"), "at", "q-1")
    now = {r["k"]: (r["v"], r["more"]) for r in t.read().collect()}
    assert now[3] == ("b", True) and now[4] == ("a", None) and now[99] == ("new", None) and len(now) == 51
    assert {r["k"]: r["v"] for r in t.read(1).collect()} == first
    # untouched buckets stay where they are
    one, two = (t._rows(v).inputFiles() for v in (__import__("json").loads(store.read(spark, f"{tmp_path}/t/versions/{n:08d}.json")) for n in (1, 2)))
    assert set(one) & set(two)
    # a merge that loses the race raises and leaves the table as it was
    loser = tables.KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    store.write(spark, f"{tmp_path}/t/versions/00000003.json", store.read(spark, f"{tmp_path}/t/versions/00000002.json"))
    loser._version = lambda: (2, t._version()[1])
    with pytest.raises(RuntimeError):
        loser.merge(spark.createDataFrame([(3, "c", 5)], "k int, v string, at int"), "at")
    assert {r["k"]: (r["v"], r["more"]) for r in t.read().collect()} == now
