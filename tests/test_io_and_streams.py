import json

from pyspark.sql import functions as F

from tallyforge.sources import readers, writers
from tallyforge.streaming import streams


def test_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"claims": [{"id": 1}, {"id": 2}]}))
    got = readers.records(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["SOURCE_FILE"]) for r in got) == [(1, "a.json"), (2, "a.json")]


def test_record_files_of_every_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"claims": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"invoices": [{"id": 3, "total": 5.5}], "data": [{"id": 9}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"id": 4}, {"id": 5}]))
    got = readers.records(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["SOURCE_FILE"]) for r in got) == [(1, "a.json"), (2, "a.json"), (3, "b.json"), (4, "c.json"), (5, "c.json")]
    assert [r["total"] for r in got if r["id"] == 3] == [5.5]


def test_headerless_lines_of_any_width(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b,c\nd\n,,\ne,f,g,h\ni,j\n")
    assert sorted(tuple(r) for r in readers.headerless(spark, str(tmp_path / "s.csv"), 3).collect()) == sorted([("a", "b", "c"), ("d", None, None), ("i", "j", None)])
    assert readers.headerless(spark, str(tmp_path / "s.csv")).count() == 4


def test_empty_columns_drop_out(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b,c\n1,,x\n,,\n2,,\n")
    df = readers.sheets(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["a", "c", "sheet"] and df.count() == 2
    assert readers.known(df, ["c"]).count() == 1


def test_sheets_and_aliases(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Total Paid\nann,3\n,\n")
    df = readers.sheets(spark, str(tmp_path / "s.csv"))
    got = readers.resolve_columns(df, {"paid": ["total_paid", "Total Paid"], "name": [], "gone": ["x"]}).collect()
    assert [tuple(r) for r in got][0] == ("3", "ann", None)
    assert readers.headerless(spark, str(tmp_path / "s.csv"), 2).count() >= 2
    assert readers.reindexed(df, {"Name": "string", "z": "int"}).columns == ["Name", "z"]


def test_file_gate(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"MZ")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "e.csv").write_bytes(b"\x00\x01\x02")
    rows = readers.validated(readers.files(spark, str(tmp_path))).collect()
    got = {r["path"][-5:]: r["rejected"] for r in rows}
    assert got["a.pdf"] is None and got["b.pdf"] and got["c.exe"] == "type" and got["d.csv"] is None and got["e.csv"]
    assert {r["path"][-5:]: r["type"] for r in rows}["a.pdf"] == "application/pdf"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    writers.write_case(df.withColumnRenamed("k", "case_id"), str(tmp_path / "case"))
    writers.write_records(df, str(tmp_path / "json"))
    writers.write_workbook({"one": df}, str(tmp_path / "book"))
    writers.write_sheet(df, str(tmp_path / "sheet"), ["v", "k"])
    assert spark.read.parquet(str(tmp_path / "case" / "rows")).count() == 2
    assert spark.read.json(str(tmp_path / "case" / "metadata")).first()["rows"] == 2
    assert writers.upsert(df, df.limit(0), "k", "at").first()["v"] == "b"


def test_stream_reads_each_file_once(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    e.limit(300).write.parquet(src)
    run = lambda: streams.run_available(streams.once(streams.new_rows(spark, src, e.schema), "event_id", "ts", "1 hour"), ck, lambda b, _: b.write.mode("append").parquet(out))
    run()
    run()
    assert spark.read.parquet(out).count() == 300
    e.limit(310).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() >= 300


def test_stream_windows_and_sessions(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.coalesce(1).sortWithinPartitions("ts").write.parquet(src)
    s = streams.new_rows(spark, src, e.schema)
    got = {}
    for name, q in (("w", streams.window_counts(s, "ts", ["event_type"], "1 day")), ("s", streams.sessions(s, "ts", ["user_id"], "6 hours"))):
        streams.run_available(q, str(tmp_path / name), lambda b, _, name=name: got.setdefault(name, []).extend(b.collect()))
    want = e.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert 0 < len(got["w"]) <= want and got["s"]


def test_paired_steps(spark, tmp_path):
    at = lambda m: f"2026-01-01 00:{m:02d}:00"
    for name, rows in (("s", [(1, at(0)), (2, at(1))]), ("e", [(1, at(5)), (2, at(59))])):
        spark.createDataFrame(rows, "k int, ts string").select("k", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
    schema, got = "k int, ts timestamp", []
    q = streams.paired_steps(streams.new_rows(spark, str(tmp_path / "s"), schema), streams.new_rows(spark, str(tmp_path / "e"), schema), "k", "ts", "30 minutes")
    streams.run_available(q, str(tmp_path / "ck"), lambda b, _: got.extend(b.collect()))
    assert [r["k"] for r in got] == [1]


def test_follow_reads_until_it_is_stopped(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = streams.follow(streams.new_rows(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "ck"), lambda b, _: got.extend(r["id"] for r in b.collect()), "1 second")
    q.processAllAvailable()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == sorted([*range(5), *range(5)])
