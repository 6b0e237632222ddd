"""Workbooks written and read back, and one made by hand."""

import datetime
import zipfile

from pyspark.sql import functions as F

from tallyforge.sources import workbooks


def test_round_trip_of_several_sheets(spark, tmp_path):
    day, time = datetime.date(2026, 2, 28), datetime.datetime(2026, 1, 5, 10, 30, 15)
    rows = [(1, "a & <b>", 1.5, True, day, time, None), (2, None, None, None, None, None, None), (3, " é\n", -0.25, False, datetime.date(1950, 1, 1), time, None)]
    one = spark.createDataFrame(rows, "id int, name string, amount double, ok boolean, day date, at timestamp, nothing string").coalesce(1)
    two = spark.range(25).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("text"), (F.col("id") / 4).cast("decimal(10,2)").alias("d")).repartition(4)
    path = str(tmp_path / "book.xlsx")
    assert workbooks.write({"First: one": one, "two": two}, path, most_rows=11) == ["First_ one", "two", "two 2", "two 3"]
    got = workbooks.read(spark, path, "First_ one").orderBy("row").collect()
    assert [f.dataType.simpleString() for f in workbooks.read(spark, path, "First_ one").schema] == ["string", "string", "bigint", "double", "string", "double", "boolean", "date", "timestamp"]
    assert [tuple(r)[3:] for r in got] == [(1.0, "a & <b>", 1.5, True, day, time), (2.0, None, None, None, None, None), (3.0, " é\n", -0.25, False, datetime.date(1950, 1, 1), time)]
    many = workbooks.read(spark, path)
    assert many.where("sheet LIKE 'two%'").agg(F.count("*"), F.sum("id"), F.sum("d")).first()[0:3] == (25, 300.0, 75.0)
    assert sorted(r["text"] for r in many.where("text IS NOT NULL").collect()) == sorted(f"n{i}" for i in range(25))


def test_a_long_sheet_streams(spark, tmp_path):
    path = str(tmp_path / "long.xlsx")
    workbooks.write({"long": spark.range(120000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))}, path)
    got = workbooks.read(spark, path)
    assert got.agg(F.count("*"), F.sum("id"), F.count_distinct("h")).first()[0:3] == (120000, sum(range(120000)), 120000)


def test_shared_strings_gaps_and_files_of_other_columns(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "hand.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="/xl/worksheets/x.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>An</t></r><r><t>na</t></r></si><si><t>When</t></si><si><t> </t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/x.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="inlineStr"><is><t>Empty</t></is></c></row><row r="3"/><row r="4"><c r="B4" t="s"><v>3</v></c></row>'
                   '<row r="5"><c r="B5" t="s"><v>1</v></c><c r="D5" s="1"><v>46023</v></c><c r="F5" t="str"><v>beyond the header</v></c></row><row r="6"><c r="B6" t="e"><v>#N/A</v></c><c r="D6" s="1"><v>46024</v></c></row></sheetData></worksheet>')
    got = workbooks.read(spark, str(tmp_path / "hand.xlsx"))
    assert got.columns == ["file", "sheet", "row", "Name", "When"]
    assert [tuple(r)[2:] for r in got.orderBy("row").collect()] == [(5, "Anna", datetime.date(2026, 1, 1)), (6, None, datetime.date(2026, 1, 2))]
    workbooks.write({"S": spark.createDataFrame([("x", "Bob")], "Other string, Name string")}, str(tmp_path / "second.xlsx"))
    both = workbooks.read(spark, str(tmp_path / "*.xlsx"))
    assert sorted((r["Name"] or "", r["Other"] or "") for r in both.collect()) == [("", ""), ("Anna", ""), ("Bob", "x")]


def test_a_workbook_without_rows(spark, tmp_path):
    workbooks.write({"none": spark.createDataFrame([], "a int, b string")}, str(tmp_path / "none.xlsx"))
    got = workbooks.read(spark, str(tmp_path / "none.xlsx"))
    assert got.count() == 0
