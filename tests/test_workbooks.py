"""Workbooks read and written, failing rows, and counts of a run as it goes."""

from __future__ import annotations

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterflow.operators import isolation
from meterflow.sources import sinks, tables, workbooks
from meterflow.streaming import cycle, progress

M, R = workbooks._MAIN, workbooks._LINKS
STRINGS = ["Счёт", "Номер", "Дата", "Прошлое", " 0012345 ", "<si><r><t>Ива</t></r><r><t>нов</t></r><rPh sb='0' eb='1'><t>x</t></rPh></si>", "_x0041_", "пусто", "Когда"]


def made(path, rows, date1904=False, other_sheet=True):
    """A workbook as a spreadsheet program writes it: shared strings, styles, links, a first sheet that is not sheet1.xml."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        pr = '<workbookPr date1904="1"/>' if date1904 else "<workbookPr/>"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}">{pr}<sheets><sheet name="Лист &amp; 1" sheetId="7" r:id="rId9"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks._PACKAGE}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">' + "".join(s if s.startswith("<si>") else f"<si><t>{s}</t></si>" for s in STRINGS) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy;@"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{M}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{M}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    return str(path)


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c><c r="F1" t="s"><v>3</v></c></row>'
ROWS = [
    HEAD,
    '<row r="2"><c r="A2"><v>1000000001</v></c><c r="B2" t="s"><v>4</v></c><c r="C2" s="1"><v>46162</v></c><c r="D2"><v>12.5</v></c></row>',
    '<row r="3"/>',
    '<row r="5"><c r="A5" t="s"><v>5</v></c><c r="C5" s="2"><v>46162.75</v></c><c r="D5" s="3"><v>1E3</v></c><c r="E5"><v>9</v></c></row>',
    '<row r="6"><c r="B6" t="s"><v>6</v></c><c r="C6" t="e"><v>#DIV/0!</v></c><c r="D6" t="str"><f>A1</f><v> text </v></c></row>',
    '<row r="7"><c r="A7" t="b"><v>1</v></c><c r="B7" t="inlineStr"><is><t>0007</t></is></c><c r="C7" s="1"><v>0.5</v></c><c r="D7"/></row>',
    '<row r="8"><c r="E8"><v>1</v></c></row>',
]


def test_cells_of_all_kinds(spark, tmp_path):
    rows, numeric = tables.read_register(spark, made(tmp_path / "a.xlsx", ROWS))
    assert rows.columns == ["Счёт", "Номер", "Дата", "Прошлое", "row_order"] and numeric == ["Прошлое"]
    got = [tuple(r) for r in rows.orderBy("row_order").collect()]
    assert got == [("1000000001", "0012345", "20 05 2026", "12.5", 2), ("Иванов", "", "20 05 2026", "1000", 5), ("", "A", "", "text", 6), ("1", "0007", "12:00:00", "", 7)]
    assert workbooks.headings(spark, str(tmp_path / "a.xlsx"))[0] == "Лист & 1"


def test_days_from_1904_and_before_march_1900(spark, tmp_path):
    cell = lambda n, v: f'<row r="{n}"><c r="A{n}" s="1"><v>{v}</v></c></row>'
    head = '<row r="1"><c r="A1" t="s"><v>8</v></c></row>'
    for late, days in ((True, ["02 01 1904", "01 03 1904"]), (False, ["01 01 1900", "29 02 1900"])):
        made(tmp_path / f"{late}.xlsx", [head, cell(2, 1), cell(3, 60)], date1904=late)
        got = [r[0] for r in workbooks.workbook(spark, str(tmp_path / f"{late}.xlsx")).orderBy("row_order").collect()]
        assert got[0] == days[0] and (got[1] == days[1] or not late)


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "t.txt").write_text("x")
    with pytest.raises(ValueError, match="xlsx"):
        tables.read_register(spark, str(tmp_path / "t.txt"))
    with pytest.raises(ValueError, match="headings"):
        tables.read_register(spark, made(tmp_path / "none.xlsx", []))
    with pytest.raises(ValueError, match="headings"):
        tables.read_register(spark, made(tmp_path / "blank.xlsx", ['<row r="1"><c r="A1"/></row>', ROWS[1]]))


def test_csv_and_workbook_give_the_same_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Счёт;Номер\n1000000001;0012345\n7;x\n")
    made(tmp_path / "a.xlsx", ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>', '<row r="2"><c r="A2"><v>1000000001</v></c><c r="B2" t="s"><v>4</v></c></row>', '<row r="3"><c r="A3"><v>7.0</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row>'])
    one, two = (tables.read_register(spark, str(tmp_path / f"a.{k}")) for k in ("csv", "xlsx"))
    assert [tuple(r)[:2] for r in one[0].orderBy("row_order").collect()] == [tuple(r)[:2] for r in two[0].orderBy("row_order").collect()]
    assert "Счёт" in one[1] and "Счёт" in two[1] and "Номер" not in two[1]


def test_written_workbooks_read_back(spark, tmp_path):
    odd = ["0012", "a<b>&\"'", " spaced ", "_x0041_", "bell\x07", "", None, "1234567890", "строка\nдве", "12.50"]
    rows = [(f"k{n:03d}", odd[n % 10], str(n), str(n * 2) if n % 7 else None, 1000 - n) for n in range(250)]
    df = spark.createDataFrame(rows, "account string, text string, last string, reading string, row_order long").repartition(5)
    at = str(tmp_path / "out")
    for _ in range(2):  # the second takes the place of the first
        workbooks.write_workbooks(df.withColumn("difference", (F.col("reading").cast("long") - F.col("last").cast("long")).cast("string")), at, numbers=("last", "reading"), differences={"difference": ("reading", "last")}, most=101)
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert all(f.startswith("part-") and f.endswith(".xlsx") for f in files) and len(files) >= 3
    got = [tuple(r)[:5] for r in workbooks.workbook(spark, f"{at}/*.xlsx").orderBy("row_order").collect()]
    number = lambda t: workbooks.number_text(t) if t else ""
    expected = [(a, (t or "").strip(), number(last), number(r) if r else "", str(int(r) - int(last)) if r else "") for a, t, last, r, _ in reversed(rows)]
    assert got == expected
    with zipfile.ZipFile(f"{at}/{files[0]}") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<f>D2-C2</f>" in sheet and sheet.count("<row ") <= 101


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    at = tmp_path / "out"
    good = spark.range(10).select(F.col("id").cast("string").alias("a"), F.col("id").alias("row_order"))
    workbooks.write_workbooks(good, str(at))
    before = {p.name: p.read_bytes() for p in at.iterdir() if not p.name.startswith(".")}
    fails = F.when(F.col("id") == 150, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string"))
    spark.dataSource.register(workbooks.WorkbookSource)
    with pytest.raises(Exception, match="broken row"):
        spark.range(0, 200, 1, 4).select(fails.alias("a")).write.format("meterflow_workbook").option("path", str(at)).mode("overwrite").save()
    assert {p.name: p.read_bytes() for p in at.iterdir() if not p.name.startswith(".")} == before
    with pytest.raises(Exception, match="workbooks already"):
        good.select("a").write.format("meterflow_workbook").option("path", str(at)).mode("append").save()


def test_export_keeps_order_and_rows(spark, tmp_path):
    register = spark.createDataFrame([("A-2", "007", 10, True, 1), ("A-1", "8", 20, True, 2), ("A-3", "9", 30, False, 3)], "account string, serial string, last long, in_table boolean, row_order long")
    sinks.export_month(register, spark.createDataFrame([("A-1", 25)], "account string, value long"), str(tmp_path / "m"))
    assert [tuple(r)[:5] for r in workbooks.workbook(spark, str(tmp_path / "m" / "*.xlsx")).orderBy("row_order").collect()] == [("A-2", "007", "10", "", ""), ("A-1", "8", "20", "25", "5")]


def test_failing_rows_alone_fail():
    calls: dict[int, int] = {}

    def recognise(batch):
        ids = batch.column(0).to_pylist()
        for i in ids:
            calls[i] = calls.get(i, 0) + 1
        if bad := [i for i in ids if i in (17, 4096, 9999)]:
            raise KeyError(bad[0])
        return pa.RecordBatch.from_arrays([pa.array([i * 2 for i in ids])], ["twice"])

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["id"])
    out = list(isolation.halved(batch, recognise))
    assert [i for part, *_ in out for i in part.column(0).to_pylist()] == list(range(10_000))
    assert [(p.column(0)[0].as_py(), why) for p, r, why in out if r is None] == [(i, f"KeyError: {i}") for i in (17, 4096, 9999)]
    assert max(calls.values()) <= 15 and sum(calls.values()) < 10_000 * 6


def test_recognised_rows(spark):
    def recognise(batch):
        ids = batch.column(0).to_pylist()
        if 7 in ids:
            raise ValueError("seven")
        return pa.RecordBatch.from_arrays([pa.array([None if i is None else i + 1 for i in ids], pa.int32())], ["next"])

    rows = spark.createDataFrame([(k, "x") for k in range(20)] + [(None, "x"), (7, "y")], "id int, error_ string")
    got = sorted(((r["id"] or 0, r["next"], r["error"]) for r in isolation.recognised(rows, recognise, "next int").collect()), key=repr)
    assert sum(e == "ValueError: seven" for *_, e in got) == 2 and sum(n is not None for _, n, _ in got) == 19
    assert isolation.recognised(rows.limit(0), recognise, "next int").count() == 0
    with pytest.raises(ValueError, match="already"):
        isolation.recognised(rows, recognise, "ID int")


def test_progress_of_a_stream(spark, tmp_path):
    outcomes = ["PLUS", "MINUS", "PLUS", "ERROR", "REPEAT", None]
    for day in range(3):
        spark.createDataFrame([(o,) for o in outcomes * (day + 1)], "outcome string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{day}.parquet"))
    listener = progress.Progress(total=72)
    spark.streams.addListener(listener)
    try:
        rows = cycle.new_files(spark, str(tmp_path / "in" / "*"), "outcome string", per_batch=1)
        cycle.run_available(progress.observed(rows), lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out{n}")), str(tmp_path / "state"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    counts = listener.counts()
    assert (counts["done"], counts["PLUS"], counts["ERROR"], counts["NO_METER"]) == (36, 12, 6, 0)
    assert len(listener.parts) == 3 and listener.ended and listener.failure is None and listener.left() is not None


def test_time_left():
    assert [progress.time_left(60, d, 100) for d in (0, 10, 50, 100)] == [None, 9, 1, None]
