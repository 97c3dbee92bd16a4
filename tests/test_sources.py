"""Reading and writing files of the shapes that registers, logs and data sets have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterflow.sources import sinks, tables

NAMES = {"account": "Лицевой счёт", "serial": "Номер", "last": "Прошлое"}
ROWS = [("Лицевой счёт", "Номер", "Прошлое", ""), (" 7450006640.0 ", " 007. ", "100", "x"), ("", "", "", ""), ("A-1", "12", "", "y")]


@pytest.mark.parametrize("separator, encoding", [(",", "utf-8-sig"), (";", "utf-8"), (";", "cp1251")])
def test_register(spark, tmp_path, separator, encoding):
    path = tmp_path / "register.csv"
    path.write_bytes("\n".join(separator.join(r) for r in ROWS).encode(encoding))
    got = tables.register(spark, str(path), NAMES).orderBy("row_order").collect()
    assert [(r["account"], r["serial"], r["last"]) for r in got] == [("7450006640", "007", "100"), ("A-1", "12", "")]
    assert got[0]["data"]["Прошлое"] == "100"
    with pytest.raises(ValueError, match="no column"):
        tables.register(spark, str(path), NAMES | {"last": "none"})


@pytest.mark.parametrize("encoding", ["utf-8", "cp1251"])
def test_encoding_of_the_whole_file_and_plain_names(spark, tmp_path, encoding):
    rows = ["account;serial;_code;;_c1", *(f"{k};7;x;;" for k in range(500)), "A-9;8;улица Мира;dropped;н"]
    (tmp_path / "late.csv").write_bytes("\n".join(rows).encode(encoding))
    got = tables.csv(spark, str(tmp_path / "late.csv"))
    assert got.columns == ["account", "serial", "_code", "_c1", "row_order"] and got.count() == 501
    assert tuple(got.where("account = 'A-9'").first())[:4] == ("A-9", "8", "улица Мира", "н")


def test_cells_that_span_lines(spark, tmp_path):
    (tmp_path / "quoted.csv").write_text('a,b\n1,"first\nsecond, ""third"""\n2,\n')
    assert [tuple(r)[:2] for r in tables.csv(spark, str(tmp_path / "quoted.csv")).orderBy("row_order").collect()] == [("1", 'first\nsecond, "third"'), ("2", "")]
    (tmp_path / "empty.csv").write_text("")
    assert tables.csv(spark, str(tmp_path / "empty.csv")).count() == 0


def test_log(spark, tmp_path):
    assert tables.log(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "old.csv").write_text("original_filename,outcome\na.jpg,PLUS\n")
    row = tables.log(spark, str(tmp_path / "old.csv")).first()
    assert (row["original_filename"], row["outcome"], row["photo_hash"]) == ("a.jpg", "PLUS", "")
    sinks.write_log(tables.log(spark, str(tmp_path / "old.csv")), str(tmp_path / "out"))
    assert tables.csv(spark, str(tmp_path / "out")).columns[:-1] == tables.LOG_COLUMNS


def test_photos_and_crops(spark, tmp_path):
    for name, data in (("f1/a.jpg", b"1"), ("f1/b.JPG", b"1"), ("f2/c.png", b"2"), ("f2/note.doc", b"3"), ("f2/Thumbs.db", b"4"), ("f2/13__serial1__007.jpg", b"5")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in tables.photos(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.jpg", "b.JPG", "c.png", "13__serial1__007.jpg"} and got["a.jpg"]["photo_hash"] == got["b.JPG"]["photo_hash"]
    assert [r["path"].rsplit("/", 1)[1] for r in tables.stray_files(spark, str(tmp_path)).collect()] == ["note.doc"]
    assert [tuple(r)[1:] for r in tables.crops(spark, str(tmp_path)).collect()] == [("13", "serial", 1, "007")]


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 1\n4 0.5 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n0 0.5\nx 0 0 0 0\n")
    assert [r["valid"] for r in tables.label_lines(spark, str(tmp_path), 4).collect()] == [True, False, False, False, False]


def test_matched(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert {tuple(r) for r in tables.matched(ids(1, 2, 2), ids(2, 3), "id").collect()} == {(1, "left"), (2, "both"), (3, "right")}


def test_changes(spark, tmp_path):
    table = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "k string, v string, n int")
    sinks.upsert(table, spark.createDataFrame([("b", "3", 2), ("c", "4", 2)], "k string, v string, n int"), "k", "n", str(tmp_path / "t"))
    after = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["k"], r["v"]) for r in after.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {r["k"] for r in sinks.without_keys(after, after.where("k = 'a'"), "k").collect()} == {"b", "c"}
    fresh = sinks.updated(after, spark.createDataFrame([("a", None)], "k string, v string"), "k", ["v"])
    assert {(r["k"], r["v"]) for r in fresh.collect()} == {("a", None), ("b", "3"), ("c", "4")}
    with pytest.raises(ValueError):
        sinks.updated(after, spark.createDataFrame([("a", 1)], "k string, n int"), "k", ["v"])


def test_cells_labels_splits_and_snapshots(spark, tmp_path):
    texts = ["12", "-3.50", "007", "x", "", "12345678901234567890"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(sinks.typed_cell(F.col("t")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got[:4]] == [(12, None, None), (None, -3.5, None), (None, None, "007"), (None, None, "x")]
    rows = spark.createDataFrame([("p", "123", "133"), ("q", "12", "12"), ("r", "12", None)], "photo string, final string, model string")
    assert sorted(tuple(r) for r in sinks.changed_labels(rows).collect()) == [("p", 1, "2"), ("r", 0, "1"), ("r", 1, "2")]
    many = spark.range(300).select(F.col("id").cast("string").alias("k"))
    sinks.write_split(many, "k", str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 300
    for version in range(4):
        old = sinks.snapshot(many, str(tmp_path / "snap"), version, keep=2)
    assert old == [0, 1]
