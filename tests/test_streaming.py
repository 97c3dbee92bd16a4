"""Streams against the same work in one batch."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from meterflow.plans import analogs
from meterflow.streaming import cycle


@pytest.fixture(scope="module")
def results(spark, sf_dir, tmp_path_factory):
    """The rows in three files that come one after the other, in the order of seq; failed ones have no account."""
    folder = str(tmp_path_factory.mktemp("results") / "in")
    rows = analogs.runs(spark, sf_dir).select("seq", F.when(F.col("outcome").isin("PLUS", "MINUS"), F.col("account")).alias("account"), F.concat(F.lit("h"), F.col("name")).alias("photo_hash"), "outcome")
    most = rows.agg(F.max("seq")).first()[0]
    for k in range(3):
        part = rows.where((F.col("seq") * 3 > most * k if k else F.lit(True)) & (F.col("seq") * 3 <= most * (k + 1)))
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken by their time
    return folder


def test_batches_equal_one_batch(spark, results, tmp_path):
    stream = cycle.first_success_stream(cycle.new_files(spark, results, cycle.RESULT, 1))
    cycle.run_available(stream, cycle.idempotent_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    whole = cycle.first_success_batch(spark.read.schema(cycle.RESULT).parquet(results))
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() > 1
    rows = lambda df: sorted((tuple(r) for r in df.select("seq", "account", "photo_hash", "outcome", "decided").collect()), key=repr)
    assert rows(got) == rows(whole)
    assert {r["n"] for r in got.where("decided in ('PLUS', 'MINUS')").groupBy("account").agg(F.count("*").alias("n")).collect()} == {1}


def test_second_run_reads_only_what_is_new(spark, results, tmp_path):
    sink = cycle.idempotent_sink(str(tmp_path / "out"))
    for _ in range(2):
        cycle.run_available(cycle.new_files(spark, results, cycle.RESULT), sink, str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(results).count()


def test_sink_can_repeat_a_batch(spark, tmp_path):
    sink, rows = cycle.idempotent_sink(str(tmp_path)), spark.range(5)
    sink(rows, 0)
    sink(rows, 0)
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_distinct_contents(spark):
    rows = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", ""), ("d", "")], "name string, photo_hash string")
    got = cycle.distinct_contents(rows).collect()
    assert len(got) == 3 and {r["name"] for r in got} >= {"c", "d"}


def test_waiting_photos_are_closed(spark, tmp_path):
    rows = [(1, "A", "p", "DIGITS_ERROR"), (2, "A", "q", "SUSPICIOUS"), (3, "A", "q", "REPEAT"), (4, "B", "r", "SUSPICIOUS"), (5, "A", "s", "PLUS"), (6, "A", "t", "DIGITS_ERROR")]
    spark.createDataFrame(rows, cycle.RESULT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = cycle.close_waiting_stream(cycle.new_files(spark, str(tmp_path / "in"), cycle.RESULT))
    cycle.run_available(stream, cycle.idempotent_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert [tuple(r) for r in got] == [(1, "A", "p", "REPEAT")]


def test_reread(spark):
    rows = [(1, "f", "a", "auto", "SERIAL_NOT_FOUND", "7", ""), (2, "f", "b", "auto", "SERIAL_NOT_FOUND", "8", ""), (3, "f", "c", "auto", "ERROR", "", ""), (4, "f", "d", "manual", "NOT_IN_DB", "7", ""), (5, "f", "e", "auto", "PLUS", "7", ""), (6, "f", "g", "auto", "DIGITS_ERROR", "7", "")]
    log = spark.createDataFrame(rows, "seq int, folder string, name string, source string, outcome string, serial string, notes string")
    register = spark.createDataFrame([("07",)], "serial string")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(cycle.reread(log, register)) == ["a", "c", "d"]
    assert names(cycle.reread(log, register, True)) == ["a", "b", "c", "d", "g"]
