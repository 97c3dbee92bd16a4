"""Operators' decisions as events: the tables of readings, changes and log rows are derived from them, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookups import pick_last


def readings_after(readings: DataFrame, accepted: DataFrame) -> DataFrame:
    """(account, value, date, source): the last accepted value (seq, account, value, date) of each account, or its reading from before."""
    old = readings.select("account", "value", "date", "source", F.lit(-1).cast("long").alias("seq"))
    new = accepted.select("account", "value", "date", F.lit("manual").alias("source"), F.col("seq").cast("long").alias("seq"))
    return pick_last(old.unionByName(new), ["account"], F.desc("seq")).drop("seq")


def changes_of(readings: DataFrame, accepted: DataFrame) -> DataFrame:
    """(account, old, new): the audit rows of accepted values, the first against the reading before, each later one against its predecessor."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("account").orderBy("seq"))
    rows = accepted.withColumn("_before", before).join(readings.select("account", F.col("value").alias("_old")), "account", "left")
    return rows.select("account", F.coalesce("_before", "_old").alias("old"), F.col("value").alias("new"))


def corrected_readings(readings: DataFrame, corrections: DataFrame) -> DataFrame:
    """readings (account, value, date) after corrections (seq, old_account, logged, account, value) of verified rows.

    The last correction for an account gives its value, with the date of the reading that it moves. A reading of the
    wrong account goes only if it still has the logged value; corrections within an account only change the value.
    """
    moved = corrections.where("old_account <> account").select(F.col("old_account").alias("account"), F.col("logged").alias("value")).distinct()
    kept = readings.join(moved, ["account", "value"], "left_anti")
    last = pick_last(corrections, ["account"], F.desc("seq")).select("account", F.col("value").alias("_new"), "old_account")
    dates = readings.select(F.col("account").alias("old_account"), F.col("date").alias("_date"))
    fresh = last.join(dates, "old_account", "left").select("account", "_new", "_date")
    both = kept.join(fresh, "account", "full_outer")
    return both.select("account", F.coalesce("_new", "value").alias("value"), F.coalesce("_date", "date").alias("date"))


def verified(log: DataFrame, marks: DataFrame) -> DataFrame:
    """log with verified_by and verified_at from the last mark (seq of the row, who, at) of each row."""
    last = pick_last(marks, ["seq"], F.desc("at")).select("seq", F.col("who").alias("_who"), F.col("at").alias("_at"))
    met = log.drop("verified_by", "verified_at").join(last, "seq", "left")
    return met.withColumn("verified_by", F.coalesce("_who", F.lit(""))).withColumn("verified_at", F.coalesce("_at", F.lit(""))).drop("_who", "_at")


def latest_fixes(changes: DataFrame) -> DataFrame:
    """(account, serial): the last serial that an operator gave each account."""
    return changes.groupBy("account").agg(F.max_by("new", "id").alias("serial"))


def table_readings(register: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings that the register brings for accounts that have none; those that have one keep it."""
    return register.where("account <> '' and reading <> ''").select("account", F.col("reading").try_cast("double").alias("value")).where("value is not null").join(readings.select("account"), "account", "left_anti")


def judged(notes: DataFrame) -> DataFrame:
    """notes (understood, conflict, account, reading, true_account, true_reading) with verdict: danger, conflict, right, confirms or unclear, the first that holds.

    danger: an account or reading that is not the true one; conflict: the note disagrees with the meter.
    """
    wrong = (F.col("account") != F.col("true_account")) | (F.col("reading") != F.col("true_reading"))
    right = F.col("account").isNotNull() | F.col("reading").isNotNull()
    verdict = F.when(F.coalesce(wrong, F.lit(False)), "danger").when(F.col("conflict"), "conflict").when(F.col("understood") & right, "right").when(F.col("understood"), "confirms").otherwise("unclear")
    return notes.withColumn("verdict", verdict)


def checked(predictions: DataFrame, answers: DataFrame, serial_least: float, digits: int = 5) -> DataFrame:
    """predictions (key, serial, serial_conf, number) against answers (key, reason, serial, reading): one row of flags for each answer that has a prediction."""
    truth = answers.select("key", "reason", F.trim("serial").alias("_s"), F.col("reading").cast("string").alias("_r"))
    met = predictions.join(truth, "key")
    s = F.coalesce(F.trim("serial"), F.lit(""))
    ok = (s != "") & F.array_contains(F.array(s, F.concat(F.lit("0"), s), F.concat(F.lit("00"), s)), F.col("_s"))
    sure = F.coalesce(F.col("serial_conf") >= serial_least, F.lit(False))
    wide = lambda c: F.when(F.length(c) >= digits, c).otherwise(F.lpad(c, digits, "0"))
    read = F.coalesce(wide(F.col("number").cast("string")) == wide(F.col("_r")), F.lit(False))
    return met.select("key", "reason", (ok & sure).alias("serial_ok"), read.alias("reading_ok"), ((sure & ~ok) | (F.col("number").isNotNull() & ~read)).alias("wrong_sure"))
