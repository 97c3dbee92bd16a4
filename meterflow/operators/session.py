"""An operator's session as one table of decisions, from which the log rows, readings, changes and serials are derived.

A decision is (seq, name, kind, serial, account, reading, outcome): kind is accept, serial_fix, duplicate, unreadable or
not_in_db; outcome is what the change of the reading suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import latest_fixes, readings_after
from .lookups import ordered

#: Kinds that take a reading, and what the others write as outcome.
TAKES = ("accept", "serial_fix")
OUTCOMES = {"duplicate": "REPEAT", "unreadable": "UNREADABLE", "not_in_db": "NOT_IN_DB"}


def log_rows(decisions: DataFrame, register: DataFrame) -> DataFrame:
    """(seq, name, serial, account, reading, last, delta, outcome, source, notes): a manual row for each decision.

    A suspicious change that the operator has confirmed becomes PLUS or MINUS by its sign, PLUS without a last reading.
    Only readings that are taken have numbers; duplicates and unreadable photos have no account.
    """
    takes = F.col("kind").isin(*TAKES)
    lasts = register.groupBy(F.col("account").alias("_a")).agg(F.max("last").alias("_last"))
    met = decisions.join(lasts, F.when(takes, F.col("account")) == F.col("_a"), "left")
    delta = F.when(takes, F.col("reading") - F.col("_last"))
    sign = F.when(F.coalesce(delta, F.lit(0)) >= 0, "PLUS").otherwise("MINUS")
    outcome = F.when(takes, F.when(F.col("outcome") == "SUSPICIOUS", sign).otherwise(F.col("outcome")))
    for kind, own in OUTCOMES.items():
        outcome = F.when(F.col("kind") == kind, own).otherwise(outcome)
    named = takes | (F.col("kind") == "not_in_db")
    shown: Column = F.when(named, F.coalesce("serial", F.lit(""))).otherwise("")
    return met.select(
        "seq", "name", shown.alias("serial"), F.when(takes, F.col("account")).otherwise("").alias("account"), F.when(takes, F.col("reading")).alias("reading"), F.when(takes, F.col("_last")).alias("last"),
        delta.alias("delta"), outcome.alias("outcome"), F.lit("manual").alias("source"), F.when(F.col("kind") == "not_in_db", "meter is not in the register").otherwise("").alias("notes"),
    )


def tables_after(decisions: DataFrame, register: DataFrame, readings: DataFrame) -> DataFrame:
    """(account, serial, value) of every register account: its serial after the fixes and its reading after the accepted values.

    Decisions on accounts that the register has not got are log rows only. Of several, the last holds.
    """
    taken = decisions.where(F.col("kind").isin(*TAKES)).join(register.select("account").distinct(), "account", "left_semi")
    values = readings_after(readings.withColumn("source", F.lit("table")), taken.select("seq", "account", F.col("reading").alias("value"), F.lit("").alias("date"))).select("account", "value")
    fixes = latest_fixes(taken.where("kind = 'serial_fix'").select("account", F.col("seq").alias("id"), F.col("serial").alias("new"))).select("account", F.col("serial").alias("_fixed"))
    met = register.join(fixes, "account", "left").join(values, "account", "left")
    return met.select("account", F.coalesce("_fixed", "serial").alias("serial"), "value")


def log_where(log: DataFrame, account: str | None = None, outcomes: tuple[str, ...] | None = None, source: str | None = None, photo_hash: str | None = None, name: str | None = None) -> DataFrame:
    """The log rows of an account, of some outcomes, of a source, or of a photo: by its hash, and by name where the row has none."""
    rows = log
    if account is not None:
        rows = rows.where(F.col("account") == account)
    if outcomes is not None:
        rows = rows.where(F.col("outcome").isin(*outcomes))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if photo_hash:
        rows = rows.where((F.col("photo_hash") == photo_hash) | ((F.coalesce("photo_hash", F.lit("")) == "") & (F.col("name") == (name or ""))))
    elif name is not None:
        rows = rows.where(F.col("name") == name)
    return rows


def queued(rows: DataFrame, groups: list[Column], key: str) -> DataFrame:
    """rows with `place` in the order of the groups and, inside one, of the key; a group of most rows is sorted by many tasks."""
    names = [f"_g{k}" for k in range(len(groups))]
    return ordered(rows.withColumns(dict(zip(names, groups))), *names, key).drop(*names)


def report(log: DataFrame) -> DataFrame:
    """(section, name, n): rows and automatic rows, the outcomes, photos and successes of each folder, in one pass over the last rows."""
    good = F.col("outcome").isin("PLUS", "MINUS")
    sets = log.groupingSets([["source"], ["outcome"], ["folder"]], "source", "outcome", "folder").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "outcome").otherwise("folder")
    name = F.when(F.col("g") == 3, F.col("source")).when(F.col("g") == 5, F.col("outcome")).otherwise(F.col("folder"))
    return sets.select(section.alias("section"), name.alias("name"), "n", F.when(F.col("g") != 5, F.col("good")).alias("good"))
