"""Ordered folds over the append-only log; `seq` is the order of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import pick_last

DONE = ("PLUS", "MINUS", "REPEAT")


def folders_backfilled(log: DataFrame) -> DataFrame:
    """Rows without a folder take that of their name where the log knows just one."""
    known = log.where("folder <> ''").groupBy("name").agg(F.min("folder").alias("_low"), F.max("folder").alias("_high")).where("_low = _high")
    filled = F.when(F.col("folder") == "", F.coalesce("_low", F.lit(""))).otherwise(F.col("folder"))
    return log.join(known, "name", "left").withColumn("folder", filled).drop("_low", "_high")


def last_state(log: DataFrame) -> DataFrame:
    """Each photo's last row that is no REPEAT, or else its last REPEAT."""
    return pick_last(log, ["folder", "name"], F.col("outcome") == "REPEAT", F.desc("seq"))


def photo_state(log: DataFrame) -> DataFrame:
    """done, error or waiting for each photo, by its last row that is not a note of a copy."""
    rows = log.where(~F.coalesce("notes", F.lit("")).startswith("copy of"))
    last = pick_last(rows, ["folder", "name"], F.desc("seq"))
    state = F.when((F.col("source") == "manual") & (F.col("outcome") == "NOT_IN_DB"), "not_in_db").when((F.col("source") == "manual") | F.col("outcome").isin(*DONE), "done").when(F.col("outcome") == "ERROR", "error").otherwise("waiting")
    return last.select("folder", "name", state.alias("state"))


def selection(photos: DataFrame, states: DataFrame, reread: bool = False) -> DataFrame:
    """read, skip_done, skip_waiting or skip_copy for each photo (folder, name, photo_hash, known): copies of a hash that is read are skipped."""
    met = photos.join(states, ["folder", "name"], "left").withColumn("state", F.coalesce("state", F.lit("new")))
    wanted = F.when(F.col("state").isin("new", "error"), "read").when(F.col("state") == "done", "skip_done")
    wanted = wanted.when(F.col("state") == "not_in_db", F.when(F.col("known"), "read").otherwise("skip_waiting")).when(F.lit(reread) | F.col("known"), "read").otherwise("skip_waiting")
    met = met.withColumn("choice", wanted)
    alike = F.when(F.col("photo_hash") == "", F.concat("folder", F.lit("/"), "name")).otherwise(F.col("photo_hash"))  # photos without hash are no group
    order = Window.partitionBy(alike, F.col("photo_hash") == "", F.col("choice") == "read").orderBy("folder", "name")
    copy = (F.col("choice") == "read") & (F.col("photo_hash") != "") & (F.row_number().over(order) > 1)
    return met.withColumn("choice", F.when(copy, "skip_copy").otherwise(F.col("choice")))


def outcome_counts(states: DataFrame) -> DataFrame:
    """Counts and shares of the outcomes in each folder, and over all folders (folder null), from one pass."""
    counts = states.groupingSets([["folder", "outcome"], ["outcome"]], "folder", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("folder")))


def unique_names(files: DataFrame) -> DataFrame:
    """target: a file's name, with _2, _3 ... before the extension for further files of that name in the folder."""
    n = F.row_number().over(Window.partitionBy("folder", "name").orderBy("seq"))
    stem, ext = F.regexp_extract("name", r"^(.*?)([.][^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)([.][^.]*)?$", 2)
    return files.withColumn("target", F.when(n == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def first_success(log: DataFrame) -> DataFrame:
    """Of an account's PLUS and MINUS rows the first stays; later ones become REPEAT, as a run in order decides them.

    Only those rows are dealt by account: failed ones, which mostly have none and would be one group, keep their place.
    """
    good: Column = F.coalesce(F.col("outcome").isin("PLUS", "MINUS"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("account").orderBy("seq"))
    decided = log.where(good).withColumn("decided", F.when(n > 1, "REPEAT").otherwise(F.col("outcome")))
    return decided.unionByName(log.where(~good).withColumn("decided", F.col("outcome")))


def log_row(results: DataFrame) -> DataFrame:
    """Results as the text of a log row: the confidence with four places, and notes joined by ' | ' without empty parts."""
    parts = [F.nullif(F.col("notes"), F.lit("")), F.when(F.col("verified_by") != "", "verified")]
    return results.withColumn("conf", F.coalesce(F.format_string("%.4f", "conf"), F.lit(""))).withColumn("notes", F.concat_ws(" | ", *parts))
