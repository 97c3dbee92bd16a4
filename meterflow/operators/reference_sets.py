"""Reference sets (etalons): answers drawn to quotas, added once, and kept out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str) -> Column:
    """The place of a key in the draw: the same on every cluster, in every order and cut of the rows."""
    return F.sha2(F.concat(F.lit(seed), F.col("key")), 256)


def to_quota(rows: DataFrame, quotas: DataFrame, most: int, seed: str = "") -> DataFrame:
    """Of the rows (key, stratum, ...) of each stratum the first of the draw, as many as quotas (stratum, quota) says, all if there are fewer.

    Keys are distinct. No quota is above `most`; every task keeps so many rows of a stratum before they are dealt, so a
    stratum of most rows is no group of that size. Strata without a quota give no rows.
    """
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(draw(seed), "key"))
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    return first.join(quotas, "stratum").where(F.col("place") <= F.col("quota")).drop("place", "quota")


def added(known: DataFrame, answers: DataFrame, quotas: DataFrame, most: int, seed: str = "") -> DataFrame:
    """The set after answers (key, stratum, answer, last) are added to known ones of the same columns, with `state`.

    A key that the set has stays; where it has no `last` and the answer has one, that is filled in (filled, else kept).
    Of the others each stratum gets as many as its quota still lacks, drawn by hash (added). Of several answers of a key
    the least counts. Adding the same answers again changes nothing.
    """
    fresh = answers.where("key is not null").groupBy("key").agg(F.min(F.struct("stratum", "answer", "last")).alias("a")).select("key", "a.*")
    met = known.join(fresh.select("key", F.col("last").alias("_last")), "key", "left")
    fills = (F.coalesce("last", F.lit("")) == "") & (F.coalesce("_last", F.lit("")) != "")
    old = met.select("key", "stratum", "answer", F.when(fills, F.col("_last")).otherwise(F.col("last")).alias("last"), F.when(fills, "filled").otherwise("kept").alias("state"))
    have = known.groupBy("stratum").agg(F.count(F.lit(1)).alias("have"))
    left = quotas.join(have, "stratum", "left").select("stratum", F.greatest(F.lit(0), F.col("quota") - F.coalesce("have", F.lit(0))).alias("quota"))
    new = to_quota(fresh.join(known.select("key"), "key", "left_anti"), left, most, seed)
    return old.unionByName(new.select("key", "stratum", "answer", "last", F.lit("added").alias("state")))


def kept_apart(files: DataFrame, accounts: DataFrame, apart: str = "apart/") -> DataFrame:
    """(path, target, moves) of the files (path, account) of the reference accounts: moved under `apart`, unless a file is there already.

    A file with `label_of` (the path of the picture that a label file belongs to) moves with that picture or not at all.
    """
    rows = files if "label_of" in files.columns else files.withColumn("label_of", F.lit(None).cast("string"))
    mine = rows.join(accounts.select("account").distinct(), "account", "left_semi").where(~F.startswith("path", F.lit(apart)))
    mine = mine.select("path", F.coalesce("label_of", "path").alias("group"), F.concat(F.lit(apart), "path").alias("target"))
    there = rows.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    taken = mine.join(there, "target").select("group").distinct().withColumn("_taken", F.lit(True))
    return mine.join(taken, "group", "left").select("path", "target", F.col("_taken").isNull().alias("moves"))
