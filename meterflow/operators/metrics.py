"""Quality and evaluation measures over predictions and the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_sweep(predictions: DataFrame, thresholds: list[float], slack: float = 1e-9) -> DataFrame:
    """Rows accepted and wrong at each confidence threshold: each row is exploded to the thresholds that it passes, and counted before the shuffle."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("conf") >= t - slack)
    counts = predictions.select("ok", F.explode(passed).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(~F.col("ok")).alias("wrong"))
    every = predictions.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return every.join(counts, "threshold", "left").select("threshold", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("wrong", F.lit(0)).alias("wrong"))


def text_accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact matches and character error rate of (read, true) by key: edits over the greater of 1 and the true length, each summed."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("read") == F.col("true"), 1.0).otherwise(0.0)).alias("exact"),
        (F.sum(F.levenshtein("read", "true")) / F.sum(F.greatest(F.length("true"), F.lit(1)))).alias("cer"),
    )


def position_accuracy(pairs: DataFrame) -> DataFrame:
    """Per position of the true text, how many texts reach it and how many have the right character there."""
    at = pairs.where(F.length("true") > 0).select("read", "true", F.explode(F.sequence(F.lit(1), F.length("true"))).alias("position"))
    right = F.substring("read", F.col("position"), F.lit(1)) == F.substring("true", F.col("position"), F.lit(1))
    return at.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(true_digit, read_digit, n) over texts of equal length."""
    at = pairs.where((F.length("read") == F.length("true")) & (F.length("true") > 0)).select("read", "true", F.explode(F.sequence(F.lit(1), F.length("true"))).alias("p"))
    return at.groupBy(F.substring("true", F.col("p"), F.lit(1)).alias("true_digit"), F.substring("read", F.col("p"), F.lit(1)).alias("read_digit")).agg(F.count(F.lit(1)).alias("n"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, by equal keys; null keys are equal."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])


def quartiles(rows: DataFrame, keys: list[str], value: str, ranges: int = 1024) -> DataFrame:
    """Exact quartiles by the exclusive method for keys of at least four values.

    A key's values are reduced to (value, count) and dealt into ranges between its least and greatest. Ranks are running
    counts within a range, after the sum of the ranges before it, so that a key with most of the rows is ranked by many
    tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.groupBy(*keys).agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.sum("c").alias("n")).where("n >= 4")
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * ranges), F.lit(ranges - 1))).otherwise(0)
    placed = _matched(counts, ends, keys).withColumn("_r", place)
    sizes = placed.groupBy(*keys, "_r").agg(F.sum("c").alias("_s"))
    before = sizes.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_r")) - F.col("_s")).drop("_s")  # at most `ranges` rows a key
    ranked = _matched(placed, before, [*keys, "_r"]).withColumn("high", F.col("_before") + F.sum("c").over(Window.partitionBy(*keys, "_r").orderBy("v")))
    at = lambda j: F.min(F.when(F.col("high") >= j, F.col("v")))
    out = []
    for i in (1, 2, 3):
        spot = F.lit(i) * (F.col("n") + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(spot / 4), F.col("n") - 1))
        out += [at(j).alias(f"_a{i}"), at(j + 1).alias(f"_b{i}"), F.first(spot - j * 4).alias(f"_p{i}")]
    cut = lambda i: ((F.col(f"_a{i}") * (4 - F.col(f"_p{i}")) + F.col(f"_b{i}") * F.col(f"_p{i}")) / 4).alias(f"q{i}")
    return ranked.groupBy(*keys, "n").agg(*out).select(*keys, "n", cut(1), cut(2), cut(3))


def group_logsumexp(rows: DataFrame, key: str, value: str) -> DataFrame:
    """log of the sum of exp by key, shifted by the key's maximum; minus infinity if all are."""
    top = rows.groupBy(key).agg(F.max(value).alias("_top"))
    shifted = F.when(F.col("_top") == float("-inf"), F.lit(0.0)).otherwise(F.exp(F.col(value) - F.col("_top")))
    sums = rows.join(top, key).groupBy(key, "_top").agg(F.sum(shifted).alias("_s"))
    return sums.select(key, F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.log("_s") + F.col("_top")).alias("logsumexp"))


def duplicate_contents(files: DataFrame) -> DataFrame:
    """(sha256, copies, labels) of contents that occur more than once; only contents whose size repeats are hashed."""
    sized = files.withColumn("_size", F.length("content"))
    sizes = sized.groupBy("_size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_size")
    hashed = sized.join(sizes, "_size", "left_semi").select(F.sha2("content", 256).alias("sha256"), "label")
    found = hashed.groupBy("sha256", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("sha256").agg(F.sum("c").alias("copies"), F.count(F.lit(1)).alias("labels"))
    return found.where("copies > 1")


def quantile_range(rows: DataFrame, value: str, parts: int = 20) -> DataFrame:
    """(low, high): the first and last of parts - 1 exclusive cuts of all values, null below `parts` values.

    Values are counted in 1024 ranges first; only the ranges that hold a wanted rank are sorted, so that no task orders
    the whole column.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    low, high, n = counts.agg(F.min("v"), F.max("v"), F.sum("c")).first()  # three numbers
    if n is None or n < parts:
        return rows.sparkSession.createDataFrame([(None, None)], "low double, high double")
    bucket = F.least(F.floor((F.col("v") - low) / ((high - low) or 1.0) * 1024), F.lit(1023))
    placed = counts.withColumn("k", bucket)
    sizes = placed.groupBy("k").agg(F.sum("c").alias("s"))
    before = sizes.withColumn("before", F.sum("s").over(Window.orderBy("k")) - F.col("s")).select("k", "before")  # at most 1024 rows
    ranked = placed.join(F.broadcast(before), "k").withColumn("high", F.col("before") + F.sum("c").over(Window.partitionBy("k").orderBy("v")))
    cuts = []
    for name, i in (("low", 1), ("high", parts - 1)):
        j = max(1, min(i * (n + 1) // parts, n - 1))
        part = i * (n + 1) - j * parts
        at = lambda rank: F.min(F.when(F.col("high") >= rank, F.col("v")))
        cuts.append(((at(j) * (parts - part) + at(j + 1) * part) / parts).alias(name))
    return ranked.agg(*cuts)
