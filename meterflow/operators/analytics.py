"""Measures of the log and of checks on it: one pass each, counted before the shuffle, in long form (metric, key, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ_OK = ("PLUS", "MINUS", "SUSPICIOUS")
FOUND = (*READ_OK, "DIGITS_ERROR")
#: Positions, digits and confidences in a note on unsure digits.
LOW_CONF = r"pos([0-9]+)\(pred=([0-9]),conf=([0-9.]+)\)"


def _counted(rows: DataFrame, facts: Column) -> DataFrame:
    """Counts of the facts (metric, key) that each row gives."""
    return rows.select(F.explode(facts).alias("f")).groupBy("f.metric", "f.key").agg(F.count(F.lit(1)).alias("n"))


def _fact(metric: str, key: Column, when: Column | None = None) -> Column:
    fact = F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    return F.array(F.when(F.lit(True) if when is None else when, fact))


def _facts(*parts: Column) -> Column:
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def digit_stats(photos: DataFrame) -> DataFrame:
    """(metric, key, n) of photos (outcome, model_reading, notes): unsure positions, predicted digits, kinds of errors, first digits.

    with_reading, with_unsure and only_first_unsure have an empty key; unsure_at and low_conf_at a position from 0;
    low_conf_first a digit; error one of low_conf, count or none; first_digit the first character of those read.
    """
    reading, notes, none = F.coalesce("model_reading", F.lit("")), F.coalesce("notes", F.lit("")), F.lit("")
    chars = F.when(reading != "", F.sequence(F.lit(0), F.length(reading) - 1)).otherwise(F.array().cast("array<int>"))
    unsure = F.transform(F.filter(chars, lambda i: F.substring(reading, i + 1, F.lit(1)) == "?"), lambda i: F.struct(F.lit("unsure_at").alias("metric"), i.cast("string").alias("key")))
    at = F.regexp_extract_all(notes, F.lit(LOW_CONF), F.lit(1))
    digit = F.regexp_extract_all(notes, F.lit(LOW_CONF), F.lit(2))
    low = F.transform(at, lambda p: F.struct(F.lit("low_conf_at").alias("metric"), p.alias("key")))
    first = F.zip_with(at, digit, lambda p, d: F.when(p == "0", F.struct(F.lit("low_conf_first").alias("metric"), d.alias("key"))))
    error = F.when(notes.startswith("low conf"), "low_conf").when(notes != "", "count").otherwise("none")
    facts = _facts(
        _fact("with_reading", none, reading != ""),
        _fact("with_unsure", none, F.contains(reading, F.lit("?"))),
        _fact("only_first_unsure", none, F.startswith(reading, F.lit("?")) & ~F.contains(F.substring(reading, 2, 1000), F.lit("?"))),
        unsure, low, first,
        _fact("error", error, F.col("outcome") == "DIGITS_ERROR"),
        _fact("first_digit", F.substring(reading, 1, 1), F.col("outcome").isin(*READ_OK) & (reading != "")),
    )
    return _counted(photos, facts)


def serial_lengths(photos: DataFrame, typical: int = 3) -> DataFrame:
    """(found, len, n, typical) of photos (outcome, serial, seq): whether the length is among the `typical` commonest of the found, of equal ones the earlier seen."""
    state = F.when(F.col("outcome").isin(*FOUND), True).when(F.col("outcome") == "SERIAL_NOT_FOUND", False)
    by = photos.select(state.alias("found"), F.length("serial").alias("len"), "seq").where("found is not null")
    by = by.groupBy("found", "len").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("_first"))
    top = by.where("found").orderBy(F.desc("n"), "_first").limit(typical).select("len", F.lit(True).alias("typical"))  # a few lengths
    return by.join(F.broadcast(top), "len", "left").select("found", "len", "n", F.coalesce("typical", F.lit(False)).alias("typical"))


def operator_accuracy(log: DataFrame, corrected_note: str = "corrected at check") -> DataFrame:
    """One row of counts: verified rows, those whose reading stayed, corrected ones, and how often the models agree with manual readings."""
    as_int = F.col("model_reading").try_cast("bigint")
    verified = (F.col("source") == "auto") & (F.col("verified_by") != "")
    counted = verified & F.col("outcome").isin(*READ_OK)
    full = (F.col("source") == "manual") & F.col("reading").isNotNull() & (F.col("model_reading") != "") & ~F.contains("model_reading", F.lit("?"))
    return log.agg(
        F.count_if(counted).alias("verified"),
        F.count_if(verified & ~F.col("outcome").isin(*READ_OK)).alias("verified_other"),
        F.count_if(counted & F.col("reading").eqNullSafe(as_int)).alias("reading_ok"),
        F.count_if(counted & F.contains("notes", F.lit(corrected_note))).alias("corrected"),
        F.count_if(F.col("source") == "manual").alias("manual"),
        F.count_if(full).alias("manual_full"),
        F.count_if(full & F.col("reading").eqNullSafe(as_int)).alias("manual_ok"),
    )


def month_summary(register: DataFrame, readings: DataFrame) -> DataFrame:
    """One row: accounts in the table, with readings from automatic and manual rows, without, and removed ones. readings: account, source, one row each."""
    met = register.join(readings.select("account", "source"), "account", "left")
    here = F.col("in_table")
    return met.agg(
        F.count_if(here).alias("in_table"),
        F.count_if(here & (F.col("source") == "auto")).alias("auto"),
        F.count_if(here & (F.col("source") == "manual")).alias("manual"),
        F.count_if(here & F.col("source").isNull()).alias("without"),
        F.count_if(~here).alias("removed"),
    )


def check_summary(checks: DataFrame) -> DataFrame:
    """(reason, n, serial_ok, reading_ok, all_ok, wrong_sure) by reason, and over all (reason ALL), from one pass."""
    good = F.col("serial_ok") & F.col("reading_ok")
    by = checks.rollup("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("serial_ok").alias("serial_ok"), F.count_if("reading_ok").alias("reading_ok"), F.count_if(good).alias("all_ok"), F.count_if("wrong_sure").alias("wrong_sure"), F.grouping_id().alias("_all")
    )
    return by.withColumn("reason", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("reason"))).drop("_all")


def angle_bins(rows: DataFrame, angle: str, edges: tuple[float, ...] = (1, 2, 5, 10, 20, 45), slack: float = 1e-9) -> DataFrame:
    """(bin, n): bin is the first edge that the size of the angle stays below, null beyond the last; edges belong to the next bin but for the slack."""
    size = F.abs(F.col(angle))
    bin_ = F.coalesce(*[F.when(size < e - slack, F.lit(float(e))) for e in edges])
    return rows.where(size.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def common(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, n, place): counts from the commonest on; of equal ones the earlier seen comes first. Ranks the counts, not the rows."""
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).cast("bigint")).drop("_first")


def fingerprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, fingerprint): 16 hex digits for each dataset, whatever the order of its files (path, size).

    Each line's SHA-256 is cut into numbers of 48 bits, these are summed, and the sums are hashed: a data set of any size
    is folded by partial sums.
    """
    hashed = F.sha2(F.concat("path", F.lit("\t"), F.col("size").cast("string"), F.lit("\n")), 256)
    number = lambda k: F.conv(F.substring(hashed, 12 * k + 1, 12), 16, 10).cast("decimal(20,0)")
    sums = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *[F.sum(number(k)).alias(f"_{k}") for k in range(4)])
    whole = F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"_{k}").cast("string") for k in range(4)])
    return sums.select(*keys, "files", F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


def nearest_variant(rows: DataFrame, keys: list[str]) -> DataFrame:
    """exact and cer of reads against variants (an array): exact if it is one; errors are those to the nearest, the first of equals."""
    distance = F.transform("variants", lambda v: F.struct(F.levenshtein(F.col("read"), v).alias("d"), F.greatest(F.length(v), F.lit(1)).alias("n")))
    best = F.element_at(F.filter(distance, lambda x: x["d"] == F.array_min(F.transform(distance, lambda y: y["d"]))), 1)
    met = rows.select(*keys, F.array_contains("variants", F.col("read")).alias("ok"), best.alias("b"))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("exact"), (F.sum("b.d") / F.sum("b.n")).alias("cer"))


def suspects(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Rows that are wrong although the model is sure: labels to look at."""
    return rows.where((F.col("read") != F.col("true")) & (F.col("conf") >= least))


def best_epoch(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, best, last, stale) of rows (epoch, accuracy, cer): the epoch of the best accuracy, then the least error, then the earliest, and the epochs since."""
    best = F.max_by("epoch", F.struct("accuracy", (-F.col("cer")).alias("c"), (-F.col("epoch")).alias("e")))
    by = history.groupBy(*keys).agg(best.alias("best"), F.max("epoch").alias("last"))
    return by.withColumn("stale", F.col("last") - F.col("best"))


def only_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value of keys that have just one, null for others."""
    return rows.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def random_serials(session, n: int, lengths: list[int], seed: int) -> DataFrame:
    """(serial): n made-up serials of these lengths, the same for the same seed on any cluster."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    digits = F.translate(h, "abcdef", "012345")
    size = F.element_at(F.array(*[F.lit(x) for x in lengths]), (F.col("id") % len(lengths) + 1).cast("int"))
    return session.range(n).select(F.substring(digits, F.lit(1), size).alias("serial"))
