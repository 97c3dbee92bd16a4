"""Photos and the rows that the log has about them: which row made a file, what is known of a photo, what waits for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compared_account
from .lookups import pick_last
from .states import DONE

COPY_NOTE = "copy of"
#: Automatic outcomes after which an operator's answer is one of the hard ones.
FAILED = ("NO_METER", "NO_SERIAL", "SERIAL_LOW_CONF", "SERIAL_NOT_FOUND", "SERIAL_AMBIGUOUS", "DIGITS_ERROR", "SUSPICIOUS", "ERROR")
#: Outcomes of a photo that waits until its account has a reading.
WAITING = ("DIGITS_ERROR", "SUSPICIOUS")


def meaningful(log: DataFrame) -> DataFrame:
    """Rows that say something of the photo itself, which notes of copies don't."""
    return log.where(~F.coalesce("notes", F.lit("")).startswith(COPY_NOTE))


def shown_name() -> Column:
    """The name under which a row's photo was written: the final one, or the original where there is none."""
    return F.coalesce(F.nullif(F.col("final_name"), F.lit("")), F.col("name"))


def output_rows(files: DataFrame, log: DataFrame) -> DataFrame:
    """For each file (file_name, folder) the automatic row that wrote it, as seq: the last of its folder, else the last without folder.

    Rows of other folders are no match, so that a file may stay without a row and is then not returned.
    """
    rows = log.where("source = 'auto'").select(shown_name().alias("file_name"), F.col("folder").alias("row_folder"), "seq")
    met = files.join(rows, "file_name").where("row_folder in (folder, '')")
    return pick_last(met, ["folder", "file_name"], (F.col("row_folder") == "") & (F.col("folder") != ""), F.desc("seq")).select("folder", "file_name", "seq")


def verify_rows(files: DataFrame, log: DataFrame) -> DataFrame:
    """For each file (file_name, folder, outcome) the unverified automatic row to check, by either name or its stem.

    Rows of the file's own folder come first, then any; of several the last. The four keys of a row are exploded, so
    that the disjunction is an equi-join.
    """
    stem = lambda c: F.regexp_replace(c, "[.][^.]*$", "")
    keys = F.array_distinct(F.array(F.col("name"), F.col("final_name"), stem("name"), stem("final_name")))
    open_ = log.where("source = 'auto' and verified_by = '' and outcome in ('PLUS', 'MINUS')")
    rows = open_.select("seq", "outcome", F.col("folder").alias("row_folder"), F.explode(F.filter(keys, lambda k: k != "")).alias("key"))
    asked = files.select("*", F.explode(F.array_distinct(F.array(F.col("file_name"), stem("file_name")))).alias("key"))
    met = asked.join(rows, ["key", "outcome"])
    return pick_last(met, ["file_name", "folder", "outcome"], F.col("row_folder") != F.col("folder"), F.desc("seq")).select("file_name", "folder", "outcome", "seq")


def processed(photos: DataFrame, log: DataFrame) -> DataFrame:
    """(photo, skip, reason, row): whether a photo (photo, name, photo_hash) has been dealt with already.

    An operator's row decides first, then a finished automatic one; the last of them is returned. Errors of the models
    alone do not close a photo. Rows are found by hash where both sides have one, else by name. The log is folded to a
    row for each hash and each name before photos meet it, so that no photo is multiplied by the rows of its name.
    """
    last = lambda when: F.when(when, F.col("seq"))
    marked = meaningful(log).select(F.col("name").alias("row_name"), F.col("photo_hash").alias("row_hash"), last(F.col("source") == "manual").alias("_m"), last(F.col("outcome").isin(*DONE)).alias("_d"))
    marked = marked.where("_m is not null or _d is not null")
    of_hash = marked.where("row_hash <> ''").groupBy("row_hash").agg(F.max("_m").alias("_m"), F.max("_d").alias("_d"))
    bare = lambda c: F.max(F.when(F.col("row_hash") == "", F.col(c)))
    of_name = marked.groupBy("row_name").agg(F.max("_m").alias("_ma"), F.max("_d").alias("_da"), bare("_m").alias("_mb"), bare("_d").alias("_db"))
    by_hash = photos.where("photo_hash <> ''").join(of_hash, F.expr("photo_hash = row_hash")).select("photo", "_m", "_d")
    either = lambda a, b: F.when(F.col("photo_hash") == "", F.col(a)).otherwise(F.col(b))
    by_name = photos.join(of_name, F.expr("name = row_name")).select("photo", either("_ma", "_mb").alias("_m"), either("_da", "_db").alias("_d"))
    known = by_hash.unionByName(by_name).groupBy("photo").agg(F.max("_m").alias("_m"), F.max("_d").alias("_d"))
    met = photos.join(known, "photo", "left")
    reason = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_d").isNotNull(), "done")
    return met.select("photo", reason.isNotNull().alias("skip"), reason.alias("reason"), F.coalesce("_m", "_d").alias("row"))


def duplicates(reads: DataFrame, log: DataFrame) -> DataFrame:
    """reads (photo, account, filled, in_run) with decided: REPEAT, SUSPICIOUS, or null where the reading is to be taken.

    In this order: the account has been read in this run; it has no reading yet; its reading was there before the log;
    the log has a PLUS or MINUS of it; else table and log disagree. Accounts are compared as numbers.
    """
    flags = log.groupBy(compared_account(F.trim("account")).alias("_a")).agg(
        F.bool_or(F.col("source") == "pre_existing").alias("_pre"), F.bool_or(F.col("outcome").isin("PLUS", "MINUS")).alias("_read")
    )
    met = reads.withColumn("_a", compared_account(F.trim("account"))).join(flags, "_a", "left")
    known = F.coalesce("_pre", F.lit(False)) | F.coalesce("_read", F.lit(False))
    return met.withColumn("decided", F.when(F.col("in_run"), "REPEAT").when(~F.col("filled"), F.lit(None)).when(known, "REPEAT").otherwise("SUSPICIOUS")).drop("_a", "_pre", "_read")


def hard_answers(log: DataFrame, corrected_note: str = "corrected at check") -> DataFrame:
    """(key, serial, reading, reason): photos on which the models failed or were corrected, with the operator's answer.

    A photo is its hash, or folder and name where it has none. After a failure the last manual PLUS or MINUS is the
    answer and the last failure the reason; else the last corrected row is both. Answers without serial are left out.
    """
    key = F.coalesce(F.nullif(F.trim("photo_hash"), F.lit("")), F.concat(F.lit("name:"), F.col("folder"), F.lit("/"), F.col("name")))
    good = F.col("outcome").isin("PLUS", "MINUS")
    failed = (F.col("source") == "auto") & F.col("outcome").isin(*FAILED)
    answer = (F.col("source") == "manual") & good
    corrected = (F.col("source") == "auto") & good & F.coalesce("notes", F.lit("")).contains(corrected_note)
    last = lambda when: F.max_by(F.when(when, F.struct("serial", "reading", "outcome")), F.when(when, F.col("seq")))
    by = log.groupBy(key.alias("key")).agg(last(failed).alias("f"), last(answer).alias("m"), last(corrected).alias("c"))
    hard = F.col("f").isNotNull() & F.col("m").isNotNull()
    pick = F.when(hard, F.struct(F.col("m.serial"), F.col("m.reading"), F.col("f.outcome").alias("reason"))).when(
        F.col("c").isNotNull(), F.struct(F.col("c.serial"), F.col("c.reading"), F.lit("CORRECTED").alias("reason"))
    )
    return by.select("key", pick.alias("x")).where("x is not null and trim(x.serial) <> '' and x.reading is not null").select("key", "x.*")


def closed_by(readings: DataFrame, log: DataFrame) -> DataFrame:
    """(key, account, seq): photos that stop waiting as their account (readings.account) got a reading, each once.

    Only photos whose last meaningful row is still such an error of the same account are closed; each becomes a REPEAT.
    """
    key = F.coalesce(F.nullif(F.col("photo_hash"), F.lit("")), F.concat(F.lit("name:"), F.col("name")))
    last = pick_last(meaningful(log).withColumn("key", key), ["key"], F.desc("seq"))
    waiting = last.where(F.col("outcome").isin(*WAITING)).select("key", "account", "seq")
    return waiting.join(readings.select("account").distinct(), "account", "left_semi").select("key", "account", "seq")


def answered_failures(log: DataFrame, outcome: str = "SERIAL_NOT_FOUND") -> DataFrame:
    """Manual rows joined with the last automatic row of their hash, where that has this outcome: auto_seq, serial, model_reading, manual_seq, manual_outcome, manual_serial."""
    auto = pick_last(log.where("source = 'auto' and photo_hash <> ''"), ["photo_hash"], F.desc("seq")).where(F.col("outcome") == outcome)
    auto = auto.select("photo_hash", F.col("seq").alias("auto_seq"), "serial", "model_reading")
    manual = log.where("source = 'manual' and photo_hash <> ''").select("photo_hash", F.col("seq").alias("manual_seq"), F.col("outcome").alias("manual_outcome"), F.col("serial").alias("manual_serial"))
    return manual.join(auto, "photo_hash").drop("photo_hash")


def new_answers(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Answers whose key is not among the known ones."""
    return answers.join(known.select("key").distinct(), "key", "left_anti")


def refilled(known: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """known (key, ...) with empty values of one column taken from the answers of the same key."""
    fresh = answers.groupBy("key").agg(F.max(column).alias("_new"))
    empty = F.coalesce(F.col(column).cast("string"), F.lit("")) == ""
    return known.join(fresh, "key", "left").withColumn(column, F.when(empty, F.col("_new")).otherwise(F.col(column))).drop("_new")


def found_files(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Answers (key, file, folder, photo_hash) with the path of their file: the one in their folder if its hash agrees, else the first path with the hash."""
    guess = files.select("folder", F.col("name").alias("file"), F.col("path").alias("_near"), F.col("photo_hash").alias("_hash"))
    any_ = files.groupBy("photo_hash").agg(F.min("path").alias("_first"))
    met = answers.join(guess, ["folder", "file"], "left").join(any_, "photo_hash", "left")
    return met.select(*answers.columns, F.when(F.col("_hash") == F.col("photo_hash"), F.col("_near")).otherwise(F.col("_first")).alias("path"))
