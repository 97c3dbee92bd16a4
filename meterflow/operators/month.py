"""A run of the month as one plan: which photos are read, what the log gets of each, and which waiting photos a reading closes.

A photo is its hash, or its name where it has none (`key`). What is known of it is its last row in the log that is no note
of a copy; a run reads it if there is none, after an ERROR, and again once the register has the serial that was not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import Limits, decided
from .lineage import cut
from .lookups import in_register, pick_last
from .photos import WAITING, meaningful
from .states import DONE

#: Numbers of photos, and of the rows of the log before the month, have so many bits in the numbers of a run's rows.
BITS, CLOSED_NOTE = 38, "closed: the account has a reading"
#: A log row of a run. `closes` is the number of the row that a REPEAT closes.
ROW = "seq long, photo long, name string, photo_hash string, serial string, account string, last double, reading long, delta double, outcome string, detail string, source string, notes string, closes long"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def photo_key() -> Column:
    return F.coalesce(F.nullif(F.col("photo_hash"), F.lit("")), F.concat(F.lit("name:"), F.col("name")))


def last_rows(log: DataFrame) -> DataFrame:
    """(key, seq, photo, source, outcome, serial, account, name, photo_hash) of each photo's last meaningful row; photo is null in rows from before the month."""
    columns = ["key", "seq", "photo", "source", "outcome", "serial", "account", "name", "photo_hash"]
    rows = log if "photo" in log.columns else log.withColumn("photo", F.lit(None).cast("long"))
    return pick_last(meaningful(rows).withColumn("key", photo_key()).select(*columns), ["key"], F.desc("seq"))


def wanted(known: DataFrame, register: DataFrame, reread: bool = False) -> DataFrame:
    """known (last_rows) with choice: read, skip_done or skip_waiting for a photo of which this is the last row.

    An operator's row is the end of a photo, unless it says that the meter is not in the register and the register has
    it by now. With reread all photos that wait are read again.
    """
    met = in_register(known, register, "serial")
    found = F.col("found") & (F.coalesce(F.trim("serial"), F.lit("")) != "")
    absent = (F.col("source") == "manual") & (F.col("outcome") == "NOT_IN_DB")
    done = ~absent & ((F.col("source") == "manual") | F.col("outcome").isin(*DONE))
    again = F.when(absent, found).when(F.col("outcome") == "ERROR", True).otherwise(F.lit(reread) | ((F.col("outcome") == "SERIAL_NOT_FOUND") & found))
    return met.withColumn("choice", F.when(done | (absent & ~again), "skip_done").when(again, "read").otherwise("skip_waiting")).drop("found")


def chosen(photos: DataFrame, log: DataFrame, register: DataFrame, reread: bool = False) -> DataFrame:
    """The photos that a run reads: of each key the first, if its last row calls for it or there is none.

    Further photos of a key are copies in the run, or have been dealt with like the first; they never meet the log, so
    that a content which many photos share is one row from the first exchange on.
    """
    own = photos.columns
    first = photos.withColumn("key", photo_key()).groupBy("key").agg(F.min_by(F.struct(*own), "photo").alias("first")).select("key", "first.*")
    states = wanted(last_rows(log).join(first.select("key"), "key", "left_semi"), register, reread).select("key", "choice")
    return first.join(states, "key", "left").where(F.coalesce("choice", F.lit("read")) == "read").select(*own)


def to_read_again(log: DataFrame, register: DataFrame, reread: bool = False) -> DataFrame:
    """(key) of photos in the log that the next run reads again."""
    return wanted(last_rows(log), register, reread).where("choice = 'read'").select("key")


def run_rows(photos: DataFrame, register: DataFrame, log: DataFrame, limits: Limits | None = None, reread: bool = False, number: int = 0, base: int | None = None) -> DataFrame:
    """The log rows (ROW) of run `number` over photos, in the order of seq, which is above base (the log's greatest, if it is not given) and that of all earlier runs.

    Every photo that is chosen has one row with its outcome. When an account gets its reading, each photo whose last row
    is a DIGITS_ERROR or SUSPICIOUS of this account, in this run or before, gets a REPEAT that closes it. Numbers of rows
    are made of those of the run and the photo, or of the row from before the month that is closed, so they need no sort.
    """
    if base is None:
        base = log.agg(F.max("seq")).first()[0] or 0
    read = cut(chosen(photos, log, register, reread))
    results = decided(read, register, log, limits, selected=True).join(read.select("photo", "name", "photo_hash"), "photo")

    def place(n: Column) -> Column:
        return n + (base + 1 + (number << (BITS + 2)))

    rows = results.withColumns({"seq": place(F.col("photo") * 2), "source": F.lit("auto"), "notes": F.lit(""), "closes": F.lit(None).cast("long")})
    rows = cut(rows.select(*_COLUMNS))

    readings = rows.where("outcome in ('PLUS', 'MINUS')").groupBy("account").agg(F.min("photo").alias("by"))
    known = log.unionByName(rows.select("seq", "photo", "name", "photo_hash", "serial", "account", "outcome", "source", "notes"), allowMissingColumns=True)
    waiting = last_rows(known).where(F.col("outcome").isin(*WAITING)).join(readings, "account")
    closing = waiting.select(
        place(F.coalesce(F.col("photo") * 2 + 1, F.col("seq") + (1 << (BITS + 1)))).alias("seq"), F.lit(None).cast("long").alias("photo"), "name", "photo_hash", "serial", "account", *[F.lit(None).cast(t).alias(c) for c, t in (("last", "double"), ("reading", "long"), ("delta", "double"))],
        F.lit("REPEAT").alias("outcome"), F.lit("closed").alias("detail"), F.lit("auto").alias("source"), F.concat(F.lit(f"{CLOSED_NOTE} (photo "), F.col("by").cast("string"), F.lit(")")).alias("notes"), F.col("seq").alias("closes"),
    )
    return rows.unionByName(closing)


def filled_register(register: DataFrame, rows: DataFrame) -> DataFrame:
    """The register after a month's rows: accounts with a PLUS or MINUS have their reading."""
    read = rows.where("outcome in ('PLUS', 'MINUS')").select("account", F.lit(True).alias("_filled")).distinct()
    met = register.join(read, "account", "left")
    return met.withColumn("filled", F.coalesce("filled", F.lit(False)) | F.coalesce("_filled", F.lit(False))).drop("_filled")


def final_states(rows: DataFrame) -> DataFrame:
    """(key, outcome, account, reading) of each photo that a month's rows tell of: its last row."""
    return pick_last(rows.withColumn("key", photo_key()), ["key"], F.desc("seq")).select("key", "outcome", "account", "reading")


def log_table(rows: DataFrame, photos: DataFrame, by: str, at: str) -> DataFrame:
    """A run's rows (ROW) as the log's own 18 columns of text, in their order; what a row has not is ''.

    photos: (photo, serial_conf, shown, folder), and final_name where files were renamed: what the models showed. Whole
    numbers have no fraction, confidences four places; the detail of an outcome is the last part of the notes.
    """
    seen = photos if "final_name" in photos.columns else photos.withColumn("final_name", F.lit(""))
    met = rows.join(seen.select("photo", "serial_conf", "shown", "folder", "final_name"), "photo", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.coalesce(F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string")), F.lit(""))
    columns = {
        "original_filename": text("name"), "final_filename": text("final_name"), "serial_id": text("serial"), "account_id": text("account"), "reading": text("reading"), "last_reading": number("last"), "delta": number("delta"), "outcome": text("outcome"), "source": text("source"),
        "processed_by": F.lit(by), "processed_at": F.lit(at), "verified_by": F.lit(""), "verified_at": F.lit(""), "model_serial_conf": F.coalesce(F.format_string("%.4f", "serial_conf"), F.lit("")), "model_reading_str": text("shown"),
        "notes": F.concat_ws(" | ", F.nullif(F.col("notes"), F.lit("")), F.nullif(F.col("detail"), F.lit(""))), "photo_hash": text("photo_hash"), "source_folder": text("folder"),
    }
    return met.select(*[F.when(F.col("serial_conf").isNull(), "").otherwise(c).alias(n) if n == "model_serial_conf" else c.alias(n) for n, c in columns.items()])
