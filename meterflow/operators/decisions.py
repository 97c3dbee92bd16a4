"""The decision of a photo in one plan: what is known of it, whose meter it shows, and whether its reading is taken.

Photos come as a table of predictions (photo, name, photo_hash, reread, failed, meter, serial, serial_conf, table_serial,
table_conf, marker, marker_conf, reading, digit_error): `photo` is the order of the run, `meter` says whether one was
found, `serial` is null where no plate was, `table_serial` is the register's serial that reads like it, `marker` the
account written on the meter, `reading` null where its digits are not sure. Optional: `lines` and `unread`, the note
written over the photo. The register has (account, serial, last, filled, row_order).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup_variants
from . import notes
from .lineage import cut
from .lookups import first_variants
from .photos import duplicates, processed

RESULT = ("photo", "outcome", "detail", "serial", "account", "last", "reading", "delta")


@dataclass(frozen=True)
class Limits:
    """Confidences from which a serial, a serial by the table and a marker count, and the largest plain change."""

    serial: float = 0.3
    table: float = 0.5
    marker: float = 0.5
    delta: float = 10000.0


def _of_serial(rows: DataFrame, register: DataFrame) -> DataFrame:
    """(photo, n, first, among) of rows (photo, marker, serial), one for each photo, whose serial the register has: accounts, the first row, and whether the marker's is one of them.

    The register is folded to a row for each serial, and a marker meets only its own account, so that photos are never
    multiplied by the subscribers of a serial.
    """
    first = F.min(F.struct("row_order", "account", "register_last", "filled", F.col("serial").alias("found_serial"))).alias("first")
    of_serial = register.groupBy("serial").agg(F.countDistinct("account").alias("n"), first)
    met = rows.select("photo", "marker", "serial").join(of_serial, "serial")
    mine = rows.where("marker is not null").join(register.select("serial", F.col("account").alias("marker")).distinct(), ["serial", "marker"], "left_semi").select("photo", F.lit(True).alias("_among"))
    return met.join(mine, "photo", "left").select("photo", "n", "first", F.coalesce("_among", F.lit(False)).alias("among"))


def decided(photos: DataFrame, register: DataFrame, log: DataFrame, limits: Limits | None = None, selected: bool = False) -> DataFrame:
    """One row (RESULT) for each photo. The order of the steps is the contract:

    a photo that failed is an ERROR; one that has been dealt with, or that copies an earlier one of the run, a REPEAT; without meter NO_METER;
    the serial names one account, or else the marker or the note does; marker or note against the serial, SUSPICIOUS
    without an account; an account that has its reading, REPEAT, or SUSPICIOUS where table and log disagree; no sure
    digits, DIGITS_ERROR; then the change decides. Once an account has its reading, later photos of it in the run are
    REPEATs. Rows without account never meet in one group. An empty table gives no rows. With selected a run has chosen
    the photos by the log already, and none is a REPEAT for what is known of the photo itself.
    """
    limits = limits or Limits()
    yes, no, text = F.lit(True), F.lit(False), F.lit(None).cast("string")
    reg = register.select(F.col("account").cast("string").alias("account"), F.trim("serial").alias("serial"), F.col("last").cast("double").alias("register_last"), "filled", "row_order")
    rows = photos if "lines" in photos.columns else photos.withColumns({"lines": F.lit(None).cast("array<string>"), "unread": F.lit(0)})
    rows = rows.withColumn("has_note", F.col("lines").isNotNull())

    # what the log knows
    if selected:
        rows = rows.withColumns({"copy": no, "reason": text, "seen_account": text, "seen_serial": text, "repeat": no})
    else:
        seen = processed(photos.select("photo", "name", "photo_hash"), log).join(log.select(F.col("seq").alias("row"), F.col("account").alias("seen_account"), F.col("serial").alias("seen_serial")), "row", "left").drop("row")
        copied = rows.where("photo_hash <> ''").withColumn("copy", F.row_number().over(Window.partitionBy("photo_hash").orderBy("photo")) > 1).where("copy").select("photo", "copy")
        rows = rows.join(seen, "photo", "left").join(copied, "photo", "left")
        rows = rows.withColumn("repeat", (F.coalesce("skip", no) | F.coalesce("copy", no)) & ~F.coalesce("reread", no))
    open_ = ~F.coalesce("failed", no) & ~F.col("repeat") & (F.coalesce("meter", no) | F.col("has_note"))

    # the serial and its account
    sure = open_ & F.col("serial").isNotNull() & (F.col("serial_conf") >= limits.serial)
    asked = rows.where(sure).select("photo", "marker", F.trim("serial").alias("serial_read"))
    plain = _of_serial(first_variants(asked, reg), reg)
    rows = rows.join(plain, "photo", "left")
    failure = F.when(F.col("serial").isNull(), "NO_SERIAL").when(F.col("serial_conf") < limits.serial, "SERIAL_LOW_CONF").when(F.col("n").isNull(), "SERIAL_NOT_FOUND").when(F.col("n") > 1, "SERIAL_AMBIGUOUS")
    rows = rows.withColumn("failure", F.when(open_, failure))
    by_table = F.col("failure").isin("SERIAL_NOT_FOUND", "SERIAL_LOW_CONF") & F.col("table_serial").isNotNull() & (F.col("table_conf") >= limits.table)
    met = rows.where(by_table).select("photo", "marker", F.trim("table_serial").alias("serial"))
    met = _of_serial(met, reg).select("photo", F.col("n").alias("table_n"), F.col("first").alias("table_first"), F.col("among").alias("table_among"))
    rows = rows.join(met, "photo", "left").withColumn("taken", F.col("table_n").isNotNull())
    rows = rows.withColumns({
        "failure": F.when(F.col("taken"), F.when(F.col("table_n") > 1, "SERIAL_AMBIGUOUS")).otherwise(F.col("failure")),
        "first": F.when(F.col("taken"), F.col("table_first")).otherwise(F.col("first")),
        "among": F.coalesce(F.when(F.col("taken"), F.col("table_among")).otherwise(F.col("among")), no),
    })
    rows = cut(rows.withColumn("read_serial", F.when(F.col("first").isNotNull(), F.col("first.found_serial")).otherwise(F.col("serial"))))

    # another account where the serial gave none: the marker's, then the note's
    named = reg.groupBy("account").agg(F.min(F.struct("row_order", "account", "register_last", "filled", F.col("serial").alias("found_serial"))).alias("named"), F.collect_set("serial").alias("serials"))
    confident = F.col("marker").isNotNull() & (F.col("marker_conf") >= limits.marker)
    helped = rows.where(F.col("failure").isNotNull() & confident).select("photo", F.col("marker").alias("account"), F.col("failure").alias("outcome"), F.col("read_serial").alias("serial"), "among")
    agrees = (F.coalesce("serial", F.lit("")) != "") & F.exists("serials", lambda t: F.exists(lookup_variants(F.col("serial")), lambda v: F.levenshtein(v, t) <= 1))
    takes = F.when(F.col("outcome") == "SERIAL_AMBIGUOUS", F.col("among")).otherwise((F.col("outcome") == "NO_SERIAL") | agrees)
    helped = helped.join(named, "account").where(takes).select("photo", F.col("named").alias("marker_row"))
    rows = rows.join(helped, "photo", "left")
    lasts = register.select(F.col("account").cast("string").alias("account"), F.col("last").cast("double").alias("last"))
    if "lines" in photos.columns:
        told = notes.interpreted(rows.where(F.col("failure").isNotNull() & F.col("marker_row").isNull() & F.col("has_note")).select("photo", "lines", text.alias("account"), F.col("reading").alias("barrel"), "unread"), lasts)
        told = cut(told.where("account is not null").select("photo", "account")).join(rows.select("photo", F.col("failure").alias("outcome"), F.col("read_serial").alias("serial"), F.trim("serial").alias("plate")), "photo").join(named, "account")
        rivals = first_variants(told.where("outcome = 'SERIAL_AMBIGUOUS'").select("photo", "account", F.col("plate").alias("serial_read")), reg)
        rivals = rivals.join(reg.select("serial", "account"), ["serial", "account"], "left_semi").select("photo", F.col("account").alias("rival")).distinct()
        told = told.join(rivals, "photo", "left").withColumn("ambiguous", F.when(F.col("rival").isNotNull(), F.array("account")).otherwise(F.array().cast("array<string>")))
        told = notes.rescued(told).where("rescued is not null").select("photo", F.col("named").alias("note_row"))
        rows = cut(rows.join(told, "photo", "left"))
    else:
        rows = rows.withColumn("note_row", F.lit(None).cast(rows.schema["marker_row"].dataType))
    rows = rows.withColumn("row", F.when(F.col("failure").isNull() & open_, F.col("first")).otherwise(F.coalesce("marker_row", "note_row")))
    if "lines" in photos.columns:
        known = notes.interpreted(rows.where("row is not null and has_note").select("photo", "lines", F.col("row.account").alias("account"), F.lit(None).cast("bigint").alias("barrel"), "unread"), lasts)
        rows = cut(rows.join(known.select("photo", F.col("reading").alias("note_reading"), F.col("conflict").alias("note_conflict")), "photo", "left"))
    else:
        rows = rows.withColumns({"note_reading": F.lit(None).cast("bigint"), "note_conflict": F.lit(None).cast("boolean")})

    # conflict, duplicate, digits, change
    against = F.col("failure").isNull() & ((confident & (F.col("marker") != F.col("row.account"))) | F.coalesce("note_conflict", no))
    no_meter = ~F.coalesce("meter", no)
    early = F.when(F.coalesce("failed", no), "ERROR").when(F.col("repeat"), "REPEAT").when(no_meter & ~F.col("has_note"), "NO_METER")
    early = early.when(F.col("row").isNull(), F.when(no_meter, "NO_METER").otherwise(F.col("failure"))).when(against, F.when(no_meter, "NO_METER").otherwise("SUSPICIOUS")).when(no_meter & F.col("note_reading").isNull(), "NO_METER")
    rows = rows.withColumns({"early": early, "against": F.coalesce(against, no), "value": F.coalesce("note_reading", F.when(~no_meter, F.col("reading")))})
    reached = rows.where("early is null").select("photo", F.col("row.account").alias("account"), F.coalesce("row.filled", no).alias("filled"), no.alias("in_run"), "value", F.col("row.register_last").alias("last"))
    later = duplicates(reached, log).withColumn("delta", F.col("value") - F.col("last"))
    change = F.when(F.col("delta").isNull(), "PLUS").when(F.abs("delta") > limits.delta, "SUSPICIOUS").when(F.col("delta") >= 0, "PLUS").otherwise("MINUS")
    later = later.withColumn("outcome", F.coalesce("decided", F.when(F.col("value").isNull(), "DIGITS_ERROR").otherwise(change)))
    done = F.min(F.when(F.col("outcome").isin("PLUS", "MINUS"), F.col("photo"))).over(Window.partitionBy("account"))
    later = later.withColumn("outcome", F.when(F.col("photo") > done, "REPEAT").otherwise(F.col("outcome")))
    taken = F.col("outcome").isin("PLUS", "MINUS", "SUSPICIOUS") & F.col("decided").isNull()
    later = later.select("photo", F.col("outcome").alias("late"), F.when(taken, F.col("delta")).alias("delta"), F.when(taken, F.col("value")).alias("taken_value"))

    rows = rows.join(later, "photo", "left").withColumn("outcome", F.coalesce("early", "late"))
    detail = F.when(F.col("early") == "REPEAT", F.coalesce(F.when(F.coalesce("copy", no), "copy"), "reason")).when(F.col("early") == "DIGITS_ERROR", F.col("digit_error"))
    detail = F.when(F.col("against") & (F.col("early") == "SUSPICIOUS"), "conflict").when(F.col("late") == "DIGITS_ERROR", F.col("digit_error")).when(F.col("early").isNull() & F.col("failure").isNotNull(), F.concat(F.lit("rescued "), F.lower("failure"))).otherwise(detail)
    mine = F.col("early").isNull()
    seen_ = F.col("early") == "REPEAT"
    return rows.select(
        "photo",
        "outcome",
        detail.alias("detail"),
        F.when(seen_, F.nullif(F.col("seen_serial"), F.lit(""))).when(mine, F.col("row.found_serial")).when(open_, F.col("read_serial")).alias("serial"),
        F.when(seen_, F.nullif(F.col("seen_account"), F.lit(""))).when(mine, F.col("row.account")).alias("account"),
        F.when(mine, F.col("row.register_last")).alias("last"),
        F.col("taken_value").cast("bigint").alias("reading"),
        "delta",
    )

