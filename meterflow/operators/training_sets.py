"""Crops of photos for training, with the table's answers: a photo gives all that it has, or leaves no trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reading_digits

KINDS = ("serial", "account", "digit")
#: What became of each kind of crop.
MADE, NO_ACCOUNT, NOT_FOUND, NONE, SEVERAL, UNFIT = "made", "no account in the name", "not found", "not in the table", "several answers", "answer unfit"
#: Photos of a task: it holds all their crops, which are more than the bytes by which Spark would choose tasks.
PHOTOS = 1 << 17


def only_one(answers: DataFrame, value: str) -> DataFrame:
    """(account, <value>, n): an account's answer if it has just one, and how many different ones it has; empty ones are none."""
    known = answers.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy("account")
    found = known.agg(F.min(F.trim(value)).alias("low"), F.max(F.trim(value)).alias("high"))
    return found.select("account", F.when(F.col("low") == F.col("high"), F.col("low")).alias(value), F.when(F.col("low") == F.col("high"), 1).otherwise(2).alias("n"))


def built(photos: DataFrame, serials: DataFrame, readings: DataFrame, digits: int = 5) -> DataFrame:
    """(photo, account, serial, marker, reading, crops) of the photos that did not fail: what became of each kind, and all crops.

    photos: (photo, account, failed, has_serial, has_account, has_meter, n_digits), one row for each; serials (account,
    serial) and readings (account, reading) are the table. A crop is (kind, position, answer). A serial has four to ten
    digits; a reading gives its digits, as many as were found, one crop each. A photo whose reading failed at any step is
    left out whole, with its names and counts. Tables without rows give no answers. Answers are judged once for each
    account, and accounts are dealt to tasks by the number of photos.
    """
    fit = F.col("serial").rlike("^[0-9]{4,10}$")
    known = only_one(serials, "serial").withColumn("_serial_is", F.when(F.col("n") > 1, SEVERAL).when(~fit, UNFIT).otherwise(MADE)).drop("n")
    text = reading_digits(F.col("reading"), digits)
    read = only_one(readings, "reading").withColumn("_text", text).select("account", "_text", F.when(F.col("n") > 1, SEVERAL).when(F.col("_text").isNull(), UNFIT).otherwise(MADE).alias("_reading_is"))
    met = photos.where(~F.coalesce("failed", F.lit(False)))
    tasks = -(-met.count() // PHOTOS) or 1
    answered = met.where("account is not null").repartition(tasks, "account").join(known.join(read, "account", "full").hint("merge"), "account", "left")
    # photos without account ask no table, where they would be one key
    met = answered.unionByName(met.where("account is null").withColumn("account", F.lit(None).cast("string")), allowMissingColumns=True)
    named = F.col("account").isNull()
    serial = F.when(named, NO_ACCOUNT).when(F.col("_serial_is").isNull(), NONE).when(F.col("_serial_is") != MADE, F.col("_serial_is")).when(~F.col("has_serial"), NOT_FOUND).otherwise(MADE)
    marker = F.when(named, NO_ACCOUNT).when(~F.col("has_account"), NOT_FOUND).otherwise(MADE)
    reading = F.when(named, NO_ACCOUNT).when(F.col("_reading_is").isNull(), NONE).when(F.col("_reading_is") != MADE, F.col("_reading_is")).when(~F.col("has_meter") | (F.col("n_digits") != digits), NOT_FOUND).otherwise(MADE)
    met = met.withColumns({"_serial": serial, "_marker": marker, "_reading": reading})

    def crop(kind: str, position: Column, answer: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), position.cast("int").alias("position"), answer.alias("answer"))

    each = F.transform(F.sequence(F.lit(1), F.lit(digits)), lambda p: crop("digit", p, F.substring("_text", p, F.lit(1))))
    none = F.array().cast("array<struct<kind:string,position:int,answer:string>>")
    crops = F.concat(
        F.when(F.col("_serial") == MADE, F.array(crop("serial", F.lit(1), F.col("serial")))).otherwise(none),
        F.when(F.col("_marker") == MADE, F.array(crop("account", F.lit(1), F.lit("")))).otherwise(none),
        F.when(F.col("_reading") == MADE, each).otherwise(none),
    )
    return met.select("photo", "account", F.col("_serial").alias("serial"), F.col("_marker").alias("marker"), F.col("_reading").alias("reading"), crops.alias("crops"))


def named(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(photo, kind, position, answer, copy) of each crop of built() rows: the number that makes its name free.

    A name is the account with its copy, kind, position and answer. taken: (account, kind, position, answer, copy) of names that are
    there; in the order of photos each crop takes the least number of its name, from 1, that none has. Crops are numbered
    in the tasks to which built() dealt their accounts.
    """
    base = ["account", "kind", "position", "answer"]
    crops = rows.where("account is not null").select("photo", "account", F.explode("crops").alias("c")).select("photo", "account", "c.*")
    # of the n-th free number, those taken below it are added: the j-th taken one t is below it if t - j < n
    copies = F.array_sort(F.collect_set(F.when(F.col("copy") > 0, F.col("copy").cast("int"))))
    there = taken.groupBy(*base).agg(copies.alias("t")).select(*base, F.transform("t", lambda t, j: t - j - 1).alias("before"))
    there = there.groupBy("account").agg(F.collect_list(F.struct("kind", "position", "answer", "before")).alias("_there"))
    crops = crops.withColumn("_n", F.row_number().over(Window.partitionBy(*base).orderBy("photo"))).join(there.hint("merge"), "account", "left")
    own = F.filter("_there", lambda x: (x["kind"] == F.col("kind")) & (x["position"] == F.col("position")) & (x["answer"] == F.col("answer")))
    before = F.coalesce(F.get(own, F.lit(0))["before"], F.array().cast("array<int>"))
    return crops.select("photo", "kind", "position", "answer", (F.col("_n") + F.size(F.filter(before, lambda t: t < F.col("_n")))).alias("copy"))


def kind_counts(rows: DataFrame) -> DataFrame:
    """(kind, state, n): how many photos of built() rows came to what with each kind."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("state")) for k, c in zip(KINDS, ("serial", "marker", "reading"))])
    return rows.select(F.explode(each).alias("x")).groupBy("x.kind", "x.state").agg(F.count(F.lit(1)).alias("n"))
