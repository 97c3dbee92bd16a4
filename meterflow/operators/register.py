"""The monthly register: full-outer merge with an audit trail, latest-wins upserts, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookups import pick_last


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each non-empty account."""
    return pick_last(rows.where("account <> ''"), ["account"], F.col("row_order"))


def merge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(account, change, before, after) between two registers (account, serial, last, in_table): one row for each change.

    added, returned, removed, serial and last; an account may have both a serial and a last change.
    """
    a = old.select("account", F.col("serial").alias("s0"), F.col("last").alias("l0"), "in_table")
    b = new.select("account", F.col("serial").alias("s1"), F.col("last").alias("l1"), F.lit(True).alias("incoming"))
    both = a.join(b, "account", "full_outer")
    kind = lambda name, when, before, after: F.when(when, F.struct(F.lit(name).alias("change"), before.cast("string").alias("before"), after.cast("string").alias("after")))
    here, there, none = F.coalesce("incoming", F.lit(False)), F.col("in_table").isNotNull(), F.lit(None)
    changes = F.array(
        kind("added", here & ~there, none, F.col("s1")),
        kind("returned", here & there & ~F.coalesce("in_table", F.lit(False)), none, F.col("s1")),
        kind("removed", ~here & F.coalesce("in_table", F.lit(False)), F.col("s0"), none),
        kind("serial", here & there & (F.col("s0") != F.col("s1")), F.col("s0"), F.col("s1")),
        kind("last", here & there & (F.col("l0") != F.col("l1")), F.col("l0"), F.col("l1")),
    )
    return both.select("account", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("account", "c.change", "c.before", "c.after")


def merged(old: DataFrame, new: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """The register after the merge: incoming rows win, absent accounts stay with in_table false, the latest operator's fix of a serial holds."""
    b = new.select("account", F.col("serial").alias("s1"), F.col("last").alias("l1"), F.lit(True).alias("incoming"))
    both = old.drop("in_table").join(b, "account", "full_outer")
    out = both.select("account", F.coalesce("s1", "serial").alias("serial"), F.coalesce("l1", "last").alias("last"), F.coalesce("incoming", F.lit(False)).alias("in_table"))
    if fixes is None:
        return out
    latest = fixes.groupBy("account").agg(F.max_by("new", "id").alias("fixed"))
    return out.join(latest, "account", "left").withColumn("serial", F.coalesce("fixed", "serial")).drop("fixed")


def shared_serials(register: DataFrame) -> DataFrame:
    """Serials of several accounts, with the accounts in the register's order."""
    rows = register.where("serial <> ''").groupBy("serial").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("row_order", "account"))).alias("rows"))
    return rows.where("n > 1").select("serial", "n", F.concat_ws(",", F.transform("rows", lambda r: r["account"])).alias("accounts"))


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    return pick_last(table.unionByName(rows), [key], F.desc(order))


def exported(register: DataFrame, readings: DataFrame, *keep: str) -> DataFrame:
    """Register rows in table with their reading ('' without) and the difference to the last one, and the columns `keep`."""
    met = register.where("in_table").join(readings.select("account", "value"), "account", "left")
    return met.select("account", "serial", "last", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("reading"), (F.col("value") - F.col("last")).alias("difference"), *keep)


def without_reading(register: DataFrame, readings: DataFrame) -> DataFrame:
    return register.where("in_table").join(readings, "account", "left_anti")


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, numeric, is_numeric): more than half of the filled cells are numbers; one pass for all columns."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("cell")) for c in columns])).alias("x")).select("x.*")
    number = F.col("cell").rlike(r"^-?[0-9]+([.][0-9]+)?$")
    found = cells.where("cell <> ''").groupBy("column").agg(F.count(F.lit(1)).alias("filled"), F.count_if(number).alias("numeric"))
    return found.withColumn("is_numeric", F.col("numeric") * 2 > F.col("filled"))
