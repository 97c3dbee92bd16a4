"""Writing registers, logs, splits and snapshots as tables and CSV files."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, split_of
from ..operators.lookups import pick_last
from ..operators.register import exported
from .tables import LOG_COLUMNS
from .workbooks import write_workbooks


def write_csv(rows: DataFrame, path: str, separator: str = ",") -> None:
    rows.write.mode("overwrite").csv(path, sep=separator, header=True, emptyValue="", nullValue="")


def write_log(log: DataFrame, path: str) -> None:
    """A log's columns in their fixed order; others are left out, missing ones are empty."""
    have = set(log.columns)
    write_csv(log.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in LOG_COLUMNS]), path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str, path: str) -> None:
    """The latest row of each key, written to a new path: Spark can't replace files that it is reading."""
    pick_last(table.unionByName(rows, allowMissingColumns=True), [key], F.desc(order)).write.mode("overwrite").parquet(path)


def without_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def updated(table: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """table with the columns that changes has of its keys; columns that are not allowed are an error."""
    own = [c for c in changes.columns if c != key]
    if wrong := sorted(set(own) - set(allowed)):
        raise ValueError(f"columns {', '.join(wrong)} can't be changed")
    new = changes.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in own])
    met = table.join(new, key, "left")
    return met.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns])


def typed_cell(text):
    """struct<whole, fraction, text>: a cell of an export as a whole number, a number or else as text."""
    whole, number = text.rlike("^-?(0|[1-9][0-9]{0,14})$"), text.rlike(NUMBER) & ~text.rlike("^-?0[0-9]")
    return F.struct(F.when(whole, text.try_cast("bigint")).alias("whole"), F.when(~whole & number, text.try_cast("double")).alias("fraction"), F.when(~whole & ~number, text).alias("text"))


def write_split(rows: DataFrame, key: str, path: str) -> None:
    """Rows in folders train, val and test by the hash of a key, so that a key's rows stay together."""
    rows.withColumn("split", split_of(F.col(key))).write.mode("overwrite").partitionBy("split").parquet(path)


def changed_labels(rows: DataFrame) -> DataFrame:
    """(photo, position, digit): the digits in which the operator's reading (final) differs from the model's; texts of other lengths give all."""
    at = rows.where("final <> ''").select("photo", "final", "model", F.explode(F.sequence(F.lit(1), F.length("final"))).alias("p"))
    digit, read = F.substring("final", F.col("p"), F.lit(1)), F.substring("model", F.col("p"), F.lit(1))
    other = (F.length("final") != F.length("model")) | (digit != read) | F.col("model").isNull()
    return at.where(other).select("photo", (F.col("p") - 1).alias("position"), digit.alias("digit"))


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and its path there."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def versions_in(folder: str) -> list[int]:
    """The versions of a table in a folder that are whole: those with the mark that a write leaves at its end."""
    store, at = store_of(folder)
    found = [posixpath.basename(x.path) for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.Directory]
    numbers = [int(n.removeprefix("version=")) for n in found if re.fullmatch("version=[0-9]+", n)]
    return sorted(n for n in numbers if store.get_file_info(f"{at}/version={n}/_SUCCESS").type == fs.FileType.File)


def snapshot(table: DataFrame, folder: str, version: int, keep: int = 30) -> list[int]:
    """Writes a table as a version of its own and returns the versions that are older than the last `keep`, for removal."""
    table.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return versions_in(folder)[:-keep] if keep else versions_in(folder)


def backup(table: DataFrame, folder: str, version: int, keep: int = 30) -> list[int]:
    """A snapshot, after which only the last `keep` whole versions are there; returns those that were removed.

    Versions are removed when the new one is whole, so that a failed write removes none.
    """
    old = snapshot(table, folder, version, keep)
    store, at = store_of(folder)
    for n in old:
        store.delete_dir(f"{at}/version={n}")
    return old


def export_month(register: DataFrame, readings: DataFrame, folder: str, sheet: str = "Sheet1") -> None:
    """The register's rows in table, in its order, as workbooks with their readings; the difference is a formula."""
    rows = exported(register, readings, "row_order")
    write_workbooks(rows, folder, numbers=("last", "reading"), differences={"difference": ("reading", "last")}, sheet=sheet)
