"""Checks of training sets as one table of named conditions: each file is looked at once, for all of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import crop_name_parts, valid_label

BOXES, DIGITS, SERIALS, ACCOUNTS = "boxes", "digits", "serials", "accounts"


@dataclass(frozen=True)
class Check:
    """A problem that files of some kinds of data sets may have, as a condition over their columns."""

    problem: str
    kinds: tuple[str, ...]
    condition: Column


def is_image() -> Column:
    return F.lower(F.regexp_extract("name", "([.][^.]*)$", 1)).isin(".jpg", ".jpeg", ".png", ".bmp", ".webp")


def standard_checks() -> list[Check]:
    """Over (kind, folder, name, image, crop, has_label, has_image, bad_lines, copies, copy_folders): all that is wrong with a file."""
    image, crop = F.col("image"), F.col("crop.kind")
    digit_folder = F.col("folder").rlike("^[0-9]$")
    return [
        Check("image without label", (BOXES,), image & ~F.col("has_label")),
        Check("label without image", (BOXES,), ~image & ~F.col("has_image")),
        Check("bad label", (BOXES,), ~image & F.col("has_image") & (F.col("bad_lines") > 0)),
        Check("same content", (BOXES, SERIALS, ACCOUNTS), image & (F.col("copies") > 1)),
        Check("same content in another digit", (DIGITS,), image & digit_folder & (F.col("copies") > 1) & (F.col("copy_folders") > 1)),
        Check("same content in a digit", (DIGITS,), image & digit_folder & (F.col("copies") > 1) & (F.col("copy_folders") == 1)),
        Check("name not of a digit", (DIGITS,), image & digit_folder & ~F.coalesce(crop == "digit", F.lit(False))),
        Check("no image", (DIGITS,), ~image & digit_folder),
        Check("folder is not read", (DIGITS,), ~digit_folder),
        Check("name not of a serial", (SERIALS,), image & ~F.coalesce(crop == "serial", F.lit(False))),
        Check("answer unfit", (SERIALS,), image & (crop == "serial") & ~F.coalesce(F.col("crop.answer").rlike("^[0-9]{4,10}$"), F.lit(False))),
        Check("name not of an account", (ACCOUNTS,), image & ~F.coalesce((crop == "account") & F.col("crop.photo").rlike("^[0-9]+(-[0-9]+)?$"), F.lit(False))),
    ]


def looked_at(files: DataFrame, lines: DataFrame, classes: int) -> DataFrame:
    """files (dataset, kind, folder, name, hash) with what the checks ask: the partner of a label or image, bad lines, copies.

    lines: (dataset, name, line) of label files. Files of a data set whose hash is equal are copies; empty hashes are none.
    Copies are counted before they meet the files again; keys begin with what tells files apart, by which they are sorted. Partners are those of files of boxes, and bad lines those of
    files that are no images: other files are dealt once, to meet their copies, and names are taken apart after that.
    """
    stem = F.regexp_replace("name", "[.][^.]*$", "")
    rows = files.select("dataset", "kind", "folder", "name", "hash", is_image().alias("image"))
    partners = rows.where(F.col("kind") == BOXES).groupBy("dataset", stem.alias("stem")).agg(F.bool_or(~F.col("image")).alias("has_label"), F.bool_or("image").alias("has_image"))
    bad = lines.where(F.trim("line") != "").groupBy("dataset", "name").agg(F.count_if(~valid_label(F.col("line"), classes)).alias("bad_lines")).where("bad_lines > 0")
    same = rows.where(F.col("image") & (F.col("hash") != "")).groupBy("dataset", "hash").agg(F.count(F.lit(1)).alias("copies"), F.when(F.min("folder") < F.max("folder"), 2).otherwise(1).alias("copy_folders"))
    alone = F.coalesce(F.col("image") & (F.col("kind") != BOXES), F.lit(False))
    paired = rows.where(~alone).withColumn("stem", F.when(F.col("kind") == BOXES, stem)).join(partners, ["stem", "dataset"], "left").drop("stem").join(bad, ["name", "dataset"], "left")
    met = paired.unionByName(rows.where(alone), allowMissingColumns=True).join(same.where("copies > 1"), ["hash", "dataset"], "left")
    met = met.withColumns({"has_label": F.coalesce("has_label", F.lit(False)), "has_image": F.coalesce("has_image", F.lit(False)), "bad_lines": F.coalesce("bad_lines", F.lit(0)), "copies": F.coalesce("copies", F.lit(1)), "copy_folders": F.coalesce("copy_folders", F.lit(1))})
    return met.withColumn("crop", crop_name_parts(F.col("name")))


def problems(files: DataFrame, lines: DataFrame, classes: int, checks: Iterable[Check] | None = None) -> DataFrame:
    """(dataset, folder, name, problem): a row for each problem of each file."""
    found = [F.when(F.col("kind").isin(*c.kinds) & c.condition, F.lit(c.problem)) for c in (checks or standard_checks())]
    rows = looked_at(files, lines, classes).select("dataset", "folder", "name", F.array_compact(F.array(*found)).alias("p"))
    return rows.select("dataset", "folder", "name", F.explode("p").alias("problem"))


def report(files: DataFrame, found: DataFrame) -> DataFrame:
    """(dataset, files, images, problems): counts, with a map from each problem to the number of its files; data sets without any have an empty map."""
    counts = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.count_if(is_image()).alias("images"))
    by = found.groupBy("dataset", "problem").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("problem", "n")))).alias("problems"))
    return counts.join(by, "dataset", "left").withColumn("problems", F.coalesce("problems", F.create_map().cast("map<string,bigint>")))
