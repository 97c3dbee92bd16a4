"""Reading registers, logs, photo folders and label files. Columns stay text: leading zeros count, and nothing is inferred."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_serial, crop_name_parts, stored_account, valid_label
from ..operators.register import numeric_columns
from . import workbooks

LOG_COLUMNS = "original_filename final_filename serial_id account_id reading last_reading delta outcome source processed_by processed_at verified_by verified_at model_serial_conf model_reading_str notes photo_hash source_folder".split()
PHOTO_TYPES = (".jpg", ".jpeg", ".png")


#: What the upper half of the bytes means in ISO 8859-1, which Spark reads, and in Windows-1251.
_LATIN = bytes(range(128, 256)).decode("latin-1")
_CYRILLIC = bytes(range(128, 256)).decode("cp1251", "replace")


def dialect(spark: SparkSession, path: str) -> tuple[str, bool, bool]:
    """(separator, whether the bytes are Windows-1251, whether cells span lines) of a CSV file.

    ; separates where the first line has more of it than commas. The file is UTF-8 unless one of its lines is no valid
    UTF-8; a line with an odd number of quotes opens a cell that goes on. One pass over all lines, on executors.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).select(F.length(F.regexp_replace("value", "[^;]", "")) > F.length(F.regexp_replace("value", "[^,]", ""))).first()
    odd = F.length(F.regexp_replace(F.make_valid_utf8("value"), '[^"]', "")) % 2 == 1
    cyrillic, spans = lines.agg(F.bool_or(~F.is_valid_utf8("value")), F.bool_or(odd)).first()
    return (";" if head and head[0] else ","), bool(cyrillic), bool(spans)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns with trimmed names and cells, '' for missing, row_order in the order of the file.

    Columns without name are left out, as are rows without any cell; of columns with one name the first counts. An empty
    file has no columns but row_order. A file whose cells stay in their lines is read in parts.
    """
    separator, cyrillic, spans = dialect(spark, path)
    options = {"sep": separator, "encoding": "ISO-8859-1" if cyrillic else "UTF-8", "multiLine": spans, "quote": '"', "escape": '"'}
    head = spark.read.csv(path, header=False, inferSchema=False, **options).first()
    names: dict[str, int] = {}
    for k, n in enumerate(head or ()):
        n = (n or "").lstrip("\ufeff").strip()
        n = n.translate(str.maketrans(_LATIN, _CYRILLIC)).strip() if cyrillic else n
        if n:
            names.setdefault(n, k)
    schema = ", ".join(f"c{k} string" for k in range(len(head or ()))) or "c0 string"
    rows = spark.read.csv(path, header=True, schema=schema, **options)
    cell = lambda k: F.translate(F.col(f"c{k}"), _LATIN, _CYRILLIC) if cyrillic else F.col(f"c{k}")
    blank = r"(?U)^\s+|\s+$"
    cells = [F.regexp_replace(F.coalesce(cell(k), F.lit("")), blank, "").alias(n) for n, k in names.items()]
    out = rows.select(*cells, F.monotonically_increasing_id().alias("row_order"))
    return out.where(reduce(lambda a, b: a | b, [F.col(f"`{n}`") != "" for n in names])) if names else out.limit(0)


def read_register(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A register file's cells as text (.xlsx, .xlsm or .csv), and its numeric columns, by the kinds of cells or, in CSV, their texts.

    Other kinds of files, and a file without a row of headings, are an error.
    """
    kind = posixpath.splitext(path.rstrip("/"))[1].lower()
    if kind in (".xlsx", ".xlsm"):
        rows = workbooks.workbook(spark, path)
        found = workbooks.numeric_by_kind(spark, path)
    elif kind == ".csv":
        rows = csv(spark, path)
        names = [c for c in rows.columns if c != "row_order"]
        if not names:
            raise ValueError(f"no row of headings: {path}")
        found = numeric_columns(rows, names)
    else:
        raise ValueError(f"a table must be .xlsx or .csv, not {kind or 'without a kind'}: {path}")
    return rows, sorted(r["column"] for r in found.where("is_numeric").collect())  # as many as there are columns


def register(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """account, serial, last, row_order and data (all cells) of a register file; columns says which of its names these are.

    Missing names are an error. Accounts lose a fraction of zeros, serials the junk at their edges.
    """
    rows = workbooks.workbook(spark, path) if path.lower().endswith((".xlsx", ".xlsm")) else csv(spark, path)
    missing = [n for n in columns.values() if n not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    data = F.create_map(*[x for n in rows.columns if n != "row_order" for x in (F.lit(n), F.col(f"`{n}`"))])
    account, serial, last = (F.col(f"`{columns[k]}`") for k in ("account", "serial", "last"))
    return rows.select(stored_account(account).alias("account"), clean_serial(serial).alias("serial"), last.alias("last"), "row_order", data.alias("data"))


def log(spark: SparkSession, path: str) -> DataFrame:
    """A log file with all its columns, '' for those that an older one lacks, and seq in the order of its rows; a missing file is an empty log."""
    try:
        rows = csv(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in LOG_COLUMNS) + ", seq long")
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in LOG_COLUMNS], F.col("row_order").alias("seq"))


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, name, photo_hash, size) of the photos in a folder's sub-folders; hashes are made by executors, contents stay there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.concat(F.lit("."), F.element_at(F.split(name, "[.]"), -1)))
    out = files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("name"), F.substring(F.sha2("content", 256), 1, 16).alias("photo_hash"), F.col("length").alias("size"), kind.alias("kind"))
    return out.where(F.col("kind").isin(*PHOTO_TYPES)).drop("kind")


def manifest(spark: SparkSession, folder: str, roles: DataFrame) -> DataFrame:
    """(field, role, path, size, modified, sha256, missing): the files that are in use, each with the first 16 signs of its hash.

    roles: (field, role, path) with paths below the folder; an empty path is a role that is not filled and is left out. A
    file that is not there has only its mark. Contents are hashed by executors and stay there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    below = F.expr("substring(_root, locate(_folder, _root) + length(_folder))")
    known = files.withColumns({"_root": root, "_folder": F.lit(re.sub("^[a-z]+:/+", "/", folder.rstrip("/")) + "/")})
    known = known.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))
    wanted = roles.where("path <> ''").withColumn("path", F.translate("path", "\\", "/"))
    return wanted.join(known, "path", "left").select("field", "role", "path", "size", "modified", "sha256", F.col("sha256").isNull().alias("missing"))


def stray_files(spark: SparkSession, folder: str, ignored: tuple[str, ...] = ("Thumbs.db", "desktop.ini", ".DS_Store")) -> DataFrame:
    """(path): files of a folder that are no photos and no system's own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    kind = F.lower(F.concat(F.lit("."), F.element_at(F.split("name", "[.]"), -1)))
    return files.where(~kind.isin(*PHOTO_TYPES) & ~F.col("name").isin(*ignored)).select("path")


def crops(spark: SparkSession, folder: str) -> DataFrame:
    """(path, photo, kind, n, answer) of crop files whose name says what they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", crop_name_parts(F.element_at(F.split("path", "/"), -1)).alias("c")).where("c is not null").select("path", "c.*")


def label_lines(spark: SparkSession, folder: str, classes: int) -> DataFrame:
    """(path, line, valid) of all lines of a folder's label files."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), valid_label(F.col("value"), classes).alias("valid"))


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): both, left or right, from one full join."""
    a, b = left.select(key, F.lit(True).alias("_l")).distinct(), right.select(key, F.lit(True).alias("_r")).distinct()
    state = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
