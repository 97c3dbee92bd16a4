"""Queries that write what they derive from the tables and read it back, or follow rows as they pass, with SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import dataset_checks, isolation, lineage, reference_sets, training_sets
from ..sources import sinks, tables, workbooks
from ..streaming import progress
from . import analogs as A
from .analogs import with_
from .registry import _LATEST, _latest, query


def _folder(spark, kind: str) -> str:
    return f"{lineage.shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("s03_workbook_register", with_("register", """SELECT account, serial, last::VARCHAR AS last, row_number() OVER (ORDER BY row_order) AS place FROM register"""))
def workbook_register(spark, sf):
    """The register as workbooks of 10,000 rows that are read back as text: leading zeros, numbers without a fraction, the order of the file."""
    at = _folder(spark, "register")
    workbooks.write_workbooks(A.register(spark, sf), at, numbers=("last", "account"), most=10_001)
    rows = tables.register(spark, f"{at}/*.xlsx", {"account": "account", "serial": "serial", "last": "last"})
    # full workbooks but the last: a row's place follows from its file and row
    first = F.floor(F.col("row_order") / workbooks.SHEET_ROWS)
    counts = rows.groupBy(first.alias("file")).agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.expr("b.file < a.file"), "left").groupBy("a.file").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # a row for each file
    met = rows.withColumn("file", first).join(F.broadcast(before), "file")
    return met.select("account", "serial", "last", (F.col("before") + F.col("row_order") % workbooks.SHEET_ROWS - 1).alias("place"))


@query("k01_export_workbook", with_("register reads", "").rstrip() + f", {_LATEST} " + """SELECT account, serial, last::VARCHAR AS last, coalesce(value::VARCHAR, '') AS reading, coalesce((value - last)::BIGINT::VARCHAR, '') AS difference, row_number() OVER (ORDER BY row_order) + 1 AS line
 FROM register LEFT JOIN latest USING (account)""")
def export_workbook(spark, sf):
    """The month's export as one workbook in the register's order, read back by cells; differences are formulas with their values."""
    at = _folder(spark, "export")
    sinks.export_month(A.register(spark, sf).withColumn("in_table", F.lit(True)), _latest(spark, sf), at)
    cells = workbooks.cells(spark, f"{at}/*.xlsx").where("row > 1")
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    return cells.select(*[cell(k).alias(c) for k, c in enumerate(("account", "serial", "last", "reading", "difference"))], F.col("row").alias("line"))


def _digits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A recogniser that cannot read some photos: it raises on every batch that holds one of them."""
    photo, reading = (batch.column(batch.schema.get_field_index(c)) for c in ("photo", "reading"))
    for p in photo.to_pylist():
        if p % 997 == 5:
            raise OSError(f"photo {p} is broken")
    return pa.RecordBatch.from_arrays([pc.utf8_lpad(reading.cast(pa.string()), 5, "0")], ["digits"])


@query("t06_failing_photos", with_("reads", "SELECT photo, CASE WHEN photo % 997 = 5 THEN 'ERROR' ELSE 'READ' END AS outcome, CASE WHEN photo % 997 <> 5 THEN lpad(reading::VARCHAR, 5, '0') END AS digits, CASE WHEN photo % 997 = 5 THEN 'OSError: photo ' || photo::VARCHAR || ' is broken' END AS error FROM reads"))
def failing_photos(spark, sf):
    """Photos on which the recogniser raises are errors; the others of their batches are read."""
    rows = isolation.recognised(A.reads(spark, sf).select("photo", "reading"), _digits, "digits string")
    return rows.select("photo", F.when(F.col("error").isNull(), "READ").otherwise("ERROR").alias("outcome"), "digits", "error")


@query("t12_progress", with_("runs", "SELECT 'done' AS name, count(*) AS n FROM runs UNION ALL SELECT o, (SELECT count(*) FROM runs WHERE outcome = o) FROM (SELECT unnest(['PLUS', 'MINUS', 'REPEAT', 'NO_METER', 'NO_SERIAL', 'SERIAL_LOW_CONF', 'SERIAL_NOT_FOUND', 'SERIAL_AMBIGUOUS', 'DIGITS_ERROR', 'SUSPICIOUS', 'ERROR']) AS o)"))
def observed_counts(spark, sf):
    """Counts that the pass which writes the rows has observed, without a second one."""
    seen = Observation("run")
    progress.observed(A.runs(spark, sf), seen).write.parquet(_folder(spark, "run"))
    return spark.createDataFrame([(k, seen.get[k]) for k in ("done", *progress.OUTCOMES)], "name string, n long")


_ANSWERS = """answers AS (SELECT doc_id::VARCHAR AS key, lang AS stratum, n_chars::VARCHAR AS answer, CASE WHEN doc_id % 3 = 0 THEN (n_chars + 1)::VARCHAR ELSE '' END AS last FROM documents),
known AS (SELECT key, stratum, answer, '' AS last FROM answers WHERE key::BIGINT % 9 = 0), quotas AS (SELECT unnest(['en', 'de', 'fr']) AS stratum, unnest([120, 45, 7]) AS quota)"""


def _etalon(spark, sf):
    k = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(k.cast("string").alias("key"), F.col("lang").alias("stratum"), F.col("n_chars").cast("string").alias("answer"), F.when(k % 3 == 0, (F.col("n_chars") + 1).cast("string")).otherwise("").alias("last"))
    return rows, rows.where("cast(key as bigint) % 9 = 0").withColumn("last", F.lit(""))


@query("r08_added_answers", f"""WITH {_ANSWERS},
room AS (SELECT stratum, greatest(0, quota - (SELECT count(*) FROM known k WHERE k.stratum = quotas.stratum)) AS quota FROM quotas),
drawn AS (SELECT a.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('e' || key), key) AS place FROM answers a WHERE key NOT IN (SELECT key FROM known))
SELECT k.key, k.stratum, k.answer, a.last, CASE WHEN a.last <> '' THEN 'filled' ELSE 'kept' END AS state FROM known k JOIN answers a USING (key)
UNION ALL SELECT key, stratum, answer, last, 'added' FROM drawn JOIN room USING (stratum) WHERE place <= quota""")
def added_answers(spark, sf):
    """A reference set after answers are added: known ones are kept or filled, new ones drawn to the quotas' rest."""
    answers, known = _etalon(spark, sf)
    quotas = spark.createDataFrame([("en", 120), ("de", 45), ("fr", 7)], "stratum string, quota int")
    return reference_sets.added(known, answers, quotas, 120, "e")


_CROPS = """photos AS (SELECT photo, CASE WHEN photo % 14 <> 3 THEN owner END AS account, photo % 101 = 7 AS failed, photo % 5 <> 1 AS has_serial, photo % 4 <> 1 AS has_account, photo % 6 <> 2 AS has_meter, CASE WHEN photo % 8 = 0 THEN 4 ELSE 5 END AS n_digits FROM reads),
serials AS (SELECT account, serial FROM register UNION ALL SELECT account, serial || '9' FROM register WHERE row_order % 10 = 4), readings AS (SELECT account, last::VARCHAR AS reading FROM register WHERE row_order % 7 <> 5 UNION ALL SELECT account, '77' FROM register WHERE row_order % 13 = 6),
s1 AS (SELECT account, min(trim(serial)) AS serial, count(DISTINCT trim(serial)) AS n FROM serials WHERE trim(serial) <> '' GROUP BY account), r1 AS (SELECT account, min(reading) AS reading, count(DISTINCT reading) AS n FROM readings GROUP BY account),
met AS (SELECT p.*, s1.serial AS s, s1.n AS ns, lpad(r1.reading, 5, '0') AS r, length(r1.reading) AS size, r1.n AS nr FROM photos p LEFT JOIN s1 USING (account) LEFT JOIN r1 USING (account) WHERE NOT failed),
built AS (SELECT *, CASE WHEN account IS NULL THEN 'no account in the name' WHEN ns IS NULL THEN 'not in the table' WHEN ns > 1 THEN 'several answers' WHEN NOT regexp_full_match(s, '[0-9]{4,10}') THEN 'answer unfit' WHEN NOT has_serial THEN 'not found' ELSE 'made' END AS serial_,
 CASE WHEN account IS NULL THEN 'no account in the name' WHEN NOT has_account THEN 'not found' ELSE 'made' END AS marker,
 CASE WHEN account IS NULL THEN 'no account in the name' WHEN nr IS NULL THEN 'not in the table' WHEN nr > 1 THEN 'several answers' WHEN size > 5 THEN 'answer unfit' WHEN NOT has_meter OR n_digits <> 5 THEN 'not found' ELSE 'made' END AS reading_ FROM met)"""


def _built(spark, sf):
    k, register = F.col("photo"), A.register(spark, sf)
    photos = A.reads(spark, sf).select("photo", F.when(k % 14 != 3, F.col("owner")).alias("account"), (k % 101 == 7).alias("failed"), (k % 5 != 1).alias("has_serial"), (k % 4 != 1).alias("has_account"), (k % 6 != 2).alias("has_meter"), F.when(k % 8 == 0, 4).otherwise(5).alias("n_digits"))
    serials = register.select("account", "serial").unionAll(register.where("row_order % 10 = 4").select("account", F.concat("serial", F.lit("9"))))
    readings = register.where("row_order % 7 <> 5").select("account", F.col("last").cast("string").alias("reading")).unionAll(register.where("row_order % 13 = 6").select("account", F.lit("77")))
    return training_sets.built(photos, serials, readings)


@query("r09_named_crops", with_("register reads", "").rstrip() + f", {_CROPS}" + """,
crops AS (SELECT photo, account, 'serial' AS kind, 1 AS position, s AS answer FROM built WHERE serial_ = 'made' UNION ALL SELECT photo, account, 'account', 1, '' FROM built WHERE marker = 'made'
 UNION ALL SELECT photo, account, 'digit', p, substr(r, p, 1) FROM built, (SELECT unnest(range(1, 6))::INTEGER AS p) WHERE reading_ = 'made'),
taken AS (SELECT account, 'account' AS kind, 1 AS position, '' AS answer, 2 AS copy FROM register),
n AS (SELECT *, row_number() OVER (PARTITION BY account, kind, position, answer ORDER BY photo) AS n FROM crops)
SELECT photo, kind, position, answer, CASE WHEN kind = 'account' AND n > 1 THEN n + 1 ELSE n END::INTEGER AS copy FROM n""")
def named_crops(spark, sf):
    """All crops of all photos that did not fail, under the least numbers that are free; each account's marker has a second one already."""
    taken = A.register(spark, sf).select("account", F.lit("account").alias("kind"), F.lit(1).alias("position"), F.lit("").alias("answer"), F.lit(2).alias("copy"))
    return training_sets.named(_built(spark, sf), taken)


@query("r09_build_counts", with_("register reads", "").rstrip() + f", {_CROPS} SELECT 'serial' AS kind, serial_ AS state, count(*) AS n FROM built GROUP BY ALL UNION ALL SELECT 'account', marker, count(*) FROM built GROUP BY ALL UNION ALL SELECT 'digit', reading_, count(*) FROM built GROUP BY ALL")
def build_counts(spark, sf):
    return training_sets.kind_counts(_built(spark, sf))


_FILES = """f AS (SELECT ['boxes', 'digits', 'serials', 'accounts'][l_suppkey % 4 + 1] AS kind, l_orderkey * 10 + l_linenumber AS k, l_partkey AS p FROM lineitem),
files AS (SELECT kind || (k % 2)::VARCHAR AS dataset, kind, CASE kind WHEN 'digits' THEN CASE WHEN k % 41 = 0 THEN 'new' ELSE (k % 10)::VARCHAR END ELSE 'images' END AS folder,
 CASE kind WHEN 'boxes' THEN (k // 4)::VARCHAR || CASE WHEN k % 3 = 0 THEN '.txt' ELSE '.jpg' END WHEN 'digits' THEN k::VARCHAR || CASE WHEN p % 29 = 0 THEN '' ELSE '__digit3' END || CASE WHEN p % 31 = 0 THEN '.db' ELSE '.jpg' END
  WHEN 'serials' THEN k::VARCHAR || CASE WHEN p % 13 = 0 THEN '__account1' WHEN p % 11 = 0 THEN '__serial1__12' ELSE '__serial1__12345' END || '.png' ELSE CASE WHEN p % 17 = 0 THEN 'x' ELSE '' END || k::VARCHAR || '__account1.jpg' END AS name, sha256((k % 50000)::VARCHAR || 'c') AS hash FROM f),
lines AS (SELECT dataset, name, CASE WHEN length(hash) > 0 AND substr(hash, 1, 1) < '3' THEN '9 0.5 0.5 0.1 0.1' ELSE '1 0.5 0.5 0.1 0.1' END AS line FROM files WHERE kind = 'boxes' AND name LIKE '%.txt')"""


@query("r11_dataset_problems", f"""WITH {_FILES},
a AS (SELECT *, regexp_replace(name, '[.][^.]*$', '') AS stem, regexp_matches(name, '[.](jpg|png)$') AS image, regexp_extract(name, '__(serial|account|digit)', 1) AS crop FROM files),
pair AS (SELECT dataset, stem, bool_or(NOT image) AS has_label, bool_or(image) AS has_image FROM a WHERE kind = 'boxes' GROUP BY ALL), bad AS (SELECT dataset, name, count(*) FILTER (line LIKE '9%') AS n FROM lines GROUP BY ALL),
same AS (SELECT dataset, hash, count(*) AS copies, min(folder) < max(folder) AS apart FROM a WHERE image GROUP BY ALL),
m AS (SELECT a.*, coalesce(has_label, FALSE) AS has_label, coalesce(has_image, FALSE) AS has_image, coalesce(bad.n, 0) AS bad, image AND coalesce(copies, 1) > 1 AS twice, coalesce(apart, FALSE) AS apart, regexp_matches(folder, '^[0-9]$') AS df FROM a LEFT JOIN pair USING (dataset, stem) LEFT JOIN bad USING (dataset, name) LEFT JOIN same USING (dataset, hash)),
p AS (SELECT dataset, folder, name, unnest(list_filter([CASE WHEN kind = 'boxes' AND image AND NOT has_label THEN 'image without label' END, CASE WHEN kind = 'boxes' AND NOT image AND NOT has_image THEN 'label without image' END, CASE WHEN kind = 'boxes' AND NOT image AND has_image AND bad > 0 THEN 'bad label' END,
 CASE WHEN kind <> 'digits' AND twice THEN 'same content' END, CASE WHEN kind = 'digits' AND df AND twice AND apart THEN 'same content in another digit' END, CASE WHEN kind = 'digits' AND df AND twice AND NOT apart THEN 'same content in a digit' END, CASE WHEN kind = 'digits' AND df AND image AND crop <> 'digit' THEN 'name not of a digit' END,
 CASE WHEN kind = 'digits' AND df AND NOT image THEN 'no image' END, CASE WHEN kind = 'digits' AND NOT df THEN 'folder is not read' END, CASE WHEN kind = 'serials' AND crop <> 'serial' THEN 'name not of a serial' END, CASE WHEN kind = 'serials' AND crop = 'serial' AND name LIKE '%\\_\\_12.png' ESCAPE '\\' THEN 'answer unfit' END, CASE WHEN kind = 'accounts' AND name LIKE 'x%' THEN 'name not of an account' END], lambda x: x IS NOT NULL)) AS problem FROM m)
SELECT dataset, folder, name, problem FROM p""")
def dataset_problems(spark, sf):
    """Every problem of every file of eight data sets of four kinds, from one table of checks."""
    k, p, kind = F.col("k"), F.col("p"), F.col("kind")
    rows = A.table(spark, sf, "lineitem").select(F.element_at(F.array(*[F.lit(x) for x in ("boxes", "digits", "serials", "accounts")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("p"))
    text = k.cast("string")
    name = F.when(kind == "boxes", F.concat(F.floor(k / 4).cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".jpg"))).when(kind == "digits", F.concat(text, F.when(p % 29 == 0, "").otherwise("__digit3"), F.when(p % 31 == 0, ".db").otherwise(".jpg")))
    name = name.when(kind == "serials", F.concat(text, F.when(p % 13 == 0, "__account1").when(p % 11 == 0, "__serial1__12").otherwise("__serial1__12345"), F.lit(".png"))).otherwise(F.concat(F.when(p % 17 == 0, "x").otherwise(""), text, F.lit("__account1.jpg")))
    folder = F.when(kind != "digits", "images").when(k % 41 == 0, "new").otherwise((k % 10).cast("string"))
    files = rows.select(F.concat("kind", (k % 2).cast("string")).alias("dataset"), "kind", folder.alias("folder"), name.alias("name"), F.sha2(F.concat((k % 50000).cast("string"), F.lit("c")), 256).alias("hash"))
    lines = files.where((kind == "boxes") & F.col("name").endswith(".txt")).select("dataset", "name", F.when(F.substring("hash", 1, 1) < "3", "9 0.5 0.5 0.1 0.1").otherwise("1 0.5 0.5 0.1 0.1").alias("line"))
    return dataset_checks.problems(files, lines, 4)
