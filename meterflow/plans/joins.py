"""Queries of the photo, fuzzy and lexicon joins, by inventory number, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import plausible
from ..operators import lookups, photos
from . import analogs as A
from .analogs import table, with_
from .registry import query

_FILES = """files AS (SELECT DISTINCT 'p' || (event_id % 4001)::VARCHAR || '.jpg' AS file_name, CASE WHEN event_id % 8 = 7 THEN '' ELSE 'f' || (event_id % 8)::VARCHAR END AS folder,
CASE WHEN event_id % 2 = 0 THEN 'PLUS' ELSE 'MINUS' END AS outcome FROM events)"""


def _files(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("p"), (k % 4001).cast("string"), F.lit(".jpg")).alias("file_name"),
        F.when(k % 8 == 7, "").otherwise(F.concat(F.lit("f"), (k % 8).cast("string"))).alias("folder"),
        F.when(k % 2 == 0, "PLUS").otherwise("MINUS").alias("outcome"),
    ).distinct()


@query("j07_output_row", with_("runs", "").rstrip() + f", {_FILES}" + """, wanted AS (SELECT DISTINCT file_name, folder FROM files)
SELECT w.folder, w.file_name, r.seq FROM wanted w JOIN runs r ON w.file_name = CASE WHEN r.final_name = '' THEN r.name ELSE r.final_name END AND r.source = 'auto' AND (r.folder = w.folder OR r.folder = '')
QUALIFY row_number() OVER (PARTITION BY w.folder, w.file_name ORDER BY r.folder <> w.folder, r.seq DESC) = 1""")
def output_row(spark, sf):
    return photos.output_rows(_files(spark, sf).select("file_name", "folder").distinct(), A.runs(spark, sf))


@query("j08_verify_row", with_("runs", "").rstrip() + f", {_FILES}" + """
SELECT f.file_name, f.folder, f.outcome, r.seq FROM files f JOIN runs r ON r.outcome = f.outcome AND r.source = 'auto' AND r.verified_by = ''
 AND (f.file_name IN (r.name, r.final_name) OR replace(f.file_name, '.jpg', '') IN (replace(r.name, '.jpg', ''), replace(r.final_name, '.jpg', '')))
QUALIFY row_number() OVER (PARTITION BY f.file_name, f.folder, f.outcome ORDER BY r.folder <> f.folder, r.seq DESC) = 1""")
def verify_row(spark, sf):
    return photos.verify_rows(_files(spark, sf), A.runs(spark, sf))


@query("j11_not_found_kinds", with_("register reads", """SELECT s AS serial, CASE WHEN EXISTS (SELECT 1 FROM register WHERE levenshtein(s, serial) = 1 OR levenshtein('0' || s, serial) = 1 OR levenshtein('00' || s, serial) = 1) THEN 'one_edit'
 WHEN length(s) >= 3 AND EXISTS (SELECT 1 FROM register WHERE contains(serial, s)) THEN 'truncated' ELSE 'none' END AS kind FROM (SELECT DISTINCT serial_read AS s FROM reads)"""))
def not_found_kinds(spark, sf):
    return lookups.not_found_kinds(A.reads(spark, sf), A.register(spark, sf))


@query("j13_serial_choices", with_("register reads", "SELECT photo, serial, account, min(row_order) AS row_order FROM reads JOIN register ON serial_read = serial GROUP BY ALL"))
def serial_choices(spark, sf):
    return lookups.serial_choices(A.reads(spark, sf).select("photo", F.col("serial_read").alias("serial")), A.register(spark, sf))


@query("j14_serial_index", with_("register", "SELECT serial, account, last FROM register WHERE serial <> '' QUALIFY row_number() OVER (PARTITION BY serial ORDER BY row_order) = 1"))
def serial_index(spark, sf):
    return lookups.pick_last(A.register(spark, sf).where("serial <> ''"), ["serial"], F.col("row_order")).select("serial", "account", "last")


#: The candidates of each unread serial, and those that fit, as SQL over `asked` (serial, model_reading).
_GUESS = """first AS (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY serial ORDER BY row_order) = 1),
serials AS (SELECT DISTINCT serial AS s FROM runs),
near AS (SELECT s, first.serial AS candidate, first.last FROM serials JOIN first ON levenshtein(s, first.serial) = 1 OR levenshtein('0' || s, first.serial) = 1 OR levenshtein('00' || s, first.serial) = 1),
asked AS (SELECT DISTINCT serial, model_reading FROM runs),
guess AS (SELECT asked.serial, model_reading, count(candidate) AS candidates, count(candidate) FILTER (fit) AS fits, min(candidate) FILTER (fit) AS one FROM
  (SELECT asked.*, candidate, regexp_full_match(model_reading, '[0-9]+') AND try_cast(model_reading AS BIGINT) - last BETWEEN -1500 AND 3000 AS fit FROM asked LEFT JOIN near ON s = serial) asked GROUP BY ALL)"""


@query("j15_guess_serial", with_("register runs", "").rstrip() + f", {_GUESS}" + """
SELECT seq, candidates, fits, CASE WHEN fits = 1 THEN one END AS guess FROM runs JOIN guess USING (serial, model_reading) WHERE outcome = 'SERIAL_NOT_FOUND'""")
def guess_serial(spark, sf):
    rows = A.runs(spark, sf).where("outcome = 'SERIAL_NOT_FOUND'").select("seq", "serial", "model_reading")
    return lookups.guesses(rows, A.register(spark, sf), -1500, 3000).select("seq", "candidates", "fits", "guess")


@query("j16_reading_check", with_("register runs", "").rstrip() + f", {_GUESS}" + """
SELECT CASE WHEN candidates = 1 THEN 'one' ELSE 'several' END AS similar, CASE WHEN fits = 0 THEN 'none' WHEN fits = 1 THEN 'exactly one' ELSE 'many' END AS fitting, count(*) AS n
FROM runs JOIN guess USING (serial, model_reading) WHERE outcome = 'SERIAL_NOT_FOUND' AND candidates > 0 AND regexp_full_match(model_reading, '[0-9]+') GROUP BY ALL""")
def reading_check(spark, sf):
    rows = A.runs(spark, sf).where("outcome = 'SERIAL_NOT_FOUND'").select("seq", "serial", "model_reading")
    found = lookups.guesses(rows, A.register(spark, sf), -1500, 3000).where("candidates > 0").where(F.col("model_reading").rlike("^[0-9]+$"))
    similar, fitting = F.when(F.col("candidates") == 1, "one").otherwise("several"), F.when(F.col("fits") == 0, "none").when(F.col("fits") == 1, "exactly one").otherwise("many")
    return found.groupBy(similar.alias("similar"), fitting.alias("fitting")).agg(F.count(F.lit(1)).alias("n"))


_ANSWERED = """answered AS (SELECT m.seq AS manual_seq, m.outcome AS manual_outcome, m.serial AS manual_serial, a.seq AS auto_seq, a.serial, a.model_reading FROM runs m JOIN (
  SELECT * FROM runs WHERE source = 'auto' AND photo_hash <> '' QUALIFY row_number() OVER (PARTITION BY photo_hash ORDER BY seq DESC) = 1) a USING (photo_hash)
  WHERE m.source = 'manual' AND a.outcome = 'SERIAL_NOT_FOUND')"""


@query("j17_answered_failures", with_("runs", "").rstrip() + f", {_ANSWERED} SELECT manual_seq, auto_seq, manual_outcome FROM answered")
def answered_failures(spark, sf):
    return photos.answered_failures(A.runs(spark, sf)).select("manual_seq", "auto_seq", "manual_outcome")


@query("j18_guess_details", with_("register runs", "").rstrip() + f", {_ANSWERED}, {_GUESS}" + """
SELECT manual_seq, CASE WHEN g IS NULL THEN '-' WHEN manual_outcome IN ('PLUS', 'MINUS', 'SUSPICIOUS') AND g = manual_serial THEN 'right' WHEN manual_outcome = 'NOT_IN_DB' THEN 'not in table'
 WHEN manual_outcome IN ('PLUS', 'MINUS', 'SUSPICIOUS') THEN 'other serial' ELSE '?' END AS verdict FROM (SELECT *, CASE WHEN fits = 1 THEN one END AS g FROM answered JOIN guess USING (serial, model_reading))""")
def guess_details(spark, sf):
    return lookups.judged(lookups.guesses(photos.answered_failures(A.runs(spark, sf)), A.register(spark, sf), -1500, 3000)).select("manual_seq", "verdict")


_KEY = "coalesce(nullif(trim(photo_hash), ''), 'name:' || folder || '/' || name)"


@query("w08_hard_answers", with_("runs", f""", folded AS (SELECT {_KEY} AS key,
 max(struct_pack(seq := seq, serial := serial, reading := reading, reason := outcome)) FILTER (source = 'auto' AND outcome IN ('NO_METER', 'SERIAL_NOT_FOUND', 'DIGITS_ERROR', 'SUSPICIOUS')) AS f,
 max(struct_pack(seq := seq, serial := serial, reading := reading)) FILTER (source = 'manual' AND outcome IN ('PLUS', 'MINUS')) AS m,
 max(struct_pack(seq := seq, serial := serial, reading := reading)) FILTER (source = 'auto' AND outcome IN ('PLUS', 'MINUS') AND contains(notes, 'corrected at check')) AS c FROM runs GROUP BY 1)
SELECT key, CASE WHEN f IS NOT NULL AND m IS NOT NULL THEN m.serial ELSE c.serial END AS serial, CASE WHEN f IS NOT NULL AND m IS NOT NULL THEN m.reading ELSE c.reading END AS reading,
 CASE WHEN f IS NOT NULL AND m IS NOT NULL THEN f.reason ELSE 'CORRECTED' END AS reason FROM folded WHERE f IS NOT NULL AND m IS NOT NULL OR c IS NOT NULL"""))
def hard_answers(spark, sf):
    return photos.hard_answers(A.runs(spark, sf))


@query("j22_new_answers", with_("runs", f""", known AS (SELECT {_KEY} AS key FROM runs WHERE seq % 2 = 0) SELECT seq FROM (SELECT seq, {_KEY} AS key FROM runs WHERE source = 'manual') ANTI JOIN known USING (key)"""))
def new_answers(spark, sf):
    key = F.coalesce(F.nullif(F.trim("photo_hash"), F.lit("")), F.concat(F.lit("name:"), F.col("folder"), F.lit("/"), F.col("name"))).alias("key")
    rows = A.runs(spark, sf)
    return photos.new_answers(rows.where("source = 'manual'").select("seq", key), rows.where("seq % 2 = 0").select(key)).select("seq")


@query("j23_found_files", with_("runs", """, files AS (SELECT folder, name, photo_hash, folder || '/' || name || '#' || (seq % 2)::VARCHAR AS path FROM runs WHERE photo_hash <> '' AND source = 'auto'
 QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY seq DESC) = 1),
answers AS (SELECT DISTINCT 'f1' AS folder, name AS file, photo_hash FROM runs WHERE source = 'manual' AND photo_hash <> '')
SELECT a.file, a.folder, CASE WHEN n.photo_hash = a.photo_hash THEN n.path ELSE h.path END AS path FROM answers a LEFT JOIN files n ON n.folder = a.folder AND n.name = a.file
LEFT JOIN (SELECT photo_hash, min(path) AS path FROM files GROUP BY 1) h ON h.photo_hash = a.photo_hash"""))
def found_files(spark, sf):
    rows = A.runs(spark, sf).where("photo_hash <> ''")
    files = lookups.pick_last(rows.where("source = 'auto'"), ["folder", "name"], F.desc("seq"))
    files = files.select("folder", "name", "photo_hash", F.concat("folder", F.lit("/"), "name", F.lit("#"), (F.col("seq") % 2).cast("string")).alias("path"))
    answers = rows.where("source = 'manual'").select(F.lit("f1").alias("folder"), F.col("name").alias("file"), "photo_hash").distinct()
    return photos.found_files(answers, files).select("file", "folder", "path")


@query("j26_truths", with_("register reads", """SELECT photo, list_sort(list(DISTINCT account)) AS accounts, max(reading) AS reading FROM reads JOIN register ON ltrim(serial_read, '0') = ltrim(serial, '0') GROUP BY photo"""))
def truths(spark, sf):
    return lookups.truths(A.reads(spark, sf), A.register(spark, sf))


@query("j27_dense_ids", "SELECT lpad(unnest(range(min(c_custkey), max(c_custkey) + 1))::VARCHAR, 8, '0') AS account FROM customer")
def dense_ids(spark, sf):
    return lookups.dense_ids(A.register(spark, sf), 8)


@query("j29_verify_correction", with_("register reads", """, first AS (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY serial ORDER BY row_order) = 1),
tried AS (SELECT photo, reading, first.account, first.last, p FROM reads, (VALUES (0, ''), (1, '0'), (2, '00')) v(p, z) JOIN first ON first.serial = z || serial_read)
SELECT photo, account, (reading - last)::BIGINT AS delta, CASE WHEN reading >= last THEN 'PLUS' ELSE 'MINUS' END AS outcome FROM tried QUALIFY row_number() OVER (PARTITION BY photo ORDER BY p) = 1"""))
def verify_correction(spark, sf):
    return lookups.corrected(A.reads(spark, sf), A.register(spark, sf)).select("photo", "account", "delta", "outcome")


@query("u08_shared_accounts", "SELECT count(DISTINCT o_custkey) AS n FROM orders SEMI JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0")
def shared_accounts(spark, sf):
    """Accounts that two sets share (inventory rows J30 and U8)."""
    known = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(known, "o_custkey", "left_semi").agg(F.countDistinct("o_custkey").alias("n"))


@query("j31_collect_files", """SELECT doc_id, source || '/' || CASE WHEN n = 1 THEN lang ELSE lang || '_' || n::VARCHAR END AS target FROM (
SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM (
 SELECT * FROM (SELECT doc_id, source, lang, sha256(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1)
 ANTI JOIN (SELECT source, sha256(text) AS h FROM documents WHERE doc_id % 10 = 0) t USING (source, h)))""")
def collect_files(spark, sf):
    """Files whose content their folder has not got, once each, under names that are free there."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    there = docs.where("doc_id % 10 = 0").select("source", "h")
    fresh = docs.groupBy("source", "h").agg(F.min(F.struct("doc_id", "lang")).alias("x")).join(there, ["source", "h"], "left_anti").select("source", "x.*")
    return lookups.numbered(fresh, ["source", "lang"], "doc_id").select("doc_id", F.concat("source", F.lit("/"), "lang", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")).alias("target"))


_PHOTOS = """photos AS (SELECT event_id AS photo, 'p' || (event_id % 5003)::VARCHAR || '.jpg' AS name, CASE WHEN event_id % 4 = 0 THEN '' ELSE sha256('p' || (event_id % 5003)::VARCHAR || '.jpg') END AS photo_hash FROM events)"""


@query("w06_processed", with_("runs", "").rstrip() + f", {_PHOTOS}" + """, rows AS (SELECT * FROM runs WHERE NOT starts_with(notes, 'copy of')),
met AS (SELECT p.photo, r.seq, r.source, r.outcome FROM photos p JOIN rows r ON p.photo_hash <> '' AND r.photo_hash <> '' AND p.photo_hash = r.photo_hash
 UNION ALL SELECT p.photo, r.seq, r.source, r.outcome FROM photos p JOIN rows r ON (p.photo_hash = '' OR r.photo_hash = '') AND p.name = r.name),
folded AS (SELECT photo, max(seq) FILTER (source = 'manual') AS m, max(seq) FILTER (outcome IN ('PLUS', 'MINUS', 'REPEAT')) AS d FROM met GROUP BY 1)
SELECT photo, m IS NOT NULL OR d IS NOT NULL AS skip, CASE WHEN m IS NOT NULL THEN 'manual' WHEN d IS NOT NULL THEN 'done' END AS reason, coalesce(m, d) AS "row" FROM photos LEFT JOIN folded USING (photo)""")
def processed(spark, sf):
    k = F.col("event_id")
    name = F.concat(F.lit("p"), (k % 5003).cast("string"), F.lit(".jpg"))
    asked = table(spark, sf, "events").select(k.alias("photo"), name.alias("name"), F.when(k % 4 == 0, "").otherwise(F.sha2(name, 256)).alias("photo_hash"))
    return photos.processed(asked, A.runs(spark, sf))


@query("w07_duplicates", with_("runs", """, reads AS (SELECT event_id AS photo, '0' || (event_id % 3000)::VARCHAR AS account, event_id % 3 = 0 AS filled, event_id % 10 = 0 AS in_run FROM events),
flags AS (SELECT account::BIGINT AS a, bool_or(outcome IN ('PLUS', 'MINUS')) AS good FROM runs GROUP BY 1)
SELECT photo, CASE WHEN in_run THEN 'REPEAT' WHEN NOT filled THEN NULL WHEN good THEN 'REPEAT' ELSE 'SUSPICIOUS' END AS decided FROM reads LEFT JOIN flags ON a = account::BIGINT"""))
def duplicates(spark, sf):
    k = F.col("event_id")
    reads = table(spark, sf, "events").select(k.alias("photo"), F.concat(F.lit("0"), (k % 3000).cast("string")).alias("account"), (k % 3 == 0).alias("filled"), (k % 10 == 0).alias("in_run"))
    return photos.duplicates(reads, A.runs(spark, sf)).select("photo", "decided")


@query("w13_close_waiting", with_("runs", """, last AS (SELECT *, coalesce(nullif(photo_hash, ''), 'name:' || name) AS key FROM runs WHERE NOT starts_with(notes, 'copy of')
 QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(photo_hash, ''), 'name:' || name) ORDER BY seq DESC) = 1)
SELECT key, account, seq FROM last WHERE outcome IN ('DIGITS_ERROR', 'SUSPICIOUS') AND account IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'click')"""))
def close_waiting(spark, sf):
    readings = A.log(spark, sf).where("outcome = 'PLUS'").select("account")
    return photos.closed_by(readings, A.runs(spark, sf))


@query("p07_plausible", with_("register reads", "SELECT photo, coalesce(reading - last BETWEEN -1500 AND 3000, FALSE) AS plausible FROM reads LEFT JOIN register ON account = owner"))
def plausible_readings(spark, sf):
    met = A.reads(spark, sf).join(A.register(spark, sf), F.expr("owner = account"), "left")
    return met.select("photo", plausible(F.col("reading"), F.col("last")).alias("plausible"))
