"""Queries of the monthly cycle, of set operations, rankings and small expressions, by inventory number, and SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, events, lineage, lookups, photos, register
from ..streaming import cycle
from . import analogs as A
from .analogs import table, with_
from .registry import query

_READINGS = "readings AS (SELECT account, last AS value, '2024-01-01' AS date FROM register WHERE row_order % 2 = 0)"


def _readings(spark, sf):
    return A.register(spark, sf).where("row_order % 2 = 0").select("account", F.col("last").alias("value"), F.lit("2024-01-01").alias("date"))


@query("d02_accepted", with_("register reads", "").rstrip() + f", {_READINGS}" + """,
both_ AS (SELECT account, value, date, 'table' AS source, -1 AS seq FROM readings UNION ALL SELECT owner, reading, strftime(day, '%Y-%m-%d'), 'manual', photo FROM reads)
SELECT account, value, date, source FROM both_ QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq DESC) = 1""")
def accepted(spark, sf):
    new = A.reads(spark, sf).select(F.col("photo").alias("seq"), F.col("owner").alias("account"), F.col("reading").alias("value"), F.date_format("day", "yyyy-MM-dd").alias("date"))
    return events.readings_after(_readings(spark, sf).withColumn("source", F.lit("table")), new)


@query("d02_changes", with_("register reads", "").rstrip() + f", {_READINGS}" + """
SELECT owner AS account, coalesce(lag(reading) OVER (PARTITION BY owner ORDER BY photo), readings.value) AS old, reading AS new FROM reads LEFT JOIN readings ON readings.account = owner""")
def changes(spark, sf):
    new = A.reads(spark, sf).select(F.col("photo").alias("seq"), F.col("owner").alias("account"), F.col("reading").alias("value"))
    return events.changes_of(_readings(spark, sf), new)


_CORRECTIONS = """corrections AS (SELECT photo AS seq, owner AS old_account, CASE WHEN photo % 3 = 0 THEN last ELSE reading END AS logged, CASE WHEN photo % 2 = 0 THEN owner ELSE (1 + (owner::BIGINT * 7) % 1500)::VARCHAR END AS account, reading AS value
 FROM reads JOIN register ON owner = register.account)"""


@query("d04_corrected", with_("register reads", "").rstrip() + f", {_READINGS}, {_CORRECTIONS}" + """,
kept AS (SELECT * FROM readings WHERE (account, value) NOT IN (SELECT old_account, logged FROM corrections WHERE old_account <> account)),
fresh AS (SELECT c.account, c.value, r.date FROM (SELECT * FROM corrections QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq DESC) = 1) c LEFT JOIN readings r ON r.account = c.old_account)
SELECT coalesce(kept.account, fresh.account) AS account, coalesce(fresh.value, kept.value) AS value, coalesce(fresh.date, kept.date) AS date FROM kept FULL JOIN fresh ON kept.account = fresh.account""")
def corrected(spark, sf):
    met = A.reads(spark, sf).join(A.register(spark, sf), F.expr("owner = account"))
    other = (F.lit(1) + (F.col("owner").cast("bigint") * 7) % 1500).cast("string")
    rows = met.select(
        F.col("photo").alias("seq"), F.col("owner").alias("old_account"), F.when(F.col("photo") % 3 == 0, F.col("last")).otherwise(F.col("reading")).alias("logged"),
        F.when(F.col("photo") % 2 == 0, F.col("owner")).otherwise(other).alias("account"), F.col("reading").alias("value"),
    )
    return events.corrected_readings(_readings(spark, sf), rows)


@query("d05_verified", with_("runs", """, marks AS (SELECT event_id * 3 % 20000 AS seq, event_type AS who, event_id AS stamp FROM events)
SELECT r.seq, coalesce(m.who, '') AS verified_by FROM runs r LEFT JOIN (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY seq ORDER BY stamp DESC) = 1) m USING (seq)"""))
def verified(spark, sf):
    marks = table(spark, sf, "events").select((F.col("event_id") * 3 % 20000).alias("seq"), F.col("event_type").alias("who"), F.col("event_id").alias("at"))
    return events.verified(A.runs(spark, sf), marks).select("seq", "verified_by")


@query("d06_table_readings", with_("register", "").rstrip() + f", {_READINGS} SELECT account, last::DOUBLE AS value FROM register WHERE row_order % 3 = 0 AND account NOT IN (SELECT account FROM readings)")
def table_readings(spark, sf):
    rows = A.register(spark, sf).withColumn("reading", F.when(F.col("row_order") % 3 == 0, F.col("last").cast("string")).otherwise(""))
    return events.table_readings(rows, _readings(spark, sf))


@query("w12_first_rows", with_("reads", "SELECT owner AS account, photo AS row_order, serial_read AS serial FROM reads QUALIFY row_number() OVER (PARTITION BY owner ORDER BY photo) = 1"))
def first_rows(spark, sf):
    rows = A.reads(spark, sf).select(F.col("owner").alias("account"), F.col("photo").alias("row_order"), F.col("serial_read").alias("serial"))
    return register.first_rows(rows)


@query("w14_latest_fixes", with_("log", "SELECT account, arg_max(outcome, seq) AS serial FROM log GROUP BY account"))
def latest_fixes(spark, sf):
    return events.latest_fixes(A.log(spark, sf).select("account", F.col("seq").alias("id"), F.col("outcome").alias("new")))


@query("j03_rows_of_account", with_("runs", "SELECT seq, outcome FROM runs WHERE account = '42' AND source = 'auto'"))
def rows_of_account(spark, sf):
    return A.runs(spark, sf).where("account = '42' and source = 'auto'").select("seq", "outcome")


@query("j25_merged_with_fixes", with_("register next_register log", """, fixed AS (SELECT account, arg_max(outcome, seq) AS f FROM log GROUP BY account)
SELECT coalesce(r.account, n.account) AS account, coalesce(f, n.serial, r.serial) AS serial, coalesce(n.last, r.last) AS last, n.account IS NOT NULL AS in_table
FROM register r FULL JOIN next_register n ON r.account = n.account LEFT JOIN fixed ON fixed.account = coalesce(r.account, n.account)"""))
def merged_with_fixes(spark, sf):
    old = A.register(spark, sf).withColumn("in_table", F.lit(True)).drop("row_order")
    fixes = A.log(spark, sf).select("account", F.col("seq").alias("id"), F.col("outcome").alias("new"))
    return register.merged(old, A.next_register(spark, sf), fixes)


@query("k07_upsert", with_("register next_register", """SELECT account, serial, last FROM (SELECT account, serial, last, 0 AS v FROM register UNION ALL SELECT account, serial, last, 1 FROM next_register) QUALIFY row_number() OVER (PARTITION BY account ORDER BY v DESC) = 1"""))
def upsert(spark, sf):
    side = lambda df, v: df.select("account", "serial", "last", F.lit(v).alias("v"))
    return register.upserted(side(A.register(spark, sf), 0), side(A.next_register(spark, sf), 1), "account", "v").drop("v")


@query("r07_checked", with_("runs", """, a AS (SELECT seq AS key, outcome AS reason, '0' || serial AS serial, reading FROM runs), p AS (SELECT seq AS key, CASE WHEN seq % 5 = 0 THEN 'x' ELSE serial END AS serial, conf, CASE WHEN seq % 3 = 0 THEN reading WHEN seq % 3 = 1 THEN reading + 1 END AS number FROM runs)
SELECT key, reason, p.serial <> 'x' AND conf >= 0.6 AS serial_ok, coalesce(number = reading, FALSE) AS reading_ok, (conf >= 0.6 AND p.serial = 'x') OR (number IS NOT NULL AND number <> reading) AS wrong_sure FROM a JOIN p USING (key)"""))
def checked(spark, sf):
    k, rows = F.col("seq"), A.runs(spark, sf)
    answers = rows.select(k.alias("key"), F.col("outcome").alias("reason"), F.concat(F.lit("0"), "serial").alias("serial"), "reading")
    number = F.when(k % 3 == 0, F.col("reading")).when(k % 3 == 1, F.col("reading") + 1)
    return events.checked(rows.select(k.alias("key"), F.when(k % 5 == 0, "x").otherwise(F.col("serial")).alias("serial"), F.col("conf").alias("serial_conf"), number.alias("number")), answers, 0.6)


@query("t02_first_success_stream", with_("log", """SELECT seq, account, CASE WHEN outcome IN ('PLUS', 'MINUS') AND row_number() OVER (PARTITION BY account, outcome IN ('PLUS', 'MINUS') ORDER BY seq) > 1 THEN 'REPEAT' ELSE outcome END AS decided FROM log"""))
def first_success_stream(spark, sf):
    """The stateful stream over the events file, all that is there, written batch by batch to the shared folder and read again."""
    folder = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = A.log(spark, sf).select("seq", "account", "photo_hash", "outcome")
    rows.write.parquet(f"{folder}/in")
    stream = cycle.first_success_stream(cycle.new_files(spark, f"{folder}/in", cycle.RESULT))
    cycle.run_available(stream, cycle.idempotent_sink(f"{folder}/out"), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("seq", "account", "decided")


@query("t03_distinct_contents", with_("runs", "SELECT photo_hash, count(*) AS n FROM (SELECT DISTINCT photo_hash FROM runs WHERE photo_hash <> '' UNION ALL SELECT photo_hash FROM runs WHERE photo_hash = '') GROUP BY 1"))
def distinct_contents(spark, sf):
    return cycle.distinct_contents(A.runs(spark, sf)).groupBy("photo_hash").agg(F.count(F.lit(1)).alias("n"))


@query("t05_reread", with_("register runs", """, states AS (SELECT folder, name, serial, outcome, source FROM runs WHERE NOT starts_with(notes, 'copy of') QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY seq DESC) = 1),
f AS (SELECT *, serial IN (SELECT serial FROM register) OR '0' || serial IN (SELECT serial FROM register) OR '00' || serial IN (SELECT serial FROM register) AS found FROM states)
SELECT folder, name, serial FROM f WHERE found AND (source = 'manual' AND outcome = 'NOT_IN_DB' OR source = 'auto' AND outcome = 'SERIAL_NOT_FOUND')"""))
def reread(spark, sf):
    return cycle.reread(A.runs(spark, sf), A.register(spark, sf))


@query("u01_log_union", with_("runs register", "SELECT source, count(*) AS n FROM (SELECT source FROM runs UNION ALL SELECT 'pre_existing' FROM register WHERE last > 5000) GROUP BY 1"))
def log_union(spark, sf):
    """Log rows and rows made up for readings that were there before; columns that one side lacks are null."""
    made = A.register(spark, sf).where("last > 5000").select("account", F.lit("pre_existing").alias("source"))
    return A.runs(spark, sf).unionByName(made, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u02_common_serials", with_("register reads", "SELECT serial_read AS serial FROM reads INTERSECT SELECT serial FROM register"))
def common_serials(spark, sf):
    return A.reads(spark, sf).select(F.col("serial_read").alias("serial")).intersect(A.register(spark, sf).select("serial"))


@query("u06_ordered_distinct", with_("log", "SELECT account, list_distinct_ordered AS outcomes FROM (SELECT account, list(outcome ORDER BY f) AS list_distinct_ordered FROM (SELECT account, outcome, min(seq) AS f FROM log GROUP BY ALL) GROUP BY account)"))
def ordered_distinct(spark, sf):
    """An account's outcomes in the order in which they first came, from their first rows only."""
    first = A.log(spark, sf).groupBy("account", "outcome").agg(F.min("seq").alias("f"))
    return first.groupBy("account").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "outcome"))), lambda x: x["outcome"]).alias("outcomes"))


@query("o02_top_readings", with_("reads", "SELECT owner, photo, reading FROM reads QUALIFY row_number() OVER (PARTITION BY owner ORDER BY reading DESC, photo) <= 3"))
def top_readings(spark, sf):
    return lookups.top(A.reads(spark, sf), ["owner"], 3, F.desc("reading"), F.col("photo")).select("owner", "photo", "reading")


@query("o04_review_order", with_("reads texts", """SELECT photo, conf, row_number() OVER (ORDER BY conf, photo) AS place FROM texts WHERE "read" <> "true" OR conf < 0.6"""))
def review_order(spark, sf):
    """All that was read wrongly or unsurely, the least sure first."""
    rows = A.texts(spark, sf).where((F.col("read") != F.col("true")) | (F.col("conf") < 0.6)).select("photo", "conf")
    return lookups.placed(rows, "conf", "photo")


@query("s17_waiting_counts", with_("runs", """SELECT outcome, count(*) AS n FROM (SELECT outcome FROM runs WHERE NOT starts_with(notes, 'copy of') QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY seq DESC) = 1) WHERE outcome IN ('NO_METER', 'SERIAL_NOT_FOUND', 'DIGITS_ERROR', 'SUSPICIOUS') GROUP BY 1"""))
def waiting_counts(spark, sf):
    last = lookups.pick_last(photos.meaningful(A.runs(spark, sf)), ["folder", "name"], F.desc("seq"))
    return last.where(F.col("outcome").isin(*photos.FAILED) & (F.col("outcome") != "ERROR")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s21_answers_of_account", with_("register reads", "SELECT account, list_sort(list(DISTINCT serial)) AS serials, list_sort(list(DISTINCT reading)) AS readings FROM register JOIN reads ON owner = account GROUP BY account"))
def answers_of_account(spark, sf):
    met = A.register(spark, sf).join(A.reads(spark, sf), F.expr("owner = account"))
    return met.groupBy("account").agg(F.array_sort(F.collect_set("serial")).alias("serials"), F.array_sort(F.collect_set("reading")).alias("readings"))


@query("p18_verify_queue", with_("runs", "SELECT seq FROM runs WHERE source = 'auto' AND verified_by = '' AND outcome IN ('PLUS', 'MINUS')"))
def verify_queue(spark, sf):
    return A.runs(spark, sf).where("source = 'auto' and verified_by = '' and outcome in ('PLUS', 'MINUS')").select("seq")


@query("p09_operator_choice", with_("runs", "SELECT seq, CASE WHEN starts_with(notes, 'corrected') THEN 'CORRECTED' ELSE outcome END AS choice FROM runs WHERE source = 'auto'"))
def operator_choice(spark, sf):
    return A.runs(spark, sf).where("source = 'auto'").select("seq", F.when(F.col("notes").startswith("corrected"), "CORRECTED").otherwise(F.col("outcome")).alias("choice"))


@query("f12_account_of_photo", with_("runs", "SELECT seq, CASE WHEN length(seq::VARCHAR) >= 3 THEN seq::VARCHAR ELSE '' END AS account FROM runs"))
def account_of_photo(spark, sf):
    return A.runs(spark, sf).select("seq", F.regexp_extract(F.concat(F.col("seq").cast("string"), F.lit("-2.jpg")), "^([0-9]{3,})", 1).alias("account"))


@query("f15_month_label", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def month_label(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.month_label(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("month"))


@query("f29_scaled_boxes", with_("boxes", "SELECT photo, x1, trunc(x1 * 1.7::DOUBLE)::INTEGER AS sx1, trunc(x2 * 1.7::DOUBLE)::INTEGER AS sx2 FROM boxes"))
def scaled_boxes(spark, sf):
    scale = lambda c: (F.col(c) * 1.7).cast("int")
    return A.boxes(spark, sf).select("photo", "x1", scale("x1").alias("sx1"), scale("x2").alias("sx2"))


@query("f33_label_line", with_("boxes", "SELECT photo, x1, printf('%d %.6f %.6f', digit, x1 / 1000.0::DOUBLE, x2 / 1000.0::DOUBLE) AS line FROM boxes"))
def label_line(spark, sf):
    return A.boxes(spark, sf).select("photo", "x1", F.format_string("%d %.6f %.6f", "digit", F.col("x1") / 1000.0, F.col("x2") / 1000.0).alias("line"))


@query("f34_output_stem", "SELECT doc_id, source || '__' || doc_id::VARCHAR AS stem FROM documents")
def output_stem(spark, sf):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf, "documents").select("doc_id", scalars.output_stem(path).alias("stem"))


@query("a16_reason_counts", with_("runs", "SELECT outcome AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM runs GROUP BY 1"))
def reason_counts(spark, sf):
    return analytics.common(A.runs(spark, sf).select("seq", F.col("outcome").alias("reason")), "reason")


@query("a29_table_readings", with_("register", "SELECT count(*) FILTER (account <> '' AND last > 0) AS n FROM register"))
def table_readings_count(spark, sf):
    return A.register(spark, sf).agg(F.count_if((F.col("account") != "") & (F.col("last") > 0)).alias("n"))
