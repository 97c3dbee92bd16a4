"""Queries of a whole run: the decision of each photo in one plan, and the same month in batches, with SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import decisions, lineage, lookups, month, photos, session, states
from ..streaming import cycle
from . import analogs as A
from .analogs import with_
from .registry import query

_FIELDS = """k % 101 = 0 AS failed, k % 13 <> 0 AS meter, CASE WHEN k % 11 <> 0 THEN serial_read END AS serial, (k * 37 % 1000) / 1000.0::DOUBLE AS serial_conf,
 CASE WHEN k % 5 = 0 THEN ((k * 17) % 1201)::VARCHAR END AS table_serial, (k * 53 % 1000) / 1000.0::DOUBLE AS table_conf, CASE WHEN k % 3 = 0 THEN owner END AS marker, (k * 29 % 1000) / 1000.0::DOUBLE AS marker_conf,
 CASE WHEN k % 9 <> 0 THEN reading END AS reading, 'low_conf' AS digit_error"""
_PHOTOS = f"""photos AS (SELECT k AS photo, name, CASE WHEN k % 4 = 0 THEN '' WHEN k % 10 = 0 THEN sha256(name) ELSE sha256('c' || (k // 3)::VARCHAR) END AS photo_hash, k % 50 = 0 AS reread, {_FIELDS}
 FROM (SELECT *, photo AS k, CASE WHEN photo % 10 = 0 THEN 'p' || (photo % 997)::VARCHAR ELSE 'q' || photo::VARCHAR END || '.jpg' AS name FROM reads))"""
#: The photos that a run reads: the first of each key, if the log has nothing of it or an ERROR. No serial of the log is known.
_CHOSEN = f"""{_PHOTOS.replace("photos AS", "all_photos AS", 1)},
lasts AS (SELECT *, coalesce(nullif(photo_hash, ''), 'name:' || name) AS key FROM log WHERE NOT starts_with(notes, 'copy of') QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(photo_hash, ''), 'name:' || name) ORDER BY seq DESC) = 1),
keyed AS (SELECT p.*, coalesce(nullif(photo_hash, ''), 'name:' || name) AS key FROM all_photos p QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(photo_hash, ''), 'name:' || name) ORDER BY photo) = 1),
photos AS (SELECT keyed.* REPLACE (TRUE AS reread) FROM keyed LEFT JOIN lasts l USING (key) WHERE l.key IS NULL OR (l.source <> 'manual' AND l.outcome = 'ERROR'))"""

#: The steps of decisions.decided over photos, reg and log, for photos without notes.
_DECIDED = """reg AS (SELECT account, trim(serial) AS serial, last::DOUBLE AS last, row_order % 6 = 0 AS filled, row_order FROM register),
met AS (SELECT p.photo, l.seq, l.source, l.outcome FROM photos p JOIN log l ON p.photo_hash <> '' AND l.photo_hash <> '' AND p.photo_hash = l.photo_hash WHERE NOT starts_with(l.notes, 'copy of')
 UNION ALL SELECT p.photo, l.seq, l.source, l.outcome FROM photos p JOIN log l ON (p.photo_hash = '' OR l.photo_hash = '') AND p.name = l.name WHERE NOT starts_with(l.notes, 'copy of')),
seen AS (SELECT photo, max(seq) FILTER (source = 'manual') AS m, max(seq) FILTER (outcome IN ('PLUS', 'MINUS', 'REPEAT')) AS d FROM met GROUP BY 1),
s0 AS (SELECT p.*, coalesce(s.m, s.d) AS seen_row, CASE WHEN m IS NOT NULL THEN 'manual' WHEN d IS NOT NULL THEN 'done' END AS reason,
 p.photo_hash <> '' AND row_number() OVER (PARTITION BY p.photo_hash ORDER BY p.photo) > 1 AS copy FROM photos p LEFT JOIN seen s USING (photo)),
s1 AS (SELECT *, (reason IS NOT NULL OR copy) AND NOT reread AS repeat, NOT failed AND NOT ((reason IS NOT NULL OR copy) AND NOT reread) AND meter AS open FROM s0),
tried AS (SELECT photo, marker, p, r.* FROM s1, (VALUES (0, ''), (1, '0'), (2, '00')) v(p, z) JOIN reg r ON r.serial = z || s1.serial WHERE open AND serial_conf >= 0.3 QUALIFY p = min(p) OVER (PARTITION BY photo)),
plain AS (SELECT photo, count(DISTINCT account) AS n, min({'row_order': row_order, 'account': account, 'last': last, 'filled': filled, 'serial': serial}) AS f, bool_or(coalesce(account = marker, FALSE)) AS among FROM tried GROUP BY photo),
s2 AS (SELECT s1.*, f, among, CASE WHEN open THEN CASE WHEN serial IS NULL THEN 'NO_SERIAL' WHEN serial_conf < 0.3 THEN 'SERIAL_LOW_CONF' WHEN n IS NULL THEN 'SERIAL_NOT_FOUND' WHEN n > 1 THEN 'SERIAL_AMBIGUOUS' END END AS failure FROM s1 LEFT JOIN plain USING (photo)),
byt AS (SELECT photo, count(DISTINCT r.account) AS tn, min({'row_order': r.row_order, 'account': r.account, 'last': r.last, 'filled': r.filled, 'serial': r.serial}) AS tf, bool_or(coalesce(r.account = marker, FALSE)) AS tamong
 FROM s2 JOIN reg r ON r.serial = s2.table_serial WHERE failure IN ('SERIAL_NOT_FOUND', 'SERIAL_LOW_CONF') AND table_conf >= 0.5 GROUP BY photo),
s3 AS (SELECT s2.* EXCLUDE (failure, f, among), CASE WHEN tn IS NOT NULL THEN CASE WHEN tn > 1 THEN 'SERIAL_AMBIGUOUS' END ELSE failure END AS failure, CASE WHEN tn IS NOT NULL THEN tf ELSE f END AS f,
 coalesce(CASE WHEN tn IS NOT NULL THEN tamong ELSE among END, FALSE) AS among FROM s2 LEFT JOIN byt USING (photo)),
s4 AS (SELECT *, CASE WHEN f IS NOT NULL THEN f.serial ELSE serial END AS read_serial, marker IS NOT NULL AND marker_conf >= 0.5 AS sure FROM s3),
named AS (SELECT account, min({'row_order': row_order, 'account': account, 'last': last, 'filled': filled, 'serial': serial}) AS nf, list(DISTINCT serial) AS serials FROM reg GROUP BY account),
helped AS (SELECT photo, nf FROM s4 JOIN named ON named.account = marker WHERE failure IS NOT NULL AND sure AND CASE failure WHEN 'SERIAL_AMBIGUOUS' THEN among WHEN 'NO_SERIAL' THEN TRUE
  ELSE coalesce(read_serial, '') <> '' AND len(list_filter(serials, lambda t: least(levenshtein(read_serial, t), levenshtein('0' || read_serial, t), levenshtein('00' || read_serial, t)) <= 1)) > 0 END),
s5 AS (SELECT s4.*, CASE WHEN failure IS NULL AND open THEN f ELSE nf END AS r FROM s4 LEFT JOIN helped USING (photo)),
s6 AS (SELECT *, failure IS NULL AND sure AND marker <> r.account AS against FROM s5),
s7 AS (SELECT *, CASE WHEN failed THEN 'ERROR' WHEN repeat THEN 'REPEAT' WHEN NOT meter THEN 'NO_METER' WHEN r IS NULL THEN failure WHEN against THEN 'SUSPICIOUS' END AS early FROM s6),
flags AS (SELECT account::BIGINT AS a, bool_or(outcome IN ('PLUS', 'MINUS')) AS good FROM log GROUP BY 1),
l0 AS (SELECT photo, r.account AS account, reading - r.last AS delta, CASE WHEN NOT r.filled THEN NULL WHEN coalesce(good, FALSE) THEN 'REPEAT' ELSE 'SUSPICIOUS' END AS decided, reading FROM s7 LEFT JOIN flags ON a = r.account::BIGINT WHERE early IS NULL),
l1 AS (SELECT *, coalesce(decided, CASE WHEN reading IS NULL THEN 'DIGITS_ERROR' WHEN delta IS NULL THEN 'PLUS' WHEN abs(delta) > 6000 THEN 'SUSPICIOUS' WHEN delta >= 0 THEN 'PLUS' ELSE 'MINUS' END) AS o FROM l0),
l2 AS (SELECT * EXCLUDE (o), CASE WHEN photo > min(photo) FILTER (o IN ('PLUS', 'MINUS')) OVER (PARTITION BY account) THEN 'REPEAT' ELSE o END AS late FROM l1),
l3 AS (SELECT photo, late, decided IS NULL AND late IN ('PLUS', 'MINUS', 'SUSPICIOUS') AS took, delta FROM l2)
SELECT s7.photo, coalesce(early, late) AS outcome,
 CASE WHEN early = 'SUSPICIOUS' AND against THEN 'conflict' WHEN late = 'DIGITS_ERROR' THEN digit_error WHEN early IS NULL AND failure IS NOT NULL THEN 'rescued ' || lower(failure) WHEN early = 'REPEAT' THEN CASE WHEN copy THEN 'copy' ELSE reason END END AS detail,
 CASE WHEN early = 'REPEAT' THEN NULL WHEN early IS NULL THEN r.serial WHEN open THEN read_serial END AS serial, CASE WHEN early = 'REPEAT' THEN nullif(log.account, '') WHEN early IS NULL THEN r.account END AS account,
 CASE WHEN early IS NULL THEN r.last END AS last, CASE WHEN took THEN s7.reading END AS reading, CASE WHEN took THEN delta END AS delta
FROM s7 LEFT JOIN l3 USING (photo) LEFT JOIN log ON log.seq = seen_row"""
LIMITS = decisions.Limits(serial=0.3, table=0.5, marker=0.5, delta=6000.0)


def _register(spark, sf):
    return A.register(spark, sf).withColumn("filled", F.col("row_order") % 6 == 0)


def _log(spark, sf):
    return A.log(spark, sf).withColumn("serial", F.lit(""))


def _photos(spark, sf):
    k = F.col("photo")
    name = F.concat(F.when(k % 10 == 0, F.concat(F.lit("p"), (k % 997).cast("string"))).otherwise(F.concat(F.lit("q"), k.cast("string"))), F.lit(".jpg"))
    part = lambda m: (k * m % 1000) / 1000.0
    rows = A.reads(spark, sf).withColumn("name", name)
    copy = F.when(k % 4 == 0, "").when(k % 10 == 0, F.sha2("name", 256)).otherwise(F.sha2(F.concat(F.lit("c"), F.floor(k / 3).cast("string")), 256))
    return rows.select(
        "photo", "name", copy.alias("photo_hash"), (k % 50 == 0).alias("reread"), (k % 101 == 0).alias("failed"), (k % 13 != 0).alias("meter"),
        F.when(k % 11 != 0, F.col("serial_read")).alias("serial"), part(37).alias("serial_conf"), F.when(k % 5 == 0, ((k * 17) % 1201).cast("string")).alias("table_serial"), part(53).alias("table_conf"),
        F.when(k % 3 == 0, F.col("owner")).alias("marker"), part(29).alias("marker_conf"), F.when(k % 9 != 0, F.col("reading")).alias("reading"), F.lit("low_conf").alias("digit_error"),
    )


@query("r01_decisions", with_("register reads log", "").rstrip() + f", {_PHOTOS}, {_DECIDED}")
def photo_decisions(spark, sf):
    """Each photo's outcome, by all steps in their order; inventory rows R1, P8, R4 and T2."""
    return decisions.decided(_photos(spark, sf), _register(spark, sf), _log(spark, sf), LIMITS)


@query("t09_batches_equal", with_("register reads log", "").rstrip() + f", {_CHOSEN}, decided AS (WITH {_DECIDED})" + """,
readings AS (SELECT DISTINCT account FROM decided WHERE outcome IN ('PLUS', 'MINUS')),
ends AS (SELECT key, d.outcome, d.account, d.reading FROM decided d JOIN photos USING (photo) UNION ALL SELECT key, outcome, account, NULL FROM lasts WHERE key NOT IN (SELECT key FROM photos))
SELECT key, CASE WHEN closed THEN 'REPEAT' ELSE outcome END AS outcome, account, CASE WHEN NOT closed THEN reading END AS reading
FROM (SELECT *, outcome IN ('DIGITS_ERROR', 'SUSPICIOUS') AND coalesce(account IN (SELECT account FROM readings), FALSE) AS closed FROM ends) WHERE closed OR key IN (SELECT key FROM photos)""")
def batches_equal(spark, sf):
    """The same month on three days, with copies, log rows and photos that fail: the states after one run over all photos."""
    folder = f"{lineage.shared_folder(spark)}/month-{uuid.uuid4().hex}"
    rows = _photos(spark, sf)
    most = rows.agg(F.max("photo")).first()[0] or 0
    day = F.least(F.floor(F.col("photo") * 3 / F.lit(most + 1)), F.lit(2))
    for n in range(3):
        rows.where(day == n).write.parquet(f"{folder}/in/day={n}")
        cycle.run_month(spark, f"{folder}/in", rows.schema, _register(spark, sf), _log(spark, sf), folder, LIMITS)
    return month.final_states(cycle.month_rows(spark, folder))


_NUMBER = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"


@query("r01_log_table", with_("register reads log", "").rstrip() + f", {_CHOSEN}, decided AS (WITH {_DECIDED})" + f""",
readings AS (SELECT account, min(photo) AS reader FROM decided WHERE outcome IN ('PLUS', 'MINUS') GROUP BY account),
done AS (SELECT d.*, p.name, p.photo_hash, p.serial_conf, p.reading AS shown FROM decided d JOIN photos p USING (photo)),
waiting AS (SELECT name, photo_hash, serial, account FROM done WHERE outcome IN ('DIGITS_ERROR', 'SUSPICIOUS') UNION ALL SELECT name, photo_hash, '', account FROM lasts WHERE outcome IN ('DIGITS_ERROR', 'SUSPICIOUS') AND key NOT IN (SELECT key FROM photos))
SELECT name AS original_filename, '' AS final_filename, coalesce(serial, '') AS serial_id, coalesce(account, '') AS account_id, coalesce(reading::VARCHAR, '') AS reading, coalesce({_NUMBER.format('last')}, '') AS last_reading, coalesce({_NUMBER.format('delta')}, '') AS delta,
 outcome, 'auto' AS source, 'run' AS processed_by, '2026-11-01T00:00:00' AS processed_at, '' AS verified_by, '' AS verified_at, coalesce(printf('%.4f', serial_conf), '') AS model_serial_conf, coalesce(shown::VARCHAR, '') AS model_reading_str, coalesce(detail, '') AS notes, photo_hash, 'f' || (photo % 6)::VARCHAR AS source_folder FROM done
UNION ALL SELECT name, '', coalesce(serial, ''), account, '', '', '', 'REPEAT', 'auto', 'run', '2026-11-01T00:00:00', '', '', '', '', 'closed: the account has a reading (photo ' || reader::VARCHAR || ') | closed', photo_hash, '' FROM waiting JOIN readings USING (account)""")
def log_table(spark, sf):
    """The whole log of a run over all photos, with all of its columns as text: a row for each photo read and each one closed."""
    shown = _photos(spark, sf)
    rows = month.run_rows(shown, _register(spark, sf), _log(spark, sf), LIMITS)
    seen = shown.select("photo", "serial_conf", F.col("reading").cast("string").alias("shown"), F.concat(F.lit("f"), (F.col("photo") % 6).cast("string")).alias("folder"))
    return month.log_table(rows, seen, "run", "2026-11-01T00:00:00")


_DECISIONS = """decisions AS (SELECT photo AS seq, 'p' || photo::VARCHAR || '.jpg' AS name, ['accept', 'serial_fix', 'duplicate', 'unreadable', 'not_in_db'][photo % 5 + 1] AS kind, serial_read AS serial,
 CASE WHEN photo % 7 = 0 THEN 'X' || owner ELSE owner END AS account, reading, CASE WHEN photo % 2 = 0 THEN 'SUSPICIOUS' ELSE 'PLUS' END AS outcome FROM reads)"""


def _operator(spark, sf):
    k = F.col("photo")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("accept", "serial_fix", "duplicate", "unreadable", "not_in_db")]), (k % 5 + 1).cast("int"))
    account = F.when(k % 7 == 0, F.concat(F.lit("X"), "owner")).otherwise(F.col("owner"))
    return A.reads(spark, sf).select(k.alias("seq"), F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")).alias("name"), kind.alias("kind"), F.col("serial_read").alias("serial"), account.alias("account"), "reading", F.when(k % 2 == 0, "SUSPICIOUS").otherwise("PLUS").alias("outcome"))


@query("r16_session_log", with_("register reads", "").rstrip() + f", {_DECISIONS}" + """
SELECT seq, name, CASE WHEN kind IN ('accept', 'serial_fix', 'not_in_db') THEN d.serial ELSE '' END AS serial, CASE WHEN kind IN ('accept', 'serial_fix') THEN d.account ELSE '' END AS account,
 CASE WHEN kind IN ('accept', 'serial_fix') THEN reading END AS reading, CASE WHEN kind IN ('accept', 'serial_fix') THEN last END AS last, CASE WHEN kind IN ('accept', 'serial_fix') THEN reading - last END AS delta,
 CASE kind WHEN 'duplicate' THEN 'REPEAT' WHEN 'unreadable' THEN 'UNREADABLE' WHEN 'not_in_db' THEN 'NOT_IN_DB' ELSE CASE WHEN outcome <> 'SUSPICIOUS' THEN outcome WHEN coalesce(reading - last, 0) >= 0 THEN 'PLUS' ELSE 'MINUS' END END AS outcome,
 'manual' AS source, CASE WHEN kind = 'not_in_db' THEN 'meter is not in the register' ELSE '' END AS notes FROM decisions d LEFT JOIN register r ON r.account = d.account""")
def session_log(spark, sf):
    return session.log_rows(_operator(spark, sf), A.register(spark, sf))


@query("r15_session_tables", with_("register reads", "").rstrip() + f", {_DECISIONS}" + """,
taken AS (SELECT d.* FROM decisions d SEMI JOIN register r ON r.account = d.account WHERE kind IN ('accept', 'serial_fix')),
old AS (SELECT account, last AS value FROM register WHERE row_order % 2 = 0),
vals AS (SELECT account, value FROM (SELECT account, value, -1 AS seq FROM old UNION ALL SELECT account, reading, seq FROM taken) QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq DESC) = 1),
fixes AS (SELECT account, arg_max(serial, seq) AS fixed FROM taken WHERE kind = 'serial_fix' GROUP BY account)
SELECT account, coalesce(fixed, serial) AS serial, value FROM register LEFT JOIN fixes USING (account) LEFT JOIN vals USING (account)""")
def session_tables(spark, sf):
    old = A.register(spark, sf).where("row_order % 2 = 0").select("account", F.col("last").alias("value"), F.lit("").alias("date"))
    return session.tables_after(_operator(spark, sf), A.register(spark, sf), old)


@query("s11_log_of_photo", with_("runs", "SELECT seq, outcome FROM runs WHERE photo_hash = sha256('p1.jpg') OR (photo_hash = '' AND name = 'p1.jpg')"))
def log_of_photo(spark, sf):
    key = hashlib.sha256(b"p1.jpg").hexdigest()
    return session.log_where(A.runs(spark, sf), photo_hash=key, name="p1.jpg").select("seq", "outcome")


@query("s12_log_of_account", with_("runs", "SELECT seq FROM runs WHERE source = 'auto' AND account = '14' AND outcome IN ('DIGITS_ERROR', 'SUSPICIOUS')"))
def log_of_account(spark, sf):
    return session.log_where(A.runs(spark, sf), account="14", outcomes=("DIGITS_ERROR", "SUSPICIOUS"), source="auto").select("seq")


_QUEUE = "NO_METER SERIAL_NOT_FOUND DIGITS_ERROR SUSPICIOUS".split()


@query("s18_question_queue", with_("runs", """, last AS (SELECT * FROM runs WHERE NOT starts_with(notes, 'copy of') QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY seq DESC) = 1)
SELECT outcome, folder, name, row_number() OVER (ORDER BY list_position(['NO_METER', 'SERIAL_NOT_FOUND', 'DIGITS_ERROR', 'SUSPICIOUS'], outcome), folder, name) AS place FROM last WHERE outcome IN ('NO_METER', 'SERIAL_NOT_FOUND', 'DIGITS_ERROR', 'SUSPICIOUS')"""))
def question_queue(spark, sf):
    """Photos that wait for an operator: by the reason's rank, then folder and name."""
    last = lookups.pick_last(photos.meaningful(A.runs(spark, sf)), ["folder", "name"], F.desc("seq")).where(F.col("outcome").isin(*_QUEUE))
    rank = F.array_position(F.array(*[F.lit(x) for x in _QUEUE]), F.col("outcome"))
    return session.queued(last.select("outcome", "folder", "name"), [rank, F.col("folder")], "name")


@query("x04_report", with_("log filled last_rows", """SELECT 'source' AS section, source AS name, count(*) AS n, count(*) FILTER (outcome IN ('PLUS', 'MINUS')) AS good FROM last_rows GROUP BY source
UNION ALL SELECT 'outcome', outcome, count(*), NULL FROM last_rows GROUP BY outcome UNION ALL SELECT 'folder', folder, count(*), count(*) FILTER (outcome IN ('PLUS', 'MINUS')) FROM last_rows GROUP BY folder"""))
def analysis_report(spark, sf):
    return session.report(states.last_state(states.folders_backfilled(A.log(spark, sf))))
