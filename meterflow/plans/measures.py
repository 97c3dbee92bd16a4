"""Queries of the log's analytics and of evaluation, by inventory number, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, lookups, register, states
from . import analogs as A
from .analogs import table, with_
from .registry import query


@query("a03_selection_counts", with_("runs", "SELECT outcome, source, count(*) AS n FROM runs GROUP BY ALL"))
def selection_counts(spark, sf):
    return A.runs(spark, sf).groupBy("outcome", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a04_month_summary", with_("register runs", """, latest AS (SELECT account, source FROM runs WHERE outcome IN ('PLUS', 'MINUS') QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq DESC) = 1),
met AS (SELECT row_order % 29 <> 0 AS here, source FROM register LEFT JOIN latest USING (account))
SELECT count(*) FILTER (here) AS in_table, count(*) FILTER (here AND source = 'auto') AS auto, count(*) FILTER (here AND source = 'manual') AS manual, count(*) FILTER (here AND source IS NULL) AS without, count(*) FILTER (NOT here) AS removed FROM met"""))
def month_summary(spark, sf):
    latest = lookups.pick_last(A.runs(spark, sf).where("outcome in ('PLUS', 'MINUS')"), ["account"], F.desc("seq"))
    return analytics.month_summary(A.register(spark, sf).withColumn("in_table", F.col("row_order") % 29 != 0), latest)


@query("a05_load_report", with_("register next_register", """, old AS (SELECT account, serial AS s0, last AS l0, row_order % 29 <> 0 AS in_table FROM register),
both_ AS (SELECT s0, l0, in_table, n.serial AS s1, n.last AS l1, n.account IS NOT NULL AS here FROM old FULL JOIN next_register n ON old.account = n.account)
SELECT change, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN here AND in_table IS NULL THEN 'added' END, CASE WHEN here AND NOT in_table THEN 'returned' END, CASE WHEN NOT here AND in_table THEN 'removed' END,
 CASE WHEN here AND s0 <> s1 THEN 'serial' END, CASE WHEN here AND l0 <> l1 THEN 'last' END], lambda x: x IS NOT NULL)) AS change FROM both_) GROUP BY 1"""))
def load_report(spark, sf):
    old = A.register(spark, sf).withColumn("in_table", F.col("row_order") % 29 != 0)
    return register.merge_changes(old, register.first_rows(A.next_register(spark, sf))).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("a08_digit_stats", with_("runs", r""", low AS (SELECT unnest(regexp_extract_all(notes, 'pos([0-9]+)\(pred=([0-9]),conf=([0-9.]+)\)', 1)) AS p, unnest(regexp_extract_all(notes, 'pos([0-9]+)\(pred=([0-9]),conf=([0-9.]+)\)', 2)) AS d FROM runs)
SELECT metric, key, count(*) AS n FROM (
 SELECT 'with_reading' AS metric, '' AS key FROM runs WHERE model_reading <> '' UNION ALL SELECT 'with_unsure', '' FROM runs WHERE contains(model_reading, '?')
 UNION ALL SELECT 'only_first_unsure', '' FROM runs WHERE model_reading LIKE '?%' AND NOT contains(substr(model_reading, 2), '?')
 UNION ALL SELECT 'unsure_at', (i - 1)::VARCHAR FROM runs, range(1, 6) t(i) WHERE substr(model_reading, i, 1) = '?'
 UNION ALL SELECT 'low_conf_at', p FROM low UNION ALL SELECT 'low_conf_first', d FROM low WHERE p = '0'
 UNION ALL SELECT 'error', CASE WHEN starts_with(notes, 'low conf') THEN 'low_conf' WHEN notes <> '' THEN 'count' ELSE 'none' END FROM runs WHERE outcome = 'DIGITS_ERROR'
 UNION ALL SELECT 'first_digit', substr(model_reading, 1, 1) FROM runs WHERE outcome IN ('PLUS', 'MINUS', 'SUSPICIOUS')) GROUP BY ALL"""))
def digit_stats(spark, sf):
    return analytics.digit_stats(A.runs(spark, sf))


@query("a09_serial_lengths", with_("runs", """, by_len AS (SELECT outcome <> 'SERIAL_NOT_FOUND' AS found, length(serial)::INTEGER AS len, count(*) AS n, min(seq) AS f FROM runs WHERE outcome IN ('PLUS', 'MINUS', 'SUSPICIOUS', 'DIGITS_ERROR', 'SERIAL_NOT_FOUND') GROUP BY ALL)
SELECT found, len, n, len IN (SELECT len FROM by_len WHERE found ORDER BY n DESC, f LIMIT 3) AS typical FROM by_len"""))
def serial_lengths(spark, sf):
    return analytics.serial_lengths(A.runs(spark, sf))


@query("a09_edit_ranking", with_("reads texts", """, e AS (SELECT photo AS seq, CASE WHEN length("read") > length("true") THEN 'extra last' ELSE 'substitution ' || CASE WHEN length("true") = 1 THEN 'first' ELSE 'last' END END AS edit FROM texts WHERE levenshtein("read", "true") = 1)
SELECT edit, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT edit, count(*) AS n, min(seq) AS f FROM e GROUP BY 1)"""))
def edit_ranking(spark, sf):
    rows = A.texts(spark, sf).where(F.levenshtein("read", "true") == 1)
    return analytics.common(rows.select(F.col("photo").alias("seq"), scalars.edit_kind(F.col("read"), F.col("true")).alias("edit")), "edit")


@query("a10_operator_accuracy", with_("runs", """SELECT count(*) FILTER (v AND ok) AS verified, count(*) FILTER (v AND NOT ok) AS verified_other, count(*) FILTER (v AND ok AND reading IS NOT DISTINCT FROM m) AS reading_ok,
 count(*) FILTER (v AND ok AND contains(notes, 'corrected at check')) AS corrected, count(*) FILTER (source = 'manual') AS manual, count(*) FILTER (source = 'manual' AND NOT contains(model_reading, '?')) AS manual_full,
 count(*) FILTER (source = 'manual' AND NOT contains(model_reading, '?') AND reading IS NOT DISTINCT FROM m) AS manual_ok
FROM (SELECT *, source = 'auto' AND verified_by <> '' AS v, outcome IN ('PLUS', 'MINUS', 'SUSPICIOUS') AS ok, try_cast(model_reading AS BIGINT) AS m FROM runs)"""))
def operator_accuracy(spark, sf):
    return analytics.operator_accuracy(A.runs(spark, sf))


@query("a11_delta_range", with_("runs", """, d AS (SELECT list(delta ORDER BY delta) AS a, count(*) AS n FROM runs WHERE outcome IN ('PLUS', 'MINUS')),
c AS (SELECT a, n, i, greatest(1, least((i * (n + 1)) // 20, n - 1)) AS j FROM d, (VALUES (1), (19)) t(i)),
q AS (SELECT n, i, (a[j] * (20 - (i * (n + 1) - j * 20)) + a[j + 1] * (i * (n + 1) - j * 20)) / 20 AS v FROM c)
SELECT CASE WHEN n >= 20 THEN max(v) FILTER (i = 1) END AS low, CASE WHEN n >= 20 THEN max(v) FILTER (i = 19) END AS high FROM q GROUP BY n"""))
def delta_range(spark, sf):
    from ..operators import metrics

    return metrics.quantile_range(A.runs(spark, sf).where("outcome in ('PLUS', 'MINUS')"), "delta", 20)


@query("a12_chance_rate", with_("register", """, made AS (SELECT substr(translate(sha256('67:' || i::VARCHAR), 'abcdef', '012345'), 1, [3, 4][i % 2 + 1]) AS serial FROM range(1000) t(i)),
hit AS (SELECT DISTINCT m.serial FROM (SELECT DISTINCT serial FROM made) m JOIN (SELECT DISTINCT serial FROM register) r ON levenshtein(m.serial, r.serial) = 1 OR levenshtein('0' || m.serial, r.serial) = 1 OR levenshtein('00' || m.serial, r.serial) = 1)
SELECT count(*) AS n, count_if(serial IN (FROM hit))::BIGINT AS hits FROM made"""))
def chance_rate(spark, sf):
    """How often made-up serials have a register serial one edit away."""
    made = analytics.random_serials(spark, 1000, [3, 4], 67)
    kinds = lookups.not_found_kinds(made, A.register(spark, sf), "serial")
    return made.join(kinds, "serial").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "one_edit").alias("hits"))


@query("a15_check_summary", with_("runs", """, c AS (SELECT outcome AS reason, seq % 3 <> 0 AS s, seq % 4 <> 0 AS r, seq % 3 = 0 AND conf >= 0.9 AS w FROM runs)
SELECT CASE WHEN grouping(reason) = 1 THEN 'ALL' ELSE reason END AS reason, count(*) AS n, count(*) FILTER (s) AS serial_ok, count(*) FILTER (r) AS reading_ok, count(*) FILTER (s AND r) AS all_ok, count(*) FILTER (w) AS wrong_sure FROM c GROUP BY ROLLUP (reason)"""))
def check_summary(spark, sf):
    k = F.col("seq")
    rows = A.runs(spark, sf).select(F.col("outcome").alias("reason"), (k % 3 != 0).alias("serial_ok"), (k % 4 != 0).alias("reading_ok"), ((k % 3 == 0) & (F.col("conf") >= 0.9)).alias("wrong_sure"))
    return analytics.check_summary(rows)


@query("a17_angle_bins", """WITH t AS (SELECT abs((event_id * 13 % 600) / 10.0::DOUBLE - 30) AS a FROM events)
SELECT CASE WHEN a < 1 - 1e-9 THEN 1.0 WHEN a < 2 - 1e-9 THEN 2.0 WHEN a < 5 - 1e-9 THEN 5.0 WHEN a < 10 - 1e-9 THEN 10.0 WHEN a < 20 - 1e-9 THEN 20.0 WHEN a < 45 - 1e-9 THEN 45.0 END::DOUBLE AS bin, count(*) AS n FROM t GROUP BY 1""")
def angle_bins(spark, sf):
    return analytics.angle_bins(table(spark, sf, "events").select((F.col("event_id") * 13 % 600 / 10.0 - 30).alias("angle")), "angle")


@query("a18_status_counts", with_("runs", "SELECT outcome, count(*) FILTER (source = 'auto') AS auto, count(*) FILTER (source = 'manual') AS manual FROM runs GROUP BY 1"))
def status_counts(spark, sf):
    """A pivot over the two known sources, so that no pass is needed to find them."""
    rows = A.runs(spark, sf).groupBy("outcome").pivot("source", ["auto", "manual"]).agg(F.count(F.lit(1)))
    return rows.select("outcome", F.coalesce("auto", F.lit(0)).alias("auto"), F.coalesce("manual", F.lit(0)).alias("manual"))


@query("a20_class_objects", with_("boxes", "SELECT CASE class WHEN 'gas_meter' THEN 'meter' ELSE class END AS class, count(*) AS n, count(DISTINCT photo) AS photos FROM boxes GROUP BY 1"))
def class_objects(spark, sf):
    rows = A.boxes(spark, sf).groupBy(scalars.standard_class(F.col("class")).alias("class"), "photo").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("photos"))


@query("a22_fingerprint", """WITH f AS (SELECT lang, sha256(source || '/' || doc_id::VARCHAR || chr(9) || n_chars::VARCHAR || chr(10)) AS h FROM documents),
s AS (SELECT lang, count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT) AS a, sum(('0x' || substr(h, 13, 12))::BIGINT) AS b, sum(('0x' || substr(h, 25, 12))::BIGINT) AS c, sum(('0x' || substr(h, 37, 12))::BIGINT) AS d FROM f GROUP BY lang)
SELECT lang, n AS files, substr(sha256(concat_ws('|', n::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR)), 1, 16) AS fingerprint FROM s""")
def fingerprint(spark, sf):
    files = table(spark, sf, "documents").select("lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return analytics.fingerprint(files, ["lang"])


@query("a24_nearest_variant", with_("reads texts", """, v AS (SELECT part, "read", ["true", '0' || "true", '00' || "true"] AS vs FROM texts),
d AS (SELECT part, list_contains(vs, "read") AS ok, list_transform(vs, lambda x: levenshtein("read", x)) AS ds, vs FROM v)
SELECT part, count(*) AS n, avg(ok::INT)::DOUBLE AS exact, sum(list_min(ds)) / sum(greatest(length(vs[list_position(ds, list_min(ds))]), 1))::DOUBLE AS cer FROM d GROUP BY part"""))
def nearest_variant(spark, sf):
    return analytics.nearest_variant(A.texts(spark, sf).withColumn("variants", scalars.lookup_variants(F.col("true"))), ["part"])


@query("a27_suspects", with_("reads texts", """SELECT photo, conf FROM texts WHERE "read" <> "true" AND conf >= 0.95"""))
def suspects(spark, sf):
    return analytics.suspects(A.texts(spark, sf)).select("photo", "conf")


@query("a30_best_epoch", with_("reads texts", """, h AS (SELECT part, photo % 40 AS epoch, avg(CASE WHEN "read" = "true" THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, sum(levenshtein("read", "true")) / sum(greatest(length("true"), 1))::DOUBLE AS cer FROM texts GROUP BY ALL)
SELECT part, best, last, last - best AS stale FROM (SELECT part, first(epoch ORDER BY accuracy DESC, cer, epoch) AS best, max(epoch) AS last FROM h GROUP BY part)"""))
def best_epoch(spark, sf):
    from ..operators import metrics

    history = metrics.text_accuracy(A.texts(spark, sf).withColumn("epoch", F.col("photo") % 40), ["part", "epoch"]).withColumnRenamed("exact", "accuracy")
    return analytics.best_epoch(history, ["part"])


@query("a31_only_one", with_("register", "SELECT serial, CASE WHEN count(DISTINCT account) = 1 THEN min(account) END AS account FROM register GROUP BY 1"))
def only_one(spark, sf):
    return analytics.only_one(A.register(spark, sf), "serial", "account")


@query("u04_removed_accounts", with_("register next_register", "SELECT account FROM register EXCEPT SELECT account FROM next_register"))
def removed_accounts(spark, sf):
    return A.register(spark, sf).select("account").join(A.next_register(spark, sf).select("account"), "account", "left_anti")


@query("p01_log_rows", with_("runs", """SELECT seq, printf('%.4f', conf) AS conf, concat_ws(' | ', nullif(notes, ''), nullif(CASE WHEN verified_by = '' THEN '' ELSE 'verified' END, '')) AS notes FROM runs"""))
def log_rows(spark, sf):
    return states.log_row(A.runs(spark, sf)).select("seq", "conf", "notes")
