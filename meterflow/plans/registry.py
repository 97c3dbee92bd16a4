"""All queries of the library's own operators, by inventory number, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lookups, metrics, states
from ..operators import register as registers
from . import analogs as A
from .analogs import table, with_

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import cycle, files, joins, measures, run, rules  # noqa: F401  # each adds its own when imported

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


@query("a01_outcome_counts", with_("log filled last_rows", """SELECT folder, outcome, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY folder)::DOUBLE AS share FROM last_rows GROUP BY folder, outcome
UNION ALL SELECT NULL, outcome, count(*), count(*) / sum(count(*)) OVER ()::DOUBLE FROM last_rows GROUP BY outcome"""))
def outcome_counts(spark, sf):
    return states.outcome_counts(states.last_state(states.folders_backfilled(A.log(spark, sf))))


@query("a02_folder_ranking", with_("log filled last_rows", """SELECT folder, count(*) AS photos, avg(CASE WHEN outcome IN ('PLUS', 'MINUS') THEN 1.0 ELSE 0.0 END)::DOUBLE AS success,
row_number() OVER (ORDER BY avg(CASE WHEN outcome IN ('PLUS', 'MINUS') THEN 1.0 ELSE 0.0 END) DESC, folder) AS place FROM last_rows GROUP BY folder"""))
def folder_ranking(spark, sf):
    """Ranks the few folders, after the counts."""
    rows = states.last_state(states.folders_backfilled(A.log(spark, sf)))
    success = F.avg(F.when(F.col("outcome").isin("PLUS", "MINUS"), 1.0).otherwise(0.0))
    by = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("photos"), success.alias("success"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("success"), "folder")).cast("bigint"))


@query("w01_last_state", with_("log", "SELECT folder, name, seq, outcome FROM log QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY outcome = 'REPEAT', seq DESC) = 1"))
def last_state(spark, sf):
    return states.last_state(A.log(spark, sf)).select("folder", "name", "seq", "outcome")


@query("w02_folder_backfill", with_("log filled", "SELECT seq, name, folder FROM filled"))
def folder_backfill(spark, sf):
    return states.folders_backfilled(A.log(spark, sf)).select("seq", "name", "folder")


_STATE = """SELECT folder, name, CASE WHEN source = 'manual' AND outcome = 'NOT_IN_DB' THEN 'not_in_db' WHEN source = 'manual' OR outcome IN ('PLUS', 'MINUS', 'REPEAT') THEN 'done'
 WHEN outcome = 'ERROR' THEN 'error' ELSE 'waiting' END AS state FROM log WHERE notes NOT LIKE 'copy of%' QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY seq DESC) = 1"""


@query("w03_photo_state", with_("log", _STATE))
def photo_state(spark, sf):
    return states.photo_state(A.log(spark, sf))


@query("w04_run_selection", with_("log", f""", states AS ({_STATE}),
photos AS (SELECT source AS folder, 'p' || (doc_id % 997)::VARCHAR || '.jpg' AS name, min(doc_id) AS doc_id, sha256(min(text)) AS photo_hash, min(doc_id) % 3 = 0 AS known FROM documents GROUP BY ALL),
wanted AS (SELECT photos.*, coalesce(state, 'new') AS state, CASE WHEN coalesce(state, 'new') IN ('new', 'error') THEN 'read' WHEN state = 'done' THEN 'skip_done' WHEN known THEN 'read' ELSE 'skip_waiting' END AS c
  FROM photos LEFT JOIN states ON states.folder = 'f' || (doc_id % 997 % 5)::VARCHAR AND states.name = photos.name)
SELECT folder, name, state, CASE WHEN c = 'read' AND row_number() OVER (PARTITION BY photo_hash, c = 'read' ORDER BY folder, name) > 1 THEN 'skip_copy' ELSE c END AS choice FROM wanted"""))
def run_selection(spark, sf):
    name = F.concat(F.lit("p"), (F.col("doc_id") % 997).cast("string"), F.lit(".jpg"))
    photos = table(spark, sf, "documents").groupBy(F.col("source").alias("folder"), name.alias("name")).agg(F.min("doc_id").alias("doc_id"), F.sha2(F.min("text"), 256).alias("photo_hash"))
    photos = photos.withColumn("known", F.col("doc_id") % 3 == 0).withColumnRenamed("folder", "shown").withColumn("folder", F.concat(F.lit("f"), (F.col("doc_id") % 997 % 5).cast("string")))
    met = photos.join(states.photo_state(A.log(spark, sf)), ["folder", "name"], "left").drop("folder").withColumnRenamed("shown", "folder")
    none = met.select("folder", "name", "state").where("state is not null")
    return states.selection(met.drop("state"), none).select("folder", "name", "state", "choice")


@query("w05_first_success", with_("log", """SELECT seq, account, CASE WHEN outcome IN ('PLUS', 'MINUS') AND row_number() OVER (PARTITION BY account, outcome IN ('PLUS', 'MINUS') ORDER BY seq) > 1
THEN 'REPEAT' ELSE outcome END AS decided FROM log"""))
def first_success(spark, sf):
    return states.first_success(A.log(spark, sf)).select("seq", "account", "decided")


@query("w15_unique_names", with_("log", """SELECT seq, folder, CASE WHEN n = 1 THEN name ELSE replace(name, '.jpg', '_' || n::VARCHAR || '.jpg') END AS target
FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY seq) AS n FROM log)"""))
def unique_names(spark, sf):
    return states.unique_names(A.log(spark, sf)).select("seq", "folder", "target")


@query("j01_prioritised_lookup", with_("register reads variants", """SELECT v.photo, v.priority::INTEGER AS priority, r.serial, r.account, (v.reading - r.last)::BIGINT AS delta FROM variants v JOIN register r USING (serial)
QUALIFY v.priority = min(v.priority) OVER (PARTITION BY v.photo)"""))
def prioritised_lookup(spark, sf):
    met = lookups.prioritised(A.reads(spark, sf).select("photo", "serial_read", "reading"), A.register(spark, sf).drop("row_order"))
    return met.select("photo", "priority", "serial", "account", (F.col("reading") - F.col("last")).alias("delta"))


@query("j02_ambiguous_serials", with_("register reads variants", """SELECT photo, count(DISTINCT account) AS n, string_agg(account, ',' ORDER BY row_order) AS accounts FROM (
SELECT v.photo, r.account, r.row_order FROM variants v JOIN register r USING (serial) QUALIFY v.priority = min(v.priority) OVER (PARTITION BY v.photo)) GROUP BY photo HAVING count(DISTINCT account) > 1"""))
def ambiguous_serials(spark, sf):
    return lookups.ambiguous(A.reads(spark, sf), A.register(spark, sf))


@query("j04_in_register", with_("register reads variants", "SELECT photo, bool_or(serial IN (SELECT serial FROM register)) AS found FROM variants GROUP BY photo"))
def in_register(spark, sf):
    return lookups.in_register(A.reads(spark, sf), A.register(spark, sf)).select("photo", "found")


_LATEST = "latest AS (SELECT owner AS account, reading AS value FROM reads QUALIFY row_number() OVER (PARTITION BY owner ORDER BY day DESC, photo DESC) = 1)"


def _latest(spark, sf):
    return lookups.pick_last(A.reads(spark, sf), ["owner"], F.desc("day"), F.desc("photo")).select(F.col("owner").alias("account"), F.col("reading").alias("value"))


@query("j05_export", with_("register reads", "").rstrip() + f", {_LATEST} " + """SELECT account, serial, last, coalesce(value::VARCHAR, '') AS reading, (value - last)::BIGINT AS difference FROM register LEFT JOIN latest USING (account)""")
def export(spark, sf):
    return registers.exported(A.register(spark, sf).withColumn("in_table", F.lit(True)), _latest(spark, sf))


@query("u03_without_reading", with_("register reads", "").rstrip() + f", {_LATEST}, taken AS (SELECT account FROM latest JOIN register USING (account) WHERE value - last BETWEEN -1500 AND 3000) SELECT account, serial FROM register ANTI JOIN taken USING (account)")
def without_reading(spark, sf):
    """Accounts whose latest reading was not taken, as its change is not plausible, or that have none."""
    register = A.register(spark, sf).withColumn("in_table", F.lit(True))
    taken = _latest(spark, sf).join(register.select("account", "last"), "account").where((F.col("value") - F.col("last")).between(-1500, 3000))
    return registers.without_reading(register, taken.select("account")).select("account", "serial")


@query("j06_or_key_join", with_("log", """SELECT p.photo, l.seq FROM (SELECT doc_id AS photo, 'p' || (doc_id % 1200)::VARCHAR || '.jpg' AS name,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256('p' || (doc_id % 1300)::VARCHAR || '.jpg') END AS h FROM documents) p
JOIN log l ON CASE WHEN p.h <> '' AND l.photo_hash <> '' THEN p.h = l.photo_hash ELSE p.name = l.name END"""))
def or_key_join(spark, sf):
    name = lambda m: F.concat(F.lit("p"), (F.col("doc_id") % m).cast("string"), F.lit(".jpg"))
    photos = table(spark, sf, "documents").select(F.col("doc_id").alias("photo"), name(1200).alias("name"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.sha2(name(1300), 256)).alias("photo_hash"))
    log = A.log(spark, sf).select("seq", F.col("name").alias("row_name"), F.col("photo_hash").alias("row_hash"))
    return lookups.or_key_join(photos, log).select("photo", "seq")


@query("j09_one_edit_join", with_("register reads", """SELECT a.serial_read, b.serial FROM (SELECT DISTINCT serial_read FROM reads) a JOIN (SELECT DISTINCT serial FROM register) b ON levenshtein(a.serial_read, b.serial) = 1"""))
def one_edit_join(spark, sf):
    return lookups.one_edit_join(A.reads(spark, sf), A.register(spark, sf), "serial_read", "serial")


@query("j12_serial_hints", with_("register reads variants", """, known AS (SELECT photo FROM variants GROUP BY photo HAVING bool_or(serial IN (SELECT serial FROM register))),
first AS (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY serial ORDER BY row_order) = 1),
read_variants AS (SELECT DISTINCT serial_read, serial AS variant FROM variants ANTI JOIN known USING (photo) WHERE length(serial_read) >= 3),
near AS (SELECT DISTINCT serial_read, first.serial FROM read_variants JOIN first ON levenshtein(variant, first.serial) = 1)
SELECT photo, serial_read, serial, account, (reading - last)::BIGINT AS delta, row_number() OVER (PARTITION BY photo ORDER BY abs(reading - last), serial)::INTEGER AS rank
FROM reads ANTI JOIN known USING (photo) JOIN near USING (serial_read) JOIN first USING (serial)
QUALIFY row_number() OVER (PARTITION BY photo ORDER BY abs(reading - last), serial) <= 3"""))
def serial_hints(spark, sf):
    return lookups.serial_hints(A.reads(spark, sf), A.register(spark, sf))


@query("j20_account_variants", """WITH a AS (SELECT '13' || lpad(c_custkey::VARCHAR, 8, '0') AS account, substr(lpad(c_custkey::VARCHAR, 8, '0'), 1, 8) AS rest, length(c_custkey::VARCHAR) AS core FROM customer),
tails AS (SELECT account, right(rest, n) AS t FROM a, range(1, 9) r(n) WHERE n >= core)
SELECT account, t AS variant FROM tails UNION SELECT account, '13' || t FROM tails""")
def account_variants(spark, sf):
    """Written forms of each account with eight digits or more."""
    wide = F.concat(F.lit("13"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, sf, "customer").select(wide.alias("account"), F.explode(scalars.account_variants(wide)).alias("variant"))


@query("d01_register_merge", with_("register next_register", """, old AS (SELECT account, serial AS s0, last AS l0, row_order % 29 <> 0 AS in_table FROM register),
both_ AS (SELECT coalesce(old.account, n.account) AS account, s0, l0, in_table, n.serial AS s1, n.last AS l1, n.account IS NOT NULL AS here FROM old FULL JOIN next_register n ON old.account = n.account)
SELECT account, 'added' AS change, NULL::VARCHAR AS before, s1 AS after FROM both_ WHERE here AND in_table IS NULL
UNION ALL SELECT account, 'returned', NULL, s1 FROM both_ WHERE here AND NOT in_table
UNION ALL SELECT account, 'removed', s0, NULL FROM both_ WHERE NOT here AND in_table
UNION ALL SELECT account, 'serial', s0, s1 FROM both_ WHERE here AND s0 <> s1
UNION ALL SELECT account, 'last', l0::VARCHAR, l1::VARCHAR FROM both_ WHERE here AND l0 <> l1"""))
def register_merge(spark, sf):
    old = A.register(spark, sf).withColumn("in_table", F.col("row_order") % 29 != 0)
    return registers.merge_changes(old, registers.first_rows(A.next_register(spark, sf)))


@query("a06_shared_serials", with_("register", "SELECT serial, count(*) AS n, string_agg(account, ',' ORDER BY row_order) AS accounts FROM register WHERE serial <> '' GROUP BY serial HAVING count(*) > 1"))
def shared_serials(spark, sf):
    return registers.shared_serials(A.register(spark, sf))


@query("a07_numeric_columns", """SELECT 'p_name' AS "column", count(*) AS filled, count_if(regexp_full_match(p_name, '-?[0-9]+([.][0-9]+)?'))::BIGINT AS "numeric", FALSE AS is_numeric FROM part WHERE trim(p_name) <> ''
UNION ALL SELECT 'p_size', count(*), count_if(p_size IS NOT NULL)::BIGINT, TRUE FROM part WHERE p_size IS NOT NULL""")
def numeric_columns(spark, sf):
    return registers.numeric_columns(table(spark, sf, "part"), ["p_name", "p_size"])


@query("f16_delta_outcomes", with_("register reads", """SELECT CASE WHEN last IS NULL THEN 'PLUS' WHEN abs(reading - last) > 10000 THEN 'SUSPICIOUS' WHEN reading >= last THEN 'PLUS' ELSE 'MINUS' END AS outcome, count(*) AS n
FROM reads LEFT JOIN register ON owner = account GROUP BY 1"""))
def delta_outcomes(spark, sf):
    met = A.reads(spark, sf).join(A.register(spark, sf), F.expr("owner = account"), "left")
    return met.groupBy(scalars.delta_outcome(F.col("reading"), F.col("last"), 10000).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_hash_split", """SELECT doc_id, share, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'val' ELSE 'test' END AS split FROM (
SELECT doc_id, concat('0x', substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT / pow(16, 12) AS share FROM documents)""")
def hash_split(spark, sf):
    key = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", scalars.hash_share(key).alias("share"), scalars.split_of(key).alias("split"))


@query("p19_etalon_sample", "SELECT doc_id FROM documents WHERE concat('0x', substr(sha256(text), 1, 12))::BIGINT / pow(16, 12) < 1.0 / 3")
def etalon_sample(spark, sf):
    return table(spark, sf, "documents").where(scalars.hash_share(F.col("text")) < 1.0 / 3).select("doc_id")


@query("f13_reading_digits", """SELECT o_orderkey AS photo, CASE WHEN length(floor(o_totalprice)::BIGINT::VARCHAR) <= 5 THEN lpad(floor(o_totalprice)::BIGINT::VARCHAR, 5, '0') END AS digits FROM orders""")
def reading_digits(spark, sf):
    text = F.concat(F.floor("o_totalprice").cast("string"), F.lit(",0"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("photo"), scalars.reading_digits(text).alias("digits"))


@query("f14_photo_dates", "SELECT photo, day::DATE AS day FROM (SELECT o_orderkey AS photo, o_orderdate AS day FROM orders)")
def photo_dates(spark, sf):
    name = F.concat(F.lit("IMG_99999999_"), F.date_format("day", "yyyy-MM-dd"), F.lit("_00012.jpg"))
    return A.reads(spark, sf).select("photo", scalars.photo_date(name).alias("day"))


@query("f05_edit_kinds", with_("reads texts", """SELECT edit, count(*) AS n FROM (SELECT CASE WHEN length("read") > length("true") THEN 'extra last' ELSE 'substitution ' || CASE WHEN length("true") = 1 THEN 'first' ELSE 'last' END END AS edit
FROM texts WHERE levenshtein("read", "true") = 1) GROUP BY edit"""))
def edit_kinds(spark, sf):
    rows = A.texts(spark, sf).where(F.levenshtein("read", "true") == 1)
    return rows.groupBy(scalars.edit_kind(F.col("read"), F.col("true")).alias("edit")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_quartiles", """WITH s AS (SELECT o_orderpriority AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
c AS (SELECT DISTINCT k, n, i, greatest(1, least((i * (n + 1)) // 4, n - 1)) AS j FROM s, (VALUES (1), (2), (3)) t(i)),
q AS (SELECT c.k, c.n, i, (a.v * (4 - (i * (c.n + 1) - j * 4)) + b.v * (i * (c.n + 1) - j * 4)) / 4 AS v FROM c JOIN s a ON a.k = c.k AND a.r = j JOIN s b ON b.k = c.k AND b.r = j + 1)
SELECT k AS o_orderpriority, n, max(v) FILTER (i = 1) AS q1, max(v) FILTER (i = 2) AS q2, max(v) FILTER (i = 3) AS q3 FROM q GROUP BY k, n""")
def quartiles(spark, sf):
    return metrics.quartiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


@query("a13_threshold_sweep", with_("reads texts", """SELECT t AS threshold, count(*) FILTER (conf >= t - 1e-9) AS accepted, count(*) FILTER (conf >= t - 1e-9 AND "read" <> "true") AS wrong
FROM texts, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9), (0.95), (0.99)) v(t) GROUP BY t"""))
def threshold_sweep(spark, sf):
    rows = A.texts(spark, sf).select("conf", (F.col("read") == F.col("true")).alias("ok"))
    return metrics.threshold_sweep(rows, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])


@query("a14_group_logsumexp", """SELECT o_orderstatus, ln(sum(exp(o_totalprice / 100000 - m))) + max(m) AS logsumexp FROM (SELECT *, max(o_totalprice / 100000) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY 1""")
def group_logsumexp(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_totalprice") / 100000).alias("x"))
    out = metrics.group_logsumexp(rows, "o_orderstatus", "x")
    return out


@query("a21_duplicate_contents", "SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT lang) AS labels FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark, sf):
    return metrics.duplicate_contents(table(spark, sf, "documents").select(F.col("text").alias("content"), F.col("lang").alias("label")))


@query("a23_text_accuracy", with_("reads texts", """SELECT part, count(*) AS n, avg(CASE WHEN "read" = "true" THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact, sum(levenshtein("read", "true")) / sum(greatest(length("true"), 1))::DOUBLE AS cer FROM texts GROUP BY part"""))
def text_accuracy(spark, sf):
    return metrics.text_accuracy(A.texts(spark, sf), ["part"])


@query("a23_position_accuracy", with_("reads texts", """SELECT p::INTEGER AS position, count(*) AS n, count_if(substr("read", p, 1) = substr("true", p, 1))::BIGINT AS "right" FROM (SELECT *, unnest(range(1, length("true") + 1)) AS p FROM texts) GROUP BY p"""))
def position_accuracy(spark, sf):
    return metrics.position_accuracy(A.texts(spark, sf))


@query("a25_confusion", with_("reads texts", """SELECT substr("true", p, 1) AS true_digit, substr("read", p, 1) AS read_digit, count(*) AS n FROM (SELECT *, unnest(range(1, length("true") + 1)) AS p FROM texts WHERE length("true") = length("read")) GROUP BY 1, 2"""))
def confusion(spark, sf):
    return metrics.confusion(A.texts(spark, sf))


@query("a26_length_distribution", with_("reads", "SELECT length(serial_read)::INTEGER AS len, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM reads GROUP BY 1"))
def length_distribution(spark, sf):
    by = A.reads(spark, sf).groupBy(F.length("serial_read").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("j28_labelled", "SELECT d.doc_id IS NOT NULL AS has_text, l.doc_id IS NOT NULL AS has_label, count(*) AS n FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY 1, 2")
def labelled(spark, sf):
    """Texts with and without labels and labels without texts, from one full join of ids."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("t"))
    both = d.join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "full_outer")
    return both.groupBy(F.col("t").isNotNull().alias("has_text"), F.col("l").isNotNull().alias("has_label")).agg(F.count(F.lit(1)).alias("n"))


@query("r21_class_weights", "SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY quality) AS weight FROM labels")
def class_weights(spark, sf):
    """Weights by a join with the few class counts, not by a window that would gather a class in one task."""
    labels = table(spark, sf, "labels")
    counts = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, labels["quality"].eqNullSafe(counts["quality"])).select("doc_id", (F.lit(1.0) / F.col("n")).alias("weight"))
