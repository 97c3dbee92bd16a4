"""Queries of digit reading, detections, notes, the lexicon and column functions, by inventory number, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import digits, lexicon, notes
from . import analogs as A
from .analogs import table, with_
from .registry import query

_PHOTO = """photos AS (SELECT photo, list({'x1': x1, 'x2': x2, 'digit': digit, 'p1': p1, 'second': second, 'p2': p2} ORDER BY x1, x2, digit, p1, second, p2) AS b, count(*) AS n FROM boxes GROUP BY photo)"""
#: W9 as SQL: `hole` is the place of the missing box, from 0.
_MISSING = """centred AS (SELECT *, list_transform(b, lambda x: floor((x.x1 + x.x2) / 2)::INTEGER) AS c FROM photos),
stepped AS (SELECT *, CASE WHEN n = 4 THEN list_transform(range(1, 4), lambda i: c[i + 1] - c[i]) END AS s, CASE WHEN n = 4 THEN (c[4] - c[1]) / 3.0::DOUBLE END AS mean FROM centred),
placed AS (SELECT *, CASE WHEN n = 4 THEN coalesce(CASE WHEN s[1] > mean * 1.6 THEN 1 WHEN s[2] > mean * 1.6 THEN 2 WHEN s[3] > mean * 1.6 THEN 3 END,
 CASE WHEN 200 - c[4] > c[1] * 1.6 THEN 4 WHEN c[1] > (200 - c[4]) * 1.6 THEN 0 END) END AS hole FROM stepped)"""


def _photos(spark, sf):
    return digits.ordered(A.boxes(spark, sf)).withColumn("width", F.lit(200)).withColumn("last", F.lit(None).cast("double"))


@query("w09_missing_digit", with_("boxes", "").rstrip() + f", {_PHOTO}, {_MISSING} SELECT photo, hole::INTEGER AS position FROM placed")
def missing_digit(spark, sf):
    return _photos(spark, sf).select("photo", digits.missing_position(F.col("boxes"), F.col("width")).cast("int").alias("position"))


@query("w10_median_width", with_("boxes", "").rstrip() + f", {_PHOTO} SELECT photo, list_sort(list_transform(b, lambda x: x.x2 - x.x1))[n // 2 + 1]::INTEGER AS width FROM photos")
def median_width(spark, sf):
    return _photos(spark, sf).select("photo", digits.upper_median_width(F.col("boxes")).alias("width"))


@query("r02_reading", with_("boxes", "").rstrip() + f", {_PHOTO}, {_MISSING}" + """, fatal AS (SELECT *, CASE WHEN n NOT IN (4, 5) THEN 'count' WHEN n = 4 AND hole IS NULL THEN 'gap' WHEN hole < 2 THEN 'critical' END AS f FROM placed),
cells AS (SELECT photo, f, CASE WHEN f IS NULL THEN CASE WHEN n = 5 THEN b ELSE list_concat(list_concat(b[1:hole], [NULL]), b[hole + 1:4]) END END AS b FROM fatal),
chars AS (SELECT photo, f, list_transform(b, lambda x, i: CASE WHEN x IS NULL THEN '5' WHEN x.p1 >= 0.8 THEN x.digit::VARCHAR
  WHEN x.p1 + x.p2 >= 0.8 AND least(x.digit, x.second) = 0 AND greatest(x.digit, x.second) = 9 THEN '9' WHEN x.p1 + x.p2 >= 0.8 AND abs(x.digit - x.second) = 1 THEN least(x.digit, x.second)::VARCHAR
  WHEN i = 5 THEN '0' ELSE '?' END) AS c FROM cells)
SELECT photo, CASE WHEN f IS NULL THEN array_to_string(c, '') END AS reading, coalesce(f, CASE WHEN list_contains(c, '?') THEN 'low_conf' END) AS error,
 CASE WHEN f IS NULL AND NOT list_contains(c, '?') THEN array_to_string(c, '')::BIGINT END AS number FROM chars""")
def reading(spark, sf):
    return digits.readings(_photos(spark, sf), 0.8, forgive=1, drum_rule=True).select("photo", "reading", "error", "number")


@query("f21_drum_digit", with_("boxes", """SELECT photo, x1, CASE WHEN p1 + p2 < 0.9 THEN NULL WHEN least(digit, second) = 0 AND greatest(digit, second) = 9 THEN 9 WHEN abs(digit - second) = 1 THEN least(digit, second) END::INTEGER AS d FROM boxes"""))
def drum_digit(spark, sf):
    return A.boxes(spark, sf).select("photo", "x1", scalars.drum_digit(F.col("digit"), F.col("p1"), F.col("second"), F.col("p2"), 0.9).cast("int").alias("d"))


@query("w11_best_boxes", with_("boxes", """SELECT photo, class, x1 FROM (SELECT photo, CASE class WHEN 'gas_meter' THEN 'meter' ELSE class END AS class, conf, x1 FROM boxes)
QUALIFY row_number() OVER (PARTITION BY photo, class ORDER BY conf DESC, x1) <= CASE class WHEN 'serial' THEN 2 ELSE 1 END"""))
def best_boxes(spark, sf):
    return digits.best_boxes(A.boxes(spark, sf), {"serial": 2}).select("photo", "class", "x1")


@query("p04_first_detection", with_("boxes", """SELECT photo, first(x1 ORDER BY x1) AS x1 FROM boxes WHERE class IN ('meter', 'gas_meter') GROUP BY photo"""))
def first_detection(spark, sf):
    by = A.boxes(spark, sf).groupBy("photo").agg(F.array_sort(F.collect_list(F.struct("x1", "class"))).alias("b"))
    return by.select("photo", digits.first_of_class(F.col("b"), "meter")["x1"].alias("x1")).where("x1 is not null")


@query("f37_suppressed")
def suppressed(spark, sf):
    """Greedy suppression of overlapping boxes, each photo's few boxes in one fold."""
    wide = A.boxes(spark, sf).withColumn("x2", F.col("x1") + 40)
    return digits.suppressed(wide, ["photo"])


@query("f37_chosen_lines", """WITH lines AS (SELECT l_orderkey AS photo, l_partkey % 4 = 0 AS refused, l_suppkey % 3 = 0 AS strict, (l_partkey % 90)::DOUBLE AS x, (l_suppkey % 25)::DOUBLE AS y, (30 + l_partkey % 23)::DOUBLE AS w, (18 + l_linenumber % 4)::DOUBLE AS h, (l_partkey * 7919 % 1000) / 1000.0::DOUBLE AS likeness FROM lineitem),
folded AS (SELECT photo, list_reduce(list([{'refused': refused, 'strict': strict, 'x': x, 'y': y, 'w': w, 'h': h, 'likeness': likeness}] ORDER BY refused, strict, w DESC, likeness DESC, x, y, h), lambda kept, n:
  CASE WHEN coalesce(list_position(list_transform(kept, lambda k: greatest(0, least(k.x + k.w, n[1].x + n[1].w) - greatest(k.x, n[1].x)) * greatest(0, least(k.y + k.h, n[1].y + n[1].h) - greatest(k.y, n[1].y)) / greatest(1, least(k.w * k.h, n[1].w * n[1].h)) >= 0.5), true), 0) = 0 THEN list_concat(kept, n)
  ELSE list_transform(kept, lambda k, i: CASE WHEN i = list_position(list_transform(kept, lambda k2: greatest(0, least(k2.x + k2.w, n[1].x + n[1].w) - greatest(k2.x, n[1].x)) * greatest(0, least(k2.y + k2.h, n[1].y + n[1].h) - greatest(k2.y, n[1].y)) / greatest(1, least(k2.w * k2.h, n[1].w * n[1].h)) >= 0.5), true)
    AND k.refused = n[1].refused AND k.strict = n[1].strict AND abs(n[1].w - k.w) <= n[1].h / 3 AND n[1].likeness > k.likeness THEN n[1] ELSE k END) END) AS kept FROM lines GROUP BY photo)
SELECT photo, b.refused AS refused, b.strict AS strict, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.likeness AS likeness FROM (SELECT photo, unnest(kept) AS b FROM folded)""")
def chosen_lines(spark, sf):
    """Greedy suppression of overlapping lines with replacement of twins, each photo's few lines in one fold."""
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo"), (k % 4 == 0).alias("refused"), (s % 3 == 0).alias("strict"), (k % 90).alias("x"), (s % 25).alias("y"), (30 + k % 23).alias("w"), (18 + n % 4).alias("h"), (k * 7919 % 1000 / 1000.0).alias("likeness"))
    return digits.chosen_lines(lines, ["photo"])


@query("p05_serial_gate", with_("runs", "SELECT seq, conf >= 0.6 AS taken FROM runs"))
def serial_gate(spark, sf):
    return A.runs(spark, sf).select("seq", (F.col("conf") >= 0.6).alias("taken"))


@query("p02_meaningful", with_("runs", "SELECT seq FROM runs WHERE NOT starts_with(notes, 'copy of')"))
def meaningful(spark, sf):
    from ..operators.photos import meaningful as rows

    return rows(A.runs(spark, sf)).select("seq")


@query("p11_matches", with_("reads texts", """SELECT photo, "true" IN ("read", '0' || "read", '00' || "read") AS serial_ok, lpad("read", greatest(5, length("read"))::INTEGER, '0') = lpad("true", greatest(5, length("true"))::INTEGER, '0') AS reading_ok FROM texts"""))
def matches(spark, sf):
    r, t = F.col("read"), F.col("true")
    return A.texts(spark, sf).select("photo", F.array_contains(scalars.lookup_variants(r), t).alias("serial_ok"), (scalars.zero_filled(r, 5) == scalars.zero_filled(t, 5)).alias("reading_ok"))


@query("p13_review_reason", with_("reads texts", """SELECT photo, CASE WHEN "read" <> "true" THEN 'mismatch' ELSE 'low_conf' END AS reason FROM texts WHERE "read" <> "true" OR conf < 0.5"""))
def review_reason(spark, sf):
    reason = F.when(F.col("read") != F.col("true"), "mismatch").when(F.col("conf") < 0.5, "low_conf")
    return A.texts(spark, sf).select("photo", reason.alias("reason")).where("reason is not null")


@query("p17_label_lines", """SELECT event_id, regexp_full_match(line, '[0-9]+( [0-9]+([.][0-9]+)?){4}') AND split_part(line, ' ', 1)::INTEGER < 4 AND split_part(line, ' ', 2)::DOUBLE <= 1 AS valid FROM (
SELECT event_id, (event_id % 5)::VARCHAR || ' ' || (event_id % 12)::VARCHAR || '.5 0.5 0.1 0.1' AS line FROM events)""")
def label_lines(spark, sf):
    k = F.col("event_id")
    line = F.concat((k % 5).cast("string"), F.lit(" "), (k % 12).cast("string"), F.lit(".5 0.5 0.1 0.1"))
    return table(spark, sf, "events").select("event_id", scalars.valid_label(line, 4).alias("valid"))


@query("f06_clean_serial", r"SELECT p_partkey, regexp_replace(regexp_replace(' .' || p_name || '/, ', '^[ .,/\\]+', ''), '[ .,/\\]+$', '') AS serial FROM part")
def clean_serial(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.clean_serial(F.concat(F.lit(" ."), "p_name", F.lit("/, "))).alias("serial"))


@query("f07_number_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE (floor(o_totalprice)::BIGINT + 0.5)::DECIMAL(18,1)::VARCHAR END AS text FROM orders")
def number_text(spark, sf):
    x = F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.floor("o_totalprice") + 0.5)
    return table(spark, sf, "orders").select("o_orderkey", scalars.number_text(x).alias("text"))


@query("f08_accounts", "SELECT c_custkey, c_custkey::VARCHAR AS compared, '0' || c_custkey::VARCHAR AS stored FROM customer")
def accounts(spark, sf):
    a = F.concat(F.lit("0"), F.col("c_custkey").cast("string"), F.lit(".0"))
    return table(spark, sf, "customer").select("c_custkey", scalars.compared_account(a).alias("compared"), scalars.stored_account(a).alias("stored"))


@query("f10_crop_names", "SELECT doc_id, doc_id::VARCHAR AS photo, 'serial' AS kind, (doc_id % 7)::INTEGER AS n, CASE WHEN doc_id % 2 = 0 THEN '00' || doc_id::VARCHAR END AS answer FROM documents")
def crop_names(spark, sf):
    k = F.col("doc_id").cast("string")
    name = F.concat(k, F.lit("__serial"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("__00"), k)).otherwise(""), F.lit(".jpg"))
    return table(spark, sf, "documents").select("doc_id", scalars.crop_name_parts(name).alias("c")).select("doc_id", "c.*")


@query("f17_fingerprints", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


@query("f24_low_conf_text", with_("runs", r"""SELECT seq, regexp_extract_all(notes, 'pos([0-9]+)\(pred=([0-9]),conf=([0-9.]+)\)', 1) AS positions FROM runs WHERE starts_with(notes, 'low conf')"""))
def low_conf_text(spark, sf):
    from ..operators.analytics import LOW_CONF

    return A.runs(spark, sf).where(F.col("notes").startswith("low conf")).select("seq", F.regexp_extract_all("notes", F.lit(LOW_CONF), F.lit(1)).alias("positions"))


@query("f26_presets", """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INTEGER <= 50 THEN json_extract_string(props, '$.k')::INTEGER ELSE 5 END AS k FROM events""")
def presets(spark, sf):
    """Settings from JSON: unknown keys are left out, values out of range become the default."""
    return table(spark, sf, "events").select("event_id", scalars.preset_number(F.col("props"), "k", 0, 50, 5).alias("k"))


@query("j10_serial_agrees", with_("reads texts", """SELECT photo, levenshtein("read", "true") <= 1 OR levenshtein('0' || "read", "true") <= 1 OR levenshtein('00' || "read", "true") <= 1 AS agrees FROM texts"""))
def serial_agrees(spark, sf):
    return A.texts(spark, sf).select("photo", scalars.serial_agrees(F.col("read"), F.col("true")).alias("agrees"))


def _register(spark, sf):
    return A.register(spark, sf).select(F.concat(F.lit("13"), F.lpad("account", 8, "0")).alias("account"), "last")


_FORMS = """WITH acc AS (SELECT '13' || lpad(c_custkey::VARCHAR, 8, '0') AS account FROM customer), num AS (SELECT DISTINCT o_custkey::VARCHAR AS number FROM orders),
forms AS (SELECT account, right(account, k) AS f FROM acc, range(4, 11) r(k) WHERE right(account, k)::BIGINT > 0
 UNION SELECT account, right(account, k) FROM acc, range(1, 9) r(k) WHERE k >= length(ltrim(substr(account, 3), '0'))
 UNION SELECT account, '13' || right(account, k) FROM acc, range(1, 9) r(k) WHERE k >= length(ltrim(substr(account, 3), '0')))
SELECT number, account FROM num JOIN forms ON number = f
UNION SELECT number, account FROM num, range(1, 9) r(k) JOIN acc ON left(account, k) = left(number, k) AND substr(account, k + 1)::BIGINT > 0 AND ltrim(substr(account, k + 1), '0') = ltrim(substr(number, k + 1), '0') WHERE length(number) > k"""


@query("j19_account_forms", _FORMS)
def account_forms(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("number")).distinct()
    return notes.accounts_of(asked, notes.account_keys(_register(spark, sf).select("account")))


@query("f25_note_tokens", "SELECT o_orderkey AS photo, 'account' AS kind, o_custkey::VARCHAR AS number FROM orders UNION ALL SELECT o_orderkey, 'reading', (floor(o_totalprice)::BIGINT % 12000)::VARCHAR FROM orders")
def note_tokens(spark, sf):
    text = F.concat(F.lit("лс"), "owner", F.lit("пок"), F.col("reading").cast("string"))
    return A.reads(spark, sf).select("photo", F.explode(notes.tokens(text)).alias("t")).select("photo", "t.*")


@query("r03_interpreted", with_("register reads", "").rstrip() + f""", forms_of AS ({_FORMS}),
few AS (SELECT * FROM forms_of QUALIFY count(*) OVER (PARTITION BY number) <= 3),
fit AS (SELECT photo, few.account FROM reads JOIN few ON number = owner JOIN register r ON few.account = '13' || lpad(r.account, 8, '0') WHERE reading - last BETWEEN -1500 AND 3000),
told AS (SELECT photo, count(DISTINCT account) AS n, min(account) AS a FROM fit GROUP BY photo)
SELECT photo, CASE WHEN n = 1 THEN a END AS account, CASE WHEN n = 1 THEN reading END AS reading, coalesce(n = 1, FALSE) AS understood, coalesce(n > 1, FALSE) AS conflict FROM reads LEFT JOIN told USING (photo)""")
def interpreted(spark, sf):
    """Notes of an account and a reading below each other, judged against the register: the one account of at most three forms that the reading fits."""
    lines = F.array(F.concat(F.lit("лс"), "owner"), F.concat(F.lit("пок"), F.col("reading").cast("string")))
    asked = A.reads(spark, sf).select("photo", lines.alias("lines"), F.lit(None).cast("string").alias("account"), F.lit(None).cast("bigint").alias("barrel"), F.lit(0).alias("unread"))
    return notes.interpreted(asked, _register(spark, sf))


def _matrices(spark, sf):
    """Steps by symbols for each supplier: its key's digits with blanks between, blurred by a fixed rule."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 4, "0")
    at = lambda t: F.when(t % 2 == 1, F.substring(key, F.floor(t / 2).cast("int") + 1, F.lit(1)).cast("int")).otherwise(10)
    cell = lambda t, c: F.when(c == at(t), -0.1 - (F.col("s_suppkey") % 7) / 10).otherwise(-4.0 - ((F.col("s_suppkey") + t * 3 + c) % 5) / 5)
    matrix = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda c: cell(t, c).cast("double")))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"), matrix.alias("matrix"))


@query("f27_greedy_text", "SELECT s_suppkey AS image, lpad(s_suppkey::VARCHAR, 4, '0') AS text FROM supplier")
def greedy_text(spark, sf):
    return _matrices(spark, sf).select("image", lexicon.greedy_text(F.col("matrix"), "0123456789", 10).alias("text"))


@query("j21_lexicon_matches")
def lexicon_matches(spark, sf):
    """The three likeliest groups of each image; the lexicon is every second supplier and near misses of them."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 4, "0")
    words = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("group"), F.explode(F.array(key, F.substring(key, 2, 3))).alias("string"))
    return lexicon.lexicon_matches(_matrices(spark, sf), words, "0123456789", 10)


@query("f36_nearest_glyph", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
bank AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) r(i) WHERE i <= len(e) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, bank.label, list_cosine_similarity(e, c) AS sim FROM v, bank)
SELECT vec_id, first(label ORDER BY sim DESC, label) AS nearest FROM s GROUP BY vec_id""")
def nearest_glyph(spark, sf):
    """The label whose mean vector is nearest by cosine: the few means are broadcast after a check of their number."""
    from ..operators import glyphs

    return glyphs.nearest(table(spark, sf, "embeddings"), glyphs.bank(table(spark, sf, "embeddings"))).select("vec_id", "nearest")


_SHAPED = """v AS (SELECT vec_id, ['0', 'о', 'п', 'к', '1', '2', '3', '4', '5', '6'][label + 1] AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e, 0.5 + (vec_id * 37 % 100) / 50.0::DOUBLE AS aspect, 0.6 + (vec_id * 53 % 40) / 50.0::DOUBLE AS height, vec_id % 5 AS font FROM embeddings),
bank AS (SELECT label, font, list(m ORDER BY i) AS c, any_value(a) AS a, any_value(h) AS h FROM (SELECT label, font, i, avg(e[i]) AS m FROM v, range(1, 65) r(i) WHERE i <= len(e) GROUP BY ALL) JOIN (SELECT label, font, avg(aspect) AS a, avg(height) AS h FROM v GROUP BY ALL) USING (label, font) GROUP BY label, font),
s AS (SELECT vec_id, bank.label, list_cosine_similarity(e, c) AS sim, abs(ln(aspect / a)) AS apart, list_cosine_similarity(e, c) - 0.3 * abs(ln(aspect / a)) - 0.8 * abs(height - h) AS score FROM v, bank),
l AS (SELECT vec_id, label, max(score) AS top, min(apart) AS near, max(sim) AS sim FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY top DESC, label) AS k FROM l),
g AS (SELECT vec_id, any_value(label) FILTER (k = 1) AS best, any_value(label) FILTER (k = 2) AS other, any_value(top) FILTER (k = 1) - any_value(top) FILTER (k = 2) AS margin, max(sim) AS likeness, any_value(near) FILTER (k = 1) AS deviation FROM r GROUP BY vec_id)"""


@query("f36_read_glyphs", f"""WITH {_SHAPED}
SELECT vec_id, best, other, round(margin, 6) AS margin, round(likeness, 6) AS likeness, round(deviation, 6) AS deviation,
 CASE WHEN margin < 0.05 AND best IN ('0', 'о') AND other IN ('0', 'о') THEN CASE WHEN lag(best) OVER w = 'п' OR lead(best) OVER w = 'к' THEN 'о' ELSE '0' END ELSE best END AS "char"
FROM g WINDOW w AS (PARTITION BY vec_id // 8 ORDER BY vec_id)""")
def read_glyphs(spark, sf):
    """Glyphs by shape, proportions and height against a bank of fonts, and the rule for 0 and о in lines of eight."""
    from ..operators import glyphs

    k = F.col("vec_id")
    label = F.element_at(F.array(*[F.lit(c) for c in "0опк123456"]), F.col("label") + 1)
    rows = table(spark, sf, "embeddings").select("vec_id", label.alias("label"), "embedding", (0.5 + k * 37 % 100 / 50.0).alias("aspect"), (0.6 + k * 53 % 40 / 50.0).alias("height"), (k % 5).alias("font"))
    read = glyphs.read_glyphs(rows, glyphs.bank_of_shapes(rows, "font")).withColumn("line", F.floor(k / 8))
    out = glyphs.zero_or_o(read, "line", "vec_id", 0.05)
    return out.select("vec_id", "best", "other", *[F.round(c, 6).alias(c) for c in ("margin", "likeness", "deviation")], "char")


@query("r14_meter_turns", "SELECT l_orderkey AS photo, min([0, 90, 180, 270][l_linenumber % 4 + 1]) FILTER (l_partkey % 3 = 0) AS turn FROM lineitem GROUP BY l_orderkey")
def meter_turns(spark, sf):
    turn = F.element_at(F.array(*[F.lit(x) for x in (0, 90, 180, 270)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return digits.meter_turn(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo"), turn.alias("turn"), (F.col("l_partkey") % 3 == 0).alias("has_meter")))


@query("r06_judged_notes", """WITH n AS (SELECT o_orderkey AS photo, o_orderkey % 3 <> 0 AS understood, o_orderkey % 7 = 0 AS conflict, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 50 END AS account, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 40 END AS reading, o_custkey % 50 + (o_orderkey % 9 = 0)::INT AS ta, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 40 + (o_orderkey % 8 = 0)::INT END AS tr FROM orders)
SELECT photo, CASE WHEN coalesce(account <> ta OR reading <> tr, account <> ta, reading <> tr, FALSE) THEN 'danger' WHEN conflict THEN 'conflict' WHEN understood AND (account IS NOT NULL OR reading IS NOT NULL) THEN 'right' WHEN understood THEN 'confirms' ELSE 'unclear' END AS verdict FROM n""")
def judged_notes(spark, sf):
    from ..operators import events

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flag = lambda n: (k % n == 0).cast("int")
    notes = table(spark, sf, "orders").select(k.alias("photo"), (k % 3 != 0).alias("understood"), (k % 7 == 0).alias("conflict"), F.when(k % 4 != 0, c % 50).alias("account"), F.when(k % 5 != 0, k % 40).alias("reading"), (c % 50 + flag(9)).alias("true_account"), F.when(k % 11 != 0, k % 40 + flag(8)).alias("true_reading"))
    return events.judged(notes).select("photo", "verdict")
