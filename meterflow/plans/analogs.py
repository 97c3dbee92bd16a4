"""Stand-ins for registers, readings and logs, derived from the driver tables by fixed formulas. None of it is real data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, serial, last, row_order from customer."""
    k = (F.col("c_custkey") * 7919) % 1201
    zeros = F.expr("repeat('0', cast((c_custkey * 7919) % 1201 % 3 as int))")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("account"), F.concat(zeros, k.cast("string")).alias("serial"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("last"), F.col("c_custkey").alias("row_order")
    )


def next_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next month's register: some accounts gone, new ones come, serials and last readings changed."""
    old = register(spark, sf_dir).where("row_order % 11 <> 0")
    account = F.when(F.col("row_order") % 13 == 0, F.concat(F.lit("N"), "account")).otherwise(F.col("account"))
    serial = F.when(F.col("row_order") % 7 == 0, F.concat("serial", F.lit("9"))).otherwise(F.col("serial"))
    last = F.when(F.col("row_order") % 5 == 0, F.col("last") + 1).otherwise(F.col("last"))
    return old.select(account.alias("account"), serial.alias("serial"), last.alias("last"), "row_order")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, serial_read, reading, owner, day from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("photo"),
        ((F.col("o_orderkey") * 31) % 1300).cast("string").alias("serial_read"),
        (F.floor("o_totalprice") % 12000).cast("bigint").alias("reading"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderdate").alias("day"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, account, outcome, name, folder, source, notes, photo_hash, value from events."""
    e = table(spark, sf_dir, "events")
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])[F.col("event_type")]
    name = F.concat(F.lit("p"), (F.col("event_id") % 997).cast("string"), F.lit(".jpg"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("account"),
        outcome.alias("outcome"),
        name.alias("name"),
        F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("f"), (F.col("event_id") % 997 % 5).cast("string"))).alias("folder"),
        F.when(F.col("event_id") % 9 == 0, "manual").otherwise("auto").alias("source"),
        F.when(F.col("event_id") % 19 == 0, "copy of p1.jpg").otherwise("").alias("notes"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.sha2(name, 256)).alias("photo_hash"),
        "value",
    )


OUTCOMES = {"click": "PLUS", "view": "MINUS", "purchase": "SUSPICIOUS", "signup": "REPEAT", "error": "ERROR"}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, true, conf, part: serials with a read that differs in some rows, from reads."""
    true = F.col("serial_read")
    wrong = F.concat(F.substring(true, F.lit(1), F.length(true) - 1), (F.col("photo") % 10).cast("string"))
    read = F.when(F.col("photo") % 5 == 0, wrong).when(F.col("photo") % 17 == 0, F.concat(true, F.lit("7"))).otherwise(true)
    return reads(spark, sf_dir).select("photo", true.alias("true"), read.alias("read"), ((F.col("photo") * 37 % 100) / 100.0).alias("conf"), (F.col("photo") % 6).alias("part"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fuller processing log from orders: seq, folder, name, final_name, photo_hash, source, outcome, serial, account, reading, model_reading, conf, verified_by, notes, delta."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    name = F.concat(F.lit("p"), (k % 4001).cast("string"), F.lit(".jpg"))
    reading = (F.floor("o_totalprice") % 12000).cast("bigint")
    digits = F.lpad(reading.cast("string"), 5, "0")
    auto = F.element_at(F.array(*[F.lit(x) for x in AUTO_OUTCOMES]), (k % 11 + 1).cast("int"))
    manual = F.element_at(F.array(*[F.lit(x) for x in MANUAL_OUTCOMES]), (k % 5 + 1).cast("int"))
    source = F.when(k % 7 == 0, "manual").otherwise("auto")
    unsure = F.when(k % 8 == 1, F.concat(F.lit("?"), F.substring(digits, 2, 4))).when(k % 8 == 2, F.concat(F.substring(digits, 1, 2), F.lit("?"), F.substring(digits, 4, 2))).otherwise(digits)
    rows = o.select(
        k.alias("seq"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("f"), (k % 6).cast("string"))).alias("folder"), name.alias("name"),
        F.when(k % 4001 % 3 == 0, "").otherwise(F.sha2(name, 256)).alias("photo_hash"), source.alias("source"),
        F.when(k % 7 == 0, manual).otherwise(auto).alias("outcome"), ((k * 31) % 1300).cast("string").alias("serial"),
        F.col("o_custkey").cast("string").alias("account"), reading.alias("reading"), unsure.alias("model_reading"), ((k * 37 % 1000) / 1000.0).alias("conf"),
        F.when((k % 7 != 0) & (k % 3 == 0), "op").otherwise("").alias("verified_by"), (reading - (k * 13 % 9000)).cast("double").alias("delta"),
    )
    seq = F.col("seq")
    low = F.concat(F.lit("low conf digits: pos"), (seq % 5).cast("string"), F.lit("(pred="), (seq % 10).cast("string"), F.lit(",conf=0.412), pos4(pred=7,conf=0.300)"))
    notes = F.when(F.col("outcome") == "DIGITS_ERROR", F.when(seq % 2 == 0, low).when(seq % 3 == 0, "expected 5 digits, got 3").otherwise("")).when(seq % 23 == 0, "copy of p1.jpg")
    notes = notes.when((F.col("verified_by") == "op") & (seq % 5 == 0), "corrected at check").when(seq % 29 == 0, "filled: pos2='5' (not found), pos4='0' (read 7)").otherwise("")
    return rows.withColumn("final_name", F.when(F.col("outcome").isin("NO_METER", "SERIAL_NOT_FOUND"), "").otherwise(F.col("name"))).withColumn("notes", notes)


AUTO_OUTCOMES = ["PLUS", "PLUS", "PLUS", "PLUS", "MINUS", "MINUS", "REPEAT", "SERIAL_NOT_FOUND", "DIGITS_ERROR", "SUSPICIOUS", "NO_METER"]
MANUAL_OUTCOMES = ["PLUS", "MINUS", "NOT_IN_DB", "UNREADABLE", "PLUS"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit boxes from lineitem: photo, class, conf, x1, x2, digit, p1, second, p2."""
    at = F.col("l_linenumber") * 24 + F.col("l_partkey") % 5 + F.when((F.col("l_orderkey") % 9 == 0) & (F.col("l_linenumber") >= 3), 25).otherwise(0)
    digit = (F.col("l_suppkey") % 10).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("photo"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("class"),
        (F.col("l_partkey") * 53 % 1000 / 1000.0).alias("conf"), at.cast("int").alias("x1"), (at + 20).cast("int").alias("x2"), digit.alias("digit"),
        (0.5 + F.col("l_partkey") * 7 % 500 / 1000.0).alias("p1"), ((F.col("l_suppkey") + 1 + F.col("l_orderkey") % 2) % 10).cast("int").alias("second"), (F.col("l_partkey") * 11 % 400 / 1000.0).alias("p2"),
    )


CLASSES = ["meter", "gas_meter", "serial", "account"]


#: The same tables as SQL, to be put before a query's own.
SQL = {
    "register": """register AS (
  SELECT c_custkey::VARCHAR AS account, repeat('0', ((c_custkey * 7919) % 1201 % 3)::BIGINT) || ((c_custkey * 7919) % 1201)::VARCHAR AS serial,
         floor(abs(c_acctbal))::BIGINT AS last, c_custkey AS row_order FROM customer)""",
    "next_register": """next_register AS (
  SELECT CASE WHEN row_order % 13 = 0 THEN 'N' || account ELSE account END AS account,
         CASE WHEN row_order % 7 = 0 THEN serial || '9' ELSE serial END AS serial,
         CASE WHEN row_order % 5 = 0 THEN last + 1 ELSE last END AS last, row_order FROM register WHERE row_order % 11 <> 0)""",
    "reads": """reads AS (
  SELECT o_orderkey AS photo, ((o_orderkey * 31) % 1300)::VARCHAR AS serial_read, (floor(o_totalprice)::BIGINT % 12000)::BIGINT AS reading,
         o_custkey::VARCHAR AS owner, o_orderdate AS day FROM orders)""",
    "variants": """variants AS (
  SELECT photo, serial_read, reading, 0 AS priority, serial_read AS serial FROM reads
  UNION ALL SELECT photo, serial_read, reading, 1, '0' || serial_read FROM reads
  UNION ALL SELECT photo, serial_read, reading, 2, '00' || serial_read FROM reads)""",
    "log": """log AS (
  SELECT event_id AS seq, user_id::VARCHAR AS account,
         CASE event_type WHEN 'click' THEN 'PLUS' WHEN 'view' THEN 'MINUS' WHEN 'purchase' THEN 'SUSPICIOUS' WHEN 'signup' THEN 'REPEAT' WHEN 'error' THEN 'ERROR' END AS outcome,
         'p' || (event_id % 997)::VARCHAR || '.jpg' AS name,
         CASE WHEN event_id % 17 = 0 THEN '' ELSE 'f' || (event_id % 997 % 5)::VARCHAR END AS folder,
         CASE WHEN event_id % 9 = 0 THEN 'manual' ELSE 'auto' END AS source,
         CASE WHEN event_id % 19 = 0 THEN 'copy of p1.jpg' ELSE '' END AS notes,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE sha256('p' || (event_id % 997)::VARCHAR || '.jpg') END AS photo_hash, value FROM events)""",
    "filled": """filled AS (
  SELECT log.* EXCLUDE (folder), CASE WHEN folder = '' THEN coalesce(known.f, '') ELSE folder END AS folder
  FROM log LEFT JOIN (SELECT name, min(folder) AS f FROM log WHERE folder <> '' GROUP BY name HAVING min(folder) = max(folder)) known USING (name))""",
    "last_rows": """last_rows AS (
  SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY outcome = 'REPEAT', seq DESC) = 1)""",
    "texts": """texts AS (
  SELECT photo, serial_read AS "true", CASE WHEN photo % 5 = 0 THEN left(serial_read, length(serial_read) - 1) || (photo % 10)::VARCHAR
         WHEN photo % 17 = 0 THEN serial_read || '7' ELSE serial_read END AS "read", (photo * 37 % 100) / 100.0::DOUBLE AS conf, photo % 6 AS part FROM reads)""",
    "runs": """runs AS (
  SELECT *, CASE WHEN outcome IN ('NO_METER', 'SERIAL_NOT_FOUND') THEN '' ELSE name END AS final_name,
    CASE WHEN outcome = 'DIGITS_ERROR' THEN CASE WHEN seq % 2 = 0 THEN 'low conf digits: pos' || (seq % 5)::VARCHAR || '(pred=' || (seq % 10)::VARCHAR || ',conf=0.412), pos4(pred=7,conf=0.300)'
           WHEN seq % 3 = 0 THEN 'expected 5 digits, got 3' ELSE '' END
         WHEN seq % 23 = 0 THEN 'copy of p1.jpg' WHEN verified_by = 'op' AND seq % 5 = 0 THEN 'corrected at check'
         WHEN seq % 29 = 0 THEN 'filled: pos2=''5'' (not found), pos4=''0'' (read 7)' ELSE '' END AS notes
  FROM (SELECT k AS seq, CASE WHEN k % 17 = 0 THEN '' ELSE 'f' || (k % 6)::VARCHAR END AS folder, name, CASE WHEN k % 4001 % 3 = 0 THEN '' ELSE sha256(name) END AS photo_hash,
      CASE WHEN k % 7 = 0 THEN 'manual' ELSE 'auto' END AS source,
      CASE WHEN k % 7 = 0 THEN ['PLUS', 'MINUS', 'NOT_IN_DB', 'UNREADABLE', 'PLUS'][k % 5 + 1]
        ELSE ['PLUS', 'PLUS', 'PLUS', 'PLUS', 'MINUS', 'MINUS', 'REPEAT', 'SERIAL_NOT_FOUND', 'DIGITS_ERROR', 'SUSPICIOUS', 'NO_METER'][k % 11 + 1] END AS outcome,
      ((k * 31) % 1300)::VARCHAR AS serial, owner AS account, r AS reading,
      CASE WHEN k % 8 = 1 THEN '?' || substr(d, 2, 4) WHEN k % 8 = 2 THEN substr(d, 1, 2) || '?' || substr(d, 4, 2) ELSE d END AS model_reading,
      (k * 37 % 1000) / 1000.0::DOUBLE AS conf, CASE WHEN k % 7 <> 0 AND k % 3 = 0 THEN 'op' ELSE '' END AS verified_by, (r - (k * 13 % 9000))::DOUBLE AS delta
    FROM (SELECT o_orderkey AS k, o_custkey::VARCHAR AS owner, 'p' || (o_orderkey % 4001)::VARCHAR || '.jpg' AS name,
      floor(o_totalprice)::BIGINT % 12000 AS r, lpad((floor(o_totalprice)::BIGINT % 12000)::VARCHAR, 5, '0') AS d FROM orders)))""",
    "boxes": """boxes AS (
  SELECT l_orderkey AS photo, ['meter', 'gas_meter', 'serial', 'account'][l_partkey % 4 + 1] AS class, (l_partkey * 53 % 1000) / 1000.0::DOUBLE AS conf, x1, x1 + 20 AS x2,
    (l_suppkey % 10)::INTEGER AS digit, 0.5::DOUBLE + (l_partkey * 7 % 500) / 1000.0::DOUBLE AS p1, ((l_suppkey + 1 + l_orderkey % 2) % 10)::INTEGER AS second, (l_partkey * 11 % 400) / 1000.0::DOUBLE AS p2
  FROM (SELECT *, (l_linenumber * 24 + l_partkey % 5 + CASE WHEN l_orderkey % 9 = 0 AND l_linenumber >= 3 THEN 25 ELSE 0 END)::INTEGER AS x1 FROM lineitem))""",
}


def with_(names: str, body: str) -> str:
    """SQL with these tables before it; a body that begins with a comma adds tables of its own."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + ("" if body[:1] in (",", "") else "\n") + body
