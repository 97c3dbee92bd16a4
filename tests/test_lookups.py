"""Lookups whose keys have many rows: nothing is multiplied before it is folded, and the results stay those of the plain joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.operators import decisions, lookups, notes, photos

READS = "photo long, serial_read string, reading long"
REGISTER = "account string, serial string, last long, row_order long"
ROWS = [("a", "007", 5, 3), ("b", "007", 6, 1), ("c", "07", 7, 2), ("d", "8", 8, 4), ("b", "007", 9, 9), ("e", "08", 1, 5)]


def operators(plan, kind):
    """The operators of this kind in an optimized plan."""
    below = plan.children()
    found = [plan] if plan.nodeName() == kind else []
    return found + [x for i in range(below.size()) for x in operators(below.apply(i), kind)]


def above_joins(plan):
    """Names of the operators over the uppermost join of each branch."""
    if plan.nodeName() == "Join":
        return set()
    below = plan.children()
    return {plan.nodeName()}.union(*(above_joins(below.apply(i)) for i in range(below.size())))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def tables(spark):
    reads = [(1, "7", 10), (2, "8", 20), (3, "9", 30), (4, "7", 40), (4, "8", 50), (5, "007", 60)]
    return spark.createDataFrame(reads, READS), spark.createDataFrame(ROWS, REGISTER)


def test_matches_are_not_shuffled(spark):
    reads, register = tables(spark)
    got = lookups.prioritised(reads, register)
    assert {(r["photo"], r["priority"], r["account"], r["serial"]) for r in got.collect()} == {(1, 1, "c", "07"), (2, 0, "d", "8"), (4, 0, "d", "8"), (5, 0, "a", "007"), (5, 0, "b", "007")}
    assert not above_joins(optimized(got)) & {"Window", "Aggregate"}


def test_accounts_are_listed_once_for_each_serial(spark):
    reads, register = tables(spark)
    more = spark.createDataFrame([("f", "8", 1, 0)], REGISTER)
    got = lookups.ambiguous(reads, register.unionByName(more))
    assert {tuple(r) for r in got.collect()} == {(2, 2, "f,d"), (4, 2, "f,d"), (5, 2, "b,a,b")}
    one = optimized(got).children().apply(0)
    assert not above_joins(one) & {"Window", "Aggregate"}


def test_choices_are_folded_before_photos_meet_them(spark):
    reads, register = tables(spark)
    got = lookups.serial_choices(reads.unionByName(reads).selectExpr("photo", "serial_read as serial"), register)
    assert sorted(tuple(r) for r in got.collect()) == [(2, "8", "d", 4), (4, "8", "d", 4), (5, "007", "a", 3), (5, "007", "b", 1)]
    assert not above_joins(optimized(got)) & {"Window", "Aggregate"}


def test_truths_of_one_and_of_several_reads(spark):
    reads, register = tables(spark)
    got = lookups.truths(reads, register)
    assert sorted((r["photo"], tuple(r["accounts"]), r["reading"]) for r in got.collect()) == [(1, ("a", "b", "c"), 10), (2, ("d", "e"), 20), (4, ("a", "b", "c", "d", "e"), 50), (5, ("a", "b", "c"), 60)]
    one = optimized(got).children().apply(0)
    assert not above_joins(one) & {"Window", "Aggregate"}


def runs_of(df, column):
    """In each task, the number of times that the column's value changes, and of its different values."""
    parts = [[r[column] for r in rows] for rows in df.select(column).rdd.glom().collect()]
    return [(sum(n == 0 or x != p[n - 1] for n, x in enumerate(p)), len(set(map(str, p)))) for p in parts if p]


def test_equal_lists_come_side_by_side(spark):
    """A file holds the lists of one serial in sequence, whatever the order of the photos."""
    register = spark.createDataFrame([(f"{s}_{a}", str(s), 1, a) for s in range(1, 90) for a in range(3)], REGISTER)
    reads = spark.createDataFrame([(n, str(n % 89 + 1), n) for n in range(3000)], READS)
    got = lookups.truths(reads, register)
    assert {(r["photo"], tuple(r["accounts"])) for r in got.collect()} == {(n, tuple(f"{n % 89 + 1}_{a}" for a in range(3))) for n in range(3000)}
    assert all(changes <= different * lookups.PLACES for changes, different in runs_of(got, "accounts")) and got.rdd.getNumPartitions() >= lookups.TASKS


SERIALS, OWNERS, PHOTOS = 60, 30, 3000


def many(spark):
    """Reads in any order of serials that have many accounts each."""
    register = spark.createDataFrame([(f"{s}_{a}", str(s), a, a) for s in range(1, SERIALS + 1) for a in range(OWNERS)], REGISTER)
    return spark.createDataFrame([(n, str(n % SERIALS + 1), n) for n in range(PHOTOS)], READS), register


def few_changes(df, column):
    """Whether the column's value stays for many rows in all but few places of each task."""
    return sum(changes for changes, _ in runs_of(df, column)) * 5 < df.count()


def test_matches_come_in_runs_of_an_account(spark):
    reads, register = many(spark)
    got = lookups.prioritised(reads, register)
    assert {(r["photo"], r["priority"], r["account"], r["last"]) for r in got.collect()} == {(n, 0, f"{n % SERIALS + 1}_{a}", a) for n in range(PHOTOS) for a in range(OWNERS)}
    assert got.count() == PHOTOS * OWNERS and few_changes(got, "account") and got.rdd.getNumPartitions() >= lookups.TASKS


def test_choices_come_in_runs_of_an_account(spark):
    reads, register = many(spark)
    got = lookups.serial_choices(reads.selectExpr("photo", "serial_read as serial"), register)
    assert {(r["photo"], r["account"], r["row_order"]) for r in got.collect()} == {(n, f"{n % SERIALS + 1}_{a}", a) for n in range(PHOTOS) for a in range(OWNERS)}
    assert got.count() == PHOTOS * OWNERS and few_changes(got, "account") and got.rdd.getNumPartitions() >= lookups.TASKS


def test_log_rows_come_in_blocks(spark):
    """Rows of a key are more than a block holds: each is met once, and a file repeats no more than a block for each photo."""
    log = spark.range(6 * lookups.BLOCK * lookups.PLACES).selectExpr("id as seq", "'n' as row_name", "'' as row_hash")
    asked = spark.createDataFrame([(n, "n", "") for n in range(4)], "photo long, name string, photo_hash string")
    got = lookups.or_key_join(asked, log)
    assert got.select("photo", "seq").distinct().count() == got.count() == 4 * log.count()
    assert sum(changes for changes, _ in runs_of(got, "photo")) >= 4 * log.count() / lookups.BLOCK


def test_all_numbers_of_a_wide_register(spark):
    register = spark.createDataFrame([("1",), ("250000",), ("x",)], "account string")
    got = lookups.dense_ids(register, 8)
    assert got.count() == 250_000 and got.agg({"account": "max"}).first()[0] == "00250000"


LOG = "seq long, source string, outcome string, name string, photo_hash string, notes string, account string"


def test_log_is_folded_before_photos_meet_it(spark):
    log = spark.createDataFrame([(1, "manual", "PLUS", "n", "", "", ""), (2, "auto", "PLUS", "n", "h", "", ""), (3, "auto", "ERROR", "n", "h", "", ""), (4, "auto", "MINUS", "m", "g", "", ""), (5, "manual", "PLUS", "m", "g", "copy of n", "")], LOG)
    asked = spark.createDataFrame([(1, "n", ""), (2, "n", "h"), (3, "n", "x"), (4, "m", ""), (5, "o", "g"), (6, "m", "x"), (7, "n", None)], "photo long, name string, photo_hash string")
    got = photos.processed(asked, log)
    assert sorted((r["photo"], r["reason"], r["row"]) for r in got.collect()) == [(1, "manual", 1), (2, "manual", 1), (3, "manual", 1), (4, "done", 4), (5, "done", 4), (6, None, None), (7, "manual", 1)]
    assert all("Aggregate" in j.right().toString() for j in operators(optimized(got), "Join"))


def test_register_is_folded_before_photos_meet_it(spark):
    rows = spark.createDataFrame([(1, "b", "007"), (2, "z", "007"), (3, None, "8")], "photo long, marker string, serial string")
    reg = spark.createDataFrame(ROWS, REGISTER).selectExpr("account", "serial", "cast(last as double) as register_last", "false as filled", "row_order")
    got = decisions._of_serial(rows, reg)
    assert sorted((r["photo"], r["n"], r["first"]["account"], r["among"]) for r in got.collect()) == [(1, 2, "b", True), (2, 2, "b", False), (3, 1, "d", False)]
    assert all("Aggregate" in j.right().toString() for j in operators(optimized(got), "Join"))


def test_exploded_forms_are_not_broadcast(spark):
    keys = notes.account_keys(spark.createDataFrame([("1300000042",)], "account string"))
    got = notes.accounts_of(spark.createDataFrame([("42",)], "number string"), keys)
    assert [tuple(r) for r in got.collect()] == [("42", "1300000042")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts_of_notes_are_not_broadcast(spark):
    asked = spark.createDataFrame([(1, ["лс42", "пок1100"], None, None, 0)], "photo long, lines array<string>, account string, barrel long, unread int")
    got = notes.interpreted(asked, spark.createDataFrame([("1300000042", 1000)], "account string, last long"))
    assert [tuple(r) for r in got.collect()] == [(1, "1300000042", 1100, True, False)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_frequent_keys_are_spread(spark):
    """Many equal rows of one key and odd hashes give the rows of the plain join, from all tasks that the join names."""
    cases = [None, "", "h", "g"]
    asked = spark.createDataFrame([(n, "n", h) for n, h in enumerate(cases)], "photo long, name string, photo_hash string")
    log = spark.createDataFrame([(n, "n" if n % 5 else "m", cases[n % 4]) for n in range(200)], "seq long, row_name string, row_hash string")
    got = lookups.or_key_join(asked, log)
    plain = asked.join(log, F.expr("(photo_hash <> '' and row_hash <> '' and photo_hash = row_hash) or ((photo_hash = '' or row_hash = '') and name = row_name)"))
    pairs = lambda df: sorted((r["photo"], r["seq"]) for r in df.collect())
    assert pairs(got) == pairs(plain) and got.rdd.getNumPartitions() >= lookups.TASKS
