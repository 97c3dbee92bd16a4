"""Reference and training sets, chosen lines, glyphs by shape, manifests and versions: cases by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from meterflow.operators import dataset_checks, digits, glyphs, reference_sets, training_sets
from meterflow.sources import sinks, tables

ANSWER = "key string, stratum string, answer string, last string"


def test_adding_twice_changes_nothing(spark):
    answers = spark.createDataFrame([(f"k{n}", "ab"[n % 5 == 0], str(n), "1" if n % 2 else "") for n in range(200)] + [("k3", "a", "other", ""), (None, "a", "x", "")], ANSWER)
    known = spark.createDataFrame([("k1", "a", "1", ""), ("k2", "a", "2", "old"), ("gone", "b", "9", "")], ANSWER)
    quotas = spark.createDataFrame([("a", 20), ("b", 1), ("c", 4)], "stratum string, quota int")
    once = reference_sets.added(known, answers, quotas, 20, "s")
    rows = {r["key"]: r for r in once.collect()}
    assert sorted(r["state"] for r in rows.values()) == ["added"] * 18 + ["filled"] + ["kept"] * 2
    assert rows["k1"]["last"] == "1" and rows["k2"]["last"] == "old" and rows["gone"]["stratum"] == "b"
    drawn = sorted((f"k{n}" for n in range(200) if n % 5 and n not in (1, 2)), key=lambda k: hashlib.sha256(f"s{k}".encode()).hexdigest())[:18]
    assert {k for k, r in rows.items() if r["state"] == "added"} == set(drawn)
    again = reference_sets.added(once.drop("state"), answers, quotas, 20, "s")
    assert sorted(map(tuple, again.drop("state").collect())) == sorted(map(tuple, once.drop("state").collect()))
    assert {r["state"] for r in again.collect()} == {"kept"}
    assert reference_sets.added(known.limit(0), answers.limit(0), quotas, 20).count() == 0


def test_files_of_the_reference_set_move_apart(spark):
    files = [("crops/7-1.jpg", "7", None), ("det/images/7.jpg", "7", None), ("det/labels/7.txt", "7", "det/images/7.jpg"), ("det/images/8.jpg", "8", None), ("apart/crops/7-1.jpg", "7", None), ("det/images/9.jpg", "9", None), ("det/labels/9.txt", "9", "det/images/9.jpg"), ("apart/det/labels/9.txt", "9", None)]
    got = reference_sets.kept_apart(spark.createDataFrame(files, "path string, account string, label_of string"), spark.createDataFrame([("7",), ("9",)], "account string"))
    assert {r["path"]: r["moves"] for r in got.collect()} == {"crops/7-1.jpg": False, "det/images/7.jpg": True, "det/labels/7.txt": True, "det/images/9.jpg": False, "det/labels/9.txt": False}


PHOTO = "photo long, account string, failed boolean, has_serial boolean, has_account boolean, has_meter boolean, n_digits int"


def test_a_photo_that_fails_leaves_no_trace(spark):
    photos = spark.createDataFrame([(1, "11", False, True, True, True, 5), (2, "11", True, True, True, True, 5), (3, "11", None, True, False, True, 4), (4, None, False, True, True, True, 5), (5, "12", False, True, True, True, 5), (6, "13", False, False, False, False, 0)], PHOTO)
    serials = spark.createDataFrame([("11", " 0045 "), ("11", "0045"), ("12", "45"), ("12", ""), ("13", "12345"), ("13", "67890")], "account string, serial string")
    readings = spark.createDataFrame([("11", "120"), ("12", "1234567")], "account string, reading string")
    rows = training_sets.built(photos, serials, readings)
    got = {r["photo"]: r for r in rows.collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert [(c["kind"], c["position"], c["answer"]) for c in got[1]["crops"]] == [("serial", 1, "0045"), ("account", 1, "")] + [("digit", k, d) for k, d in enumerate("00120", 1)]
    assert [got[k][c] for k, c in ((3, "reading"), (4, "marker"), (5, "serial"), (5, "reading"), (6, "serial"), (6, "reading"))] == ["not found", "no account in the name", "answer unfit", "answer unfit", "several answers", "not in the table"]
    taken = spark.createDataFrame([("11", "serial", 1, "0045", 1), ("11", "serial", 1, "0045", 3)], "account string, kind string, position int, answer string, copy int")
    names = {(r["photo"], r["kind"], r["position"]): r["copy"] for r in training_sets.named(rows, taken).collect()}
    assert (names[1, "serial", 1], names[3, "serial", 1], names[1, "account", 1], names[5, "account", 1]) == (2, 4, 1, 1)
    assert {(r["kind"], r["state"]): r["n"] for r in training_sets.kind_counts(rows).collect()}["serial", "made"] == 2
    assert training_sets.built(photos.limit(0), serials, readings).count() == 0


def test_crops_are_numbered_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(training_sets, "PHOTOS", 10, raising=False)
    photos = spark.createDataFrame([(n, f"a{n % 40}" if n % 4 else None, False, True, True, True, 5) for n in range(600)], PHOTO)
    serials = spark.createDataFrame([(f"a{n}", str(1000 + n)) for n in range(0, 40, 2)], "account string, serial string")
    readings = spark.createDataFrame([(f"a{n}", str(n)) for n in range(0, 40, 3)], "account string, reading string")
    rows = training_sets.built(photos, serials, readings)
    held = {(n, k) for n, k in ((1, 1), (1, 2), (1, 4), (1, 9), (2, -1), (2, 0), (2, 3))}
    taken = spark.createDataFrame([(f"a{n}", "account", 1, "", k) for n, k in held] + [("a2", "serial", 1, "1002", 1), ("a1", "account", 1, "", None), (None, "account", 1, "", 1)], "account string, kind string, position int, answer string, copy int")
    named = training_sets.named(rows, taken)
    sizes = [len(part) for part in rows.where("account is not null").rdd.glom().collect()]
    assert sum(sizes) == 450 and len(sizes) >= 60 and sum(n == 0 for n in sizes) < len(sizes) - 8
    got = {(r["photo"], r["kind"], r["position"], r["answer"]): r["copy"] for r in named.collect()}
    next_of, expected = {}, {}
    for n in range(600):
        if n % 4:
            a = n % 40
            for kind, position, answer in [("account", 1, "")] + [("serial", 1, str(1000 + a))] * (a % 2 == 0) + [("digit", p, f"{a:05d}"[p - 1]) for p in range(1, 6)] * (a % 3 == 0):
                name = a, kind, position, answer
                there = {k for m, k in held if m == a} if kind == "account" else {1} if (a, kind) == (2, "serial") else set()
                k = next_of.get(name, 1)
                while k in there:
                    k += 1
                expected[n, kind, position, answer], next_of[name] = k, k + 1
    assert got == expected
    assert {(r["kind"], r["state"]): r["n"] for r in training_sets.kind_counts(rows).collect()}["account", "no account in the name"] == 150


def test_chosen_lines(spark):
    lines = [
        (1, False, False, 0, 0, 100, 20, 0.8), (1, False, False, 5, 0, 99, 20, 0.9),  # twins: the likelier one takes the place
        (1, False, True, 0, 0, 100, 20, 0.99), (1, True, False, 0, 0, 300, 20, 1.0),  # another pass, a refused one
        (1, False, False, 0, 100, 50, 20, 0.1), (1, False, False, 60, 0, 40, 18, 0.95),  # elsewhere; a piece, which is no twin
        (2, True, None, 0, 0, 0, 0, None),
    ]
    rows = spark.createDataFrame(lines, "photo int, refused boolean, strict boolean, x int, y int, w int, h int, likeness double")
    got = sorted((r["photo"], r["y"], r["x"], r["likeness"]) for r in digits.chosen_lines(rows, ["photo"]).collect())
    assert got == [(1, 0.0, 5.0, 0.9), (1, 100.0, 0.0, 0.1), (2, 0.0, 0.0, None)]
    assert digits.chosen_lines(rows.limit(0), ["photo"]).count() == 0


def test_glyphs_by_shape(spark):
    bank = spark.createDataFrame([("0", [1.0, 0.0], 1.5, 1.0), ("о", [1.0, 0.0], 1.0, 0.7), ("п", [0.0, 1.0], 1.0, 0.7)], "label string, centre array<double>, aspect double, height double")
    glyph = "vec_id int, embedding array<float>, aspect double, height double"
    rows = spark.createDataFrame([(1, [2.0, 0.0], 1.5, 1.0), (2, [1.0, 0.1], 1.0, 0.7), (3, [0.0, 3.0], 1.0, 0.7), (4, None, 1.0, 1.0), (5, [0.0, 0.0], 1.0, 1.0), (6, [1.0, None], 0.0, 1.0), (7, [1.0], 1.2, 0.85)], glyph)
    got = {r["vec_id"]: r for r in glyphs.read_glyphs(rows, bank).collect()}
    assert set(got) == {1, 2, 3, 7} and [got[k]["best"] for k in (1, 2, 3)] == ["0", "о", "п"] and got[1]["other"] == "о"
    assert got[1]["margin"] == pytest.approx(0.3 * abs(__import__("math").log(1.5)) + 0.8 * 0.3) and got[1]["likeness"] == 1 and got[1]["deviation"] == 0
    assert glyphs.read_glyphs(rows, bank.limit(0)).count() == 0 and glyphs.read_glyphs(rows, bank.limit(1)).first()["margin"] is None
    line = spark.createDataFrame([(1, n, b, o, m) for n, (b, o, m) in enumerate([("п", "к", 0.9), ("0", "о", 0.01), ("к", "п", 0.9), ("0", "о", 0.01), ("7", "1", 0.0), ("о", "0", 0.01), ("0", "о", 0.5)])], "line int, place int, best string, other string, margin double")
    assert "".join(r["char"] for r in glyphs.zero_or_o(line, "line", "place", 0.05).orderBy("place").collect()) == "пок0700"


def test_manifest_and_versions(spark, tmp_path):
    (tmp_path / "w" / "a").mkdir(parents=True)
    (tmp_path / "w" / "a" / "digits.pt").write_bytes(b"weights")
    roles = spark.createDataFrame([("digit", "digits", "a\\digits.pt"), ("serial", "serials", "a/none.pt"), ("account", "markers", "")], "field string, role string, path string")
    got = {r["field"]: r for r in tables.manifest(spark, str(tmp_path / "w"), roles).collect()}
    assert set(got) == {"digit", "serial"} and got["digit"]["sha256"] == hashlib.sha256(b"weights").hexdigest()[:16] and not got["digit"]["missing"] and got["digit"]["size"] == 7
    assert got["serial"]["missing"] and got["serial"]["sha256"] is None
    at = str(tmp_path / "backup")
    removed = [sinks.backup(spark.range(version), at, version, keep=3) for version in range(5)]
    assert removed == [[], [], [], [0], [1]] and sinks.versions_in(at) == [2, 3, 4]
    (tmp_path / "backup" / "version=1").mkdir()  # a write that did not end
    with pytest.raises(Exception, match="no"):
        sinks.backup(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), at, 9, keep=1)
    assert sinks.versions_in(at) == [2, 3, 4]


def test_checks_of_data_sets(spark):
    files = [
        ("b", "boxes", "images", "1.jpg", "h1"), ("b", "boxes", "labels", "1.txt", ""), ("b", "boxes", "images", "2.JPG", "h1"), ("b", "boxes", "labels", "3.txt", ""), ("b", "boxes", "labels", "2.txt", ""),
        ("d", "digits", "3", "7__digit1.jpg", "x"), ("d", "digits", "4", "7__digit2.jpg", "x"), ("d", "digits", "4", "odd.png", ""), ("d", "digits", "4", "Thumbs.db", ""), ("d", "digits", "new", "8__digit1.jpg", "y"),
        ("s", "serials", "images", "7__serial1__123.jpg", "z"), ("s", "serials", "images", "7__serial1__1234.jpg", "z"), ("s", "serials", "images", "7__account1.jpg", "q"),
        ("a", "accounts", "images", "1300-2__account1.jpg", "1"), ("a", "accounts", "images", "IMG__account1.jpg", "2"), ("a", "accounts", "images", None, None),
    ]
    frame = spark.createDataFrame(files, "dataset string, kind string, folder string, name string, hash string")
    lines = spark.createDataFrame([("b", "1.txt", "0 0.1 0.2 0.3 0.4"), ("b", "1.txt", "  "), ("b", "2.txt", "0 0.1 0.2 0.3 1.4"), ("b", "2.txt", "7 0.1 0.2 0.3 0.4")], "dataset string, name string, line string")
    found = dataset_checks.problems(frame, lines, 2)
    assert sorted((r["name"], r["problem"]) for r in found.collect()) == [
        ("1.jpg", "same content"), ("2.JPG", "same content"), ("2.txt", "bad label"), ("3.txt", "label without image"), ("7__account1.jpg", "name not of a serial"), ("7__digit1.jpg", "same content in another digit"), ("7__digit2.jpg", "same content in another digit"),
        ("7__serial1__123.jpg", "answer unfit"), ("7__serial1__123.jpg", "same content"), ("7__serial1__1234.jpg", "same content"), ("8__digit1.jpg", "folder is not read"), ("IMG__account1.jpg", "name not of an account"), ("Thumbs.db", "no image"), ("odd.png", "name not of a digit"),
    ]
    counts = {r["dataset"]: r for r in dataset_checks.report(frame, found).collect()}
    assert (counts["b"]["files"], counts["b"]["images"], counts["b"]["problems"]["same content"]) == (5, 2, 2) and counts["a"]["problems"] == {"name not of an account": 1}
    assert dataset_checks.problems(frame.limit(0), lines.limit(0), 2).count() == 0


def test_files_are_dealt_without_their_parts(spark):
    frame = spark.createDataFrame([("b", "boxes", "l", "1.txt", ""), ("b", "boxes", "i", "1.jpg", "h"), ("d", "digits", "3", "1.jpg", "h"), ("d", "digits", "3", "1.txt", "h"), ("d", None, "3", None, "h"), (None, "accounts", "i", "7__account1.jpg", None)], "dataset string, kind string, folder string, name string, hash string")
    lines = spark.createDataFrame([("b", "1.txt", "9 0.1 0.2 0.3 0.4"), ("d", "1.txt", "x")], "dataset string, name string, line string")
    seen = dataset_checks.looked_at(frame, lines, 2)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    assert "serial|account|digit" in above and "serial|account|digit" not in below  # names are taken apart after all joins
    got = sorted((str(r["name"]), str(r["dataset"]), r["has_label"], r["has_image"], r["bad_lines"], r["copies"], r["crop"] is not None) for r in seen.collect())
    assert got == [("1.jpg", "b", True, True, 0, 1, False), ("1.jpg", "d", False, False, 0, 1, False), ("1.txt", "b", True, True, 1, 1, False), ("1.txt", "d", False, False, 1, 1, False), ("7__account1.jpg", "None", False, False, 0, 1, True), ("None", "d", False, False, 0, 1, False)]
