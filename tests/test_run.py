"""The decision of a photo step by step, on a small register and log, and a run that is cut into batches."""

from __future__ import annotations

import re

import pytest

from meterflow.operators import decisions, month
from meterflow.streaming import cycle

PHOTO = "photo long, name string, photo_hash string, reread boolean, failed boolean, meter boolean, serial string, serial_conf double, table_serial string, table_conf double, marker string, marker_conf double, reading long, digit_error string"
NOTE = ", lines array<string>, unread int"
REGISTER = [("3100000011", "0457", 1000, False, 1), ("3100000012", "981", 2000, False, 2), ("3100000013", "981", 3000, False, 3), ("3100000014", "6604", 4000, True, 4), ("3100000015", "7715", None, False, 5), ("3100000016", "5528", 5000, True, 6)]
LOG = [(1, "3100000016", "5528", "PLUS", "old.jpg", "", "auto", ""), (2, "", "", "DIGITS_ERROR", "again.jpg", "", "auto", ""), (3, "3100000012", "981", "PLUS", "hand.jpg", "h1", "manual", "")]


def photo(n, **own):
    row = {"photo": n, "name": f"n{n}.jpg", "photo_hash": "", "reread": False, "failed": False, "meter": True, "serial": "457", "serial_conf": 0.9, "table_serial": None, "table_conf": None, "marker": None, "marker_conf": None, "reading": 1100, "digit_error": None, "lines": None, "unread": 0}
    return row | own


def run(spark, *photos, notes=True, register=REGISTER, log=LOG):
    schema = PHOTO + NOTE if notes else PHOTO
    rows = [tuple(p[c.split()[0]] for c in schema.split(", ")) for p in photos]
    register = spark.createDataFrame(register, "account string, serial string, last long, filled boolean, row_order long")
    log = spark.createDataFrame(log, "seq long, account string, serial string, outcome string, name string, photo_hash string, source string, notes string")
    got = decisions.decided(spark.createDataFrame(rows, schema), register, log, decisions.Limits(delta=500.0)).collect()
    assert sorted(r["photo"] for r in got) == sorted(p["photo"] for p in photos)
    return {r["photo"]: r for r in got}


#: What a photo shows and the outcome, account and reading that it gets.
CASES = [
    ({}, "PLUS", "3100000011", 1100),
    ({"reading": 900}, "MINUS", "3100000011", 900),
    ({"reading": 1501}, "SUSPICIOUS", "3100000011", 1501),
    ({"reading": 1500}, "PLUS", "3100000011", 1500),  # the limit itself is plain
    ({"serial": "7715", "reading": 9}, "PLUS", "3100000015", 9),  # without a last reading
    ({"reading": None, "digit_error": "gap"}, "DIGITS_ERROR", "3100000011", None),
    ({"failed": True}, "ERROR", None, None),
    ({"meter": False}, "NO_METER", None, None),
    ({"serial": None}, "NO_SERIAL", None, None),
    ({"serial_conf": 0.29}, "SERIAL_LOW_CONF", None, None),
    ({"serial": "8888"}, "SERIAL_NOT_FOUND", None, None),
    ({"serial": "981"}, "SERIAL_AMBIGUOUS", None, None),
    ({"serial": "6604", "reading": 4100}, "SUSPICIOUS", "3100000014", None),  # has a reading that the log knows nothing of
    ({"serial": "5528", "reading": 5100}, "REPEAT", "3100000016", None),
    ({"name": "old.jpg"}, "REPEAT", "3100000016", None),
    ({"name": "again.jpg"}, "PLUS", "3100000011", 1100),  # a failure of the models closes no photo
    ({"name": "x", "photo_hash": "h1"}, "REPEAT", "3100000012", None),
    ({"name": "x", "photo_hash": "h1", "reread": True}, "PLUS", "3100000011", 1100),
    ({"serial": "981", "marker": "3100000013", "marker_conf": 0.6, "reading": 3001}, "PLUS", "3100000013", 3001),
    ({"serial": "981", "marker": "3100000011", "marker_conf": 0.6}, "SERIAL_AMBIGUOUS", None, None),
    ({"serial": None, "marker": "3100000015", "marker_conf": 0.6, "reading": 5}, "PLUS", "3100000015", 5),
    ({"serial": None, "marker": "3100000015", "marker_conf": 0.4}, "NO_SERIAL", None, None),
    ({"serial": "8888", "marker": "3100000015", "marker_conf": 0.6}, "SERIAL_NOT_FOUND", None, None),
    ({"serial": "7716", "marker": "3100000015", "marker_conf": 0.6, "reading": 5}, "PLUS", "3100000015", 5),  # one character from its serial
    ({"serial": "7716", "serial_conf": 0.1, "marker": "3100000015", "marker_conf": 0.6, "reading": 5}, "PLUS", "3100000015", 5),
    ({"serial": "1111", "serial_conf": 0.1, "marker": "3100000015", "marker_conf": 0.6}, "SERIAL_LOW_CONF", None, None),
    ({"marker": "3100000015", "marker_conf": 0.6}, "SUSPICIOUS", None, None),  # marker against serial
    ({"marker": "3100000011", "marker_conf": 0.6}, "PLUS", "3100000011", 1100),
    ({"serial": "8888", "table_serial": "7715", "table_conf": 0.7, "reading": 5}, "PLUS", "3100000015", 5),
    ({"serial": "8888", "table_serial": "981", "table_conf": 0.7}, "SERIAL_AMBIGUOUS", None, None),
    ({"serial": "8888", "table_serial": "7715", "table_conf": 0.4}, "SERIAL_NOT_FOUND", None, None),
    ({"lines": ["пок1200"]}, "PLUS", "3100000011", 1200),  # the note's reading goes before the meter's
    ({"lines": ["пок1200"], "reading": None}, "PLUS", "3100000011", 1200),
    ({"lines": ["лс3100000015"]}, "SUSPICIOUS", None, None),  # the note names another account
    ({"meter": False, "lines": ["пок1200"]}, "PLUS", "3100000011", 1200),
    ({"meter": False, "lines": ["слово"]}, "NO_METER", None, None),
    ({"serial": None, "lines": ["лс3100000012", "пок2100"], "reading": 2100}, "PLUS", "3100000012", 2100),
    ({"serial": None, "lines": ["слово"]}, "NO_SERIAL", None, None),
]


@pytest.mark.parametrize("notes", [False, True])
def test_each_step(spark, notes):
    """Every case by itself: each has a copy of the register and the log of its own, all in one plan."""
    cases = [c for c in CASES if notes == ("lines" in c[0])]
    mine = lambda k, x: f"{x}{k:02d}" if x else x
    photos, register, log = [], [], []
    for k, (own, *_) in enumerate(cases):
        p = photo(k, **own)
        own_lines = p["lines"] and [re.sub("31000000[0-9]{2}", lambda m, k=k: mine(k, m.group()), t) for t in p["lines"]]
        photos.append(p | {"name": mine(k, p["name"]), "photo_hash": mine(k, p["photo_hash"]), "serial": mine(k, p["serial"]), "table_serial": mine(k, p["table_serial"]), "marker": mine(k, p["marker"]), "lines": own_lines})
        register += [(mine(k, a), mine(k, s), last, filled, k * 10 + order) for a, s, last, filled, order in REGISTER]
        log += [(k * 10 + seq, mine(k, a), mine(k, s), o, mine(k, n), mine(k, h), source, note) for seq, a, s, o, n, h, source, note in LOG]
    got = run(spark, *photos, notes=notes, register=register, log=log)
    for k, (own, outcome, account, reading) in enumerate(cases):
        assert (got[k]["outcome"], got[k]["account"], got[k]["reading"]) == (outcome, mine(k, account), reading), own


def test_state_within_a_run(spark):
    got = run(spark, photo(1, reading=None), photo(2), photo(3, reading=1200), photo(4, reading=None), photo(5, photo_hash="a", serial=None), photo(6, photo_hash="a", serial="7715"), photo(7, photo_hash="a", serial="7715", reread=True, reading=7), notes=False)
    assert [got[k]["outcome"] for k in range(1, 8)] == ["DIGITS_ERROR", "PLUS", "REPEAT", "REPEAT", "NO_SERIAL", "REPEAT", "PLUS"]
    assert got[6]["detail"] == "copy"


def test_empty_run(spark):
    assert decisions.decided(spark.createDataFrame([], PHOTO), spark.createDataFrame([], "account string, serial string, last long, filled boolean, row_order long"), spark.createDataFrame([], "seq long, account string, serial string, outcome string, name string, photo_hash string, source string, notes string")).count() == 0


COLUMNS = [c.split()[0] for c in PHOTO.split(", ")]
LOG_SCHEMA = "seq long, account string, serial string, outcome string, name string, photo_hash string, source string, notes string"
REGISTER_SCHEMA = "account string, serial string, last long, filled boolean, row_order long"


class Month:
    """A month whose photos come day by day into a folder."""

    def __init__(self, spark, at, register=REGISTER, log=LOG):
        self.spark, self.at, self.days = spark, at, 0
        self.register, self.log = spark.createDataFrame(register, REGISTER_SCHEMA), spark.createDataFrame(log, LOG_SCHEMA)

    def day(self, *photos, **kw):
        frame = self.spark.createDataFrame([tuple(p[c] for c in COLUMNS) for p in photos], PHOTO)
        frame.coalesce(1).write.parquet(str(self.at / "in" / f"day={self.days}"))
        self.days += 1
        return self.run(frame.schema, **kw)

    def run(self, schema=None, register=None, **kw):
        schema = schema or self.spark.createDataFrame([], PHOTO).schema
        cycle.run_month(self.spark, str(self.at / "in"), schema, register or self.register, self.log, str(self.at / "out"), decisions.Limits(delta=500.0), **kw)
        return self

    def rows(self):
        return cycle.month_rows(self.spark, str(self.at / "out")).orderBy("seq").collect()

    def outcomes(self, name):
        return [r["outcome"] for r in self.rows() if r["name"] == name]

    def states(self):
        return sorted(map(tuple, month.final_states(cycle.month_rows(self.spark, str(self.at / "out"))).collect()), key=repr)


def test_copies_and_failures_over_batches(spark, tmp_path):
    """However the photos are cut into days they end alike: copies of read, waiting and failed photos, repeats and closings."""
    photos = [
        photo(0, failed=True, photo_hash="e"), photo(1, reading=None, photo_hash="w"), photo(2, serial="7715", photo_hash="c", reading=7), photo(3, serial="7715", photo_hash="c", reading=7),
        photo(4, photo_hash="w"), photo(5, reading=1501), photo(6), photo(7, reading=1300), photo(8, photo_hash="e"), photo(9, serial=None), photo(10, photo_hash="h1"), photo(11, name="n9.jpg"), photo(12, name="again.jpg", serial="8888"),
    ]
    ends = []
    for n, cuts in enumerate([[], [4], [2, 9]]):
        m = Month(spark, tmp_path / str(n))
        for low, high in zip([0, *cuts], [*cuts, len(photos)]):
            m.day(*photos[low:high])
        ends.append(m.states())
        rows = m.rows()
        assert len({r["seq"] for r in rows}) == len(rows) and min(r["seq"] for r in rows) > max(x[0] for x in LOG)
        read = [r["photo"] for r in rows if r["photo"] is not None and r["outcome"] != "ERROR"]
        assert len(read) == len(set(read)), "a photo is read once"
    assert all(e == ends[0] for e in ends)
    assert ends[0] == sorted([("e", "ERROR", None, None), ("w", "REPEAT", "3100000011", None), ("c", "PLUS", "3100000015", 7), ("name:n5.jpg", "REPEAT", "3100000011", None), ("name:n6.jpg", "PLUS", "3100000011", 1100), ("name:n7.jpg", "REPEAT", "3100000011", None), ("name:n9.jpg", "NO_SERIAL", None, None)], key=repr)


def test_rows_that_share_numbers_with_the_log(spark, tmp_path):
    """Numbers of the run never meet those of the log, and a copy of a photo of an earlier day has no row."""
    m = Month(spark, tmp_path)
    m.day(photo(1), photo(3, serial="7715", reading=5, photo_hash="x")).day(photo(2), photo(4, serial="7715", reading=5, photo_hash="x"))
    assert [(r["photo"], r["outcome"], r["account"]) for r in m.rows()] == [(1, "PLUS", "3100000011"), (3, "PLUS", "3100000015"), (2, "REPEAT", "3100000011")]


def test_late_reading_closes_waiting_photos(spark, tmp_path):
    waiting = [(7, "3100000011", "457", "DIGITS_ERROR", "before.jpg", "b", "auto", ""), (8, "3100000011", "457", "REPEAT", "copy.jpg", "b", "auto", "copy of before.jpg"), (9, "3100000012", "981", "SUSPICIOUS", "other.jpg", "", "auto", "")]
    m = Month(spark, tmp_path, log=[*LOG, *waiting]).day(photo(1, reading=None), photo(2, serial="7715", reading=None)).day(photo(3))
    assert m.outcomes("n1.jpg") == ["DIGITS_ERROR", "REPEAT"] and m.outcomes("before.jpg") == ["REPEAT"]
    assert m.outcomes("n2.jpg") == ["DIGITS_ERROR"] and m.outcomes("other.jpg") == []
    closed = {r["name"]: r for r in m.rows() if r["closes"] is not None}
    assert closed["before.jpg"]["closes"] == 7 and closed["before.jpg"]["notes"] == "closed: the account has a reading (photo 3)"
    assert len(m.run().rows()) == 5, "a further run reads and closes nothing"


def test_photo_read_again_for_another_account_is_not_closed(spark, tmp_path):
    m = Month(spark, tmp_path, log=[*LOG, (5, "3100000011", "457", "DIGITS_ERROR", "y.jpg", "y", "auto", ""), (6, "3100000015", "7715", "DIGITS_ERROR", "y.jpg", "y", "auto", "")])
    assert m.day(photo(1)).outcomes("y.jpg") == []


def test_photos_are_read_again(spark, tmp_path):
    """A serial that the register gets later, an operator's NOT_IN_DB, an error of the program, and all waiting photos on demand."""
    log = [*LOG, (5, "", "8888", "NOT_IN_DB", "absent.jpg", "a", "manual", ""), (6, "", "", "ERROR", "broken.jpg", "r", "auto", ""), (7, "", "", "UNREADABLE", "dark.jpg", "d", "manual", "")]
    m = Month(spark, tmp_path, log=log)
    late = spark.createDataFrame([*REGISTER, ("3100000017", "8888", 10, False, 7)], REGISTER_SCHEMA)
    m.day(photo(1, serial="8888", reading=20), photo(2, serial="8888", reading=21, name="absent.jpg", photo_hash="a"), photo(3, name="broken.jpg", photo_hash="r"), photo(4, name="dark.jpg", photo_hash="d"), photo(5, serial="7715", reading=None))
    assert m.outcomes("n1.jpg") == ["SERIAL_NOT_FOUND"] and m.outcomes("broken.jpg") == ["PLUS"]
    assert m.outcomes("absent.jpg") == [] and m.outcomes("dark.jpg") == []
    m.day(photo(6, serial=None), register=late)
    assert m.outcomes("n1.jpg") == ["SERIAL_NOT_FOUND", "PLUS"] and m.outcomes("n5.jpg") == ["DIGITS_ERROR"]
    m.day(photo(7, serial=None), register=late, reread=True)
    assert m.outcomes("n5.jpg") == ["DIGITS_ERROR"] * 2 and m.outcomes("n6.jpg") == ["NO_SERIAL"] * 2 and m.outcomes("n1.jpg")[-1] == "PLUS"


def test_one_content_in_most_photos(spark):
    """Copies are left out before anything is joined; rows without hash are photos of their own names."""
    photos = spark.createDataFrame([tuple(photo(k, photo_hash="same" if k % 3 else "")[c] for c in COLUMNS) for k in range(60)], PHOTO)
    read = month.chosen(photos, spark.createDataFrame([], LOG_SCHEMA), spark.createDataFrame(REGISTER, REGISTER_SCHEMA))
    assert sorted(r["photo"] for r in read.collect()) == [0, 1, *range(3, 60, 3)]
    assert month.chosen(photos.limit(0), spark.createDataFrame(LOG, LOG_SCHEMA), spark.createDataFrame(REGISTER, REGISTER_SCHEMA)).count() == 0


def test_rows_of_a_run_come_after_a_long_log(spark):
    """A photo that is read again after an ERROR far down the log waits, and the reading of its account closes it."""
    photos = [photo(1, reading=None, digit_error="gap"), photo(2)]
    rows = spark.createDataFrame([tuple(p[c.split()[0]] for c in PHOTO.split(", ")) for p in photos], PHOTO)
    register = spark.createDataFrame(REGISTER, "account string, serial string, last long, filled boolean, row_order long")
    log = spark.createDataFrame([(1000, "", "", "ERROR", "n1.jpg", "", "auto", "")], "seq long, account string, serial string, outcome string, name string, photo_hash string, source string, notes string")
    got = month.run_rows(rows, register, log, decisions.Limits(delta=500.0)).collect()
    assert min(r["seq"] for r in got) > 1000
    assert sorted((r["name"], r["outcome"]) for r in got) == [("n1.jpg", "DIGITS_ERROR"), ("n1.jpg", "REPEAT"), ("n2.jpg", "PLUS")]
