"""Every registered query against its SQL on the driver tables, or for its shape where SQL can't express it."""

from __future__ import annotations

import numpy as np
import oracle
import pytest

from meterflow.operators import lexicon
from meterflow.plans import analogs, registry, rules

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't express.
BRUTE = {"f37_suppressed", "j21_lexicon_matches"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert name in BRUTE  # checked against brute force below, or in tests/test_rules.py
        return
    columns, rows = oracle.of_spark(got)
    expected_columns, expected = oracle.of_sql(sf_dir, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_suppressed_boxes_against_brute_force(spark, sf_dir):
    own = {}
    for r in analogs.boxes(spark, sf_dir).collect():
        own.setdefault(r["photo"], []).append((-r["conf"], float(r["x1"]), float(r["x1"] + 40)))
    expected = set()
    for photo, boxes in own.items():
        kept = []
        for c, a, b in sorted(boxes):
            if not any((min(b, y) - max(a, x)) / min(b - a, y - x) >= 0.5 for _, x, y in kept):
                kept.append((c, a, b))
        expected |= {(photo, a, b, -c) for c, a, b in kept}
    got = QUERIES["f37_suppressed"](spark, sf_dir).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == expected


def test_lexicon_matches_against_all_pairs(spark, sf_dir):
    images = {r["image"]: np.array(r["matrix"]) for r in rules._matrices(spark, sf_dir).collect()}
    words = sorted({(str(k), w) for k in images if k % 2 == 0 for w in (f"{k:04d}", f"{k:04d}"[1:])})
    got = {}
    for r in QUERIES["j21_lexicon_matches"](spark, sf_dir).collect():
        got.setdefault(r["image"], []).append((r["place"], r["group"], r["share"]))
    for k, m in images.items():
        ll = lexicon.ctc_scores([m] * len(words), [w for _, w in words], "0123456789", 10)
        groups = {g: np.logaddexp.reduce([x for (h, _), x in zip(words, ll) if h == g]) for g, _ in words}
        best = [s for n, s in enumerate(m.argmax(axis=1)) if s != 10 and (n == 0 or s != m.argmax(axis=1)[n - 1])]
        greedy = "".join(map(str, best))
        terms = list(groups.values()) + ([] if greedy in {w for _, w in words} else [lexicon.ctc_scores([m], [greedy], "0123456789", 10)[0] + np.log(0.05)])
        top = sorted(groups, key=lambda g: (-groups[g], g))[:3]
        assert np.allclose([x[2] for x in sorted(got[k])], [np.exp(groups[g] - np.logaddexp.reduce(terms)) for g in top])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
