"""Quality (1), secrets (4) and toxicity (10): held-out accuracy, brute-force pieces, defined results for odd rows."""

from __future__ import annotations

import os
import random
import re
from pathlib import Path

import edge
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterflow.llm import common, quality, queries, secrets, toxicity

LABELS = "doc_id long, quality int, toxic int"


LARGER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).parent / "sf0.01"  # labels enough to hold some out


@pytest.mark.parametrize("query, label, least", [("op1_quality", "quality", 0.8), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = str(LARGER)
    out = queries.queries()[query](spark, sf)
    assert out.count() == common.table(spark, sf, "documents").count()
    met = out.join(common.table(spark, sf, "labels"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).toPandas()
    positive, negative = met.loc[met[label] == 1, "score"].to_numpy(), met.loc[met[label] == 0, "score"].to_numpy()
    auc = (positive[:, None] > negative[None, :]).mean() + (positive[:, None] == negative[None, :]).mean() / 2
    assert auc >= least
    assert met["score"].between(0, 1).all() and set(met["predicted"]) <= {0, 1}


def scored(module, docs, labels):
    model = module.fit(docs, labels)
    return module.score(quality.strengths(docs, model) if module is quality else docs, model)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    docs = edge.frame(spark)
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (6, 0, 0), (6, 1, 0)], LABELS)
    scores = scored(module, docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    same = [r["score"] for r in scores if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]  # null is the empty text
    assert scored(module, edge.empty(spark), labels.limit(0)).count() == 0


def test_one_class_or_none(spark):
    docs, none = edge.frame(spark), spark.createDataFrame([], LABELS)
    for module, value in ((toxicity, 0.5), (quality, quality.AT_THRESHOLD)):
        assert {round(r["score"], 9) for r in scored(module, docs, none).collect()} == {value}


def test_a_repeated_id_is_one_training_row(spark):
    copies = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    docs = copies.unionAll(spark.createDataFrame([(2, "b" * 50), (3, "c" * 50), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1, 1) for k in (1, 2, 3, 4, 4)] + [(3, 0, 1)], LABELS)
    rows = lambda *bounds: toxicity.training_rows(docs, labels, "quality", *bounds, held_out=False).collect()
    texts = {r["doc_id"]: r["text"] for r in rows(10, 1 << 20)}
    assert len(rows(10, 1 << 20)) == 3 and set(texts) == {1, 2, 4} and texts[4] == ""
    assert texts[1] == spark.range(700).select(F.concat(F.lit("text "), "id").alias("t")).orderBy(F.xxhash64("t")).first()["t"]
    assert len(rows(1, 1 << 20)) == 1 and len(rows(10, 1)) < 3


def test_threshold_is_a_quantile_of_all_labelled_strengths(spark, monkeypatch):
    rng = np.random.default_rng(2)
    s = np.round(rng.normal(size=3000), 2)
    known = spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "doc_id long, strength double")
    labels = spark.createDataFrame([(k, int(rng.random() < 0.7), 0) for k in range(0, 3000, 2)], LABELS)
    monkeypatch.setattr(quality, "SORTED", 50)
    flat = quality.Ranking(np.zeros(1), np.ones(1), np.zeros(1))
    own = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).toPandas()
    mine, bad = np.sort(s[own["doc_id"]]), int((own["quality"] == 0).sum())
    assert quality.at_threshold(flat, known, labels).threshold == (mine[bad - 1] + mine[bad]) / 2
    assert [quality.smallest(known.select("strength"), k) for k in (1, 1500, 3000)] == np.sort(s)[[0, 1499, 2999]].tolist()


def test_toxic_scores_are_those_of_the_weights():
    """A text's score is the logistic function of the bias and the weights of its distinct words and skip-grams, each found alone."""
    texts = ["You are awful, you ARE", "", None, "a b c d e a b", "don't  x"]
    slot = lambda t: set(toxicity.distinct_features(pa.array([t], pa.string()), 20)[0].tolist())
    single = {w: slot(w) for t in texts for w in re.findall(r"[a-z0-9']+", (t or "").lower())}
    assert all(len(s) == 1 for s in single.values())
    rng = np.random.default_rng(1)
    at = np.unique(np.concatenate([sorted(slot(t)) or [0] for t in texts]))
    model = toxicity.LinearModel(at, rng.normal(size=len(at)), 0.3, 20)
    weight = dict(zip(at.tolist(), model.weights.tolist()))
    for t, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        words = re.findall(r"[a-z0-9']+", (t or "").lower())
        own = set().union(*(single[w] for w in words)) if words else set()
        for gap in (1, 2, 3):
            for i in range(len(words) - gap):
                own |= slot(" ".join(words[i : i + gap + 1])) - slot(" ".join(words[i : i + gap])) - slot(" ".join(words[i + 1 : i + gap + 1]))
        assert np.isclose(got, 1 / (1 + np.exp(-0.3 - sum(weight[s] for s in own))))


def test_drop_toxic_keeps_all_columns(spark):
    docs = edge.frame(spark)
    model = toxicity.LinearModel(np.zeros(0, np.int64), np.zeros(0), -1.0, 20)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.drop_toxic(docs, toxicity.LinearModel(np.zeros(0, np.int64), np.zeros(0), 1.0, 20)).count() == 0


def test_pair_fit_finds_the_better_side():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(1, 1, (400, 2)) * [1, 0.1], rng.normal(0, 1, (400, 2)) * [1, 0.1]
    w = quality.bradley_terry(better, worse)
    assert w[0] > 0.3
    p = 1 / (1 + np.exp(-(better - worse) @ w))
    assert np.allclose((better - worse).T @ (1 - p), w, atol=1e-5)  # the gradient of the penalised likelihood vanishes


def test_ftrl_separates_and_is_sparse():
    rows = [np.array([1, 5]), np.array([2, 5])] * 60
    labels, p = np.array([1, 0] * 60), toxicity.FtrlParams(bits=4, l1=(1.0, 500.0))
    weights, bias = toxicity.ftrl(rows, labels, 16, p, 1.0)
    at, some, cut = toxicity.learned(rows, labels, p)
    for table, b in ((weights, bias), (np.bincount(at, some, 16), cut)):
        assert table[1] > 0 > table[2] and set(np.flatnonzero(table)) <= {1, 2, 5}
        assert [table[r].sum() + b > 0 for r in rows] == [True, False] * 60
    assert not toxicity.ftrl(rows, labels, 16, p, 500.0)[0].any()


def test_left_out_slots_would_have_no_weight():
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 400, rng.integers(0, 12))) for _ in range(150)]
    labels, p = (rng.random(150) < 0.4) * 1.0, toxicity.FtrlParams(bits=9, l1=(8.0,), epochs=3)
    weights, bias = toxicity.ftrl(rows, labels, 512, p, 8.0)
    at, some, _ = toxicity.learned(rows, labels, p)
    assert np.allclose(np.bincount(at, some, 512), weights)
    assert len(toxicity.learned([], np.zeros(0), p)[0]) == 0


def test_best_cut():
    scores, labels = np.array([3.0, 2.0, 1.0, 0.0, 0.0]), np.array([1, 1, 0, 0, 1])
    assert toxicity.best_cut(scores, labels) == 1.5
    assert toxicity.best_cut(np.zeros(4), np.array([1, 0, 0, 0])) > 0 and toxicity.best_cut(scores, np.ones(5)) == 0.0


def test_skip_grams_are_counted_once_per_text():
    got = toxicity.distinct_features(pa.array(["a b c a b", "", None, "A, b!"]), 20)
    assert [len(set(x)) == len(x) for x in got] == [True] * 4 and len(got[1]) == len(got[2]) == 0
    assert set(got[3]) <= set(got[0])  # case and signs do not count


SECRET = "password = 'aK9xQ2mZ7pLw4TnB8vRc'"
HARMLESS = ["commit 0123456789abcdef0123456789abcdef01234567", "see https://example.org/path/to/page1", "order 4901 of 192.168.134.201 by 2021-03-14T12:33:10Z", "password = your_password_here"]


def plain_spans(text):
    """Runs by looking at every character, and values after credential words by hand."""
    runs, start = [], None
    for n, c in enumerate(text + " "):
        if c.isascii() and (c.isalnum() or c in "_-/+=.:@~"):
            start = n if start is None else start
        elif start is not None:
            if n - start >= 12 and any(x.isdigit() for x in text[start:n]):
                runs.append((start, n))
            start = None
    return runs


def test_candidates_against_brute_force(spark, sf_dir):
    for (t,) in common.table(spark, sf_dir, "documents").select("text").where("text is not null").collect():
        found = secrets.spans(t)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for low, high in plain_spans(t):
            assert any(a < high and low < b for a, b in found)


@pytest.mark.parametrize("text, value", [
    ("password = 'aK9x Q2mZ' y", "aK9x Q2mZ"), ("pwd=hunter2.", "hunter2"), ("the secret is correcthorsebattery, they said", "correcthorsebattery"), ('"api_key": "a!b$c#d%"', "a!b$c#d%"),
    ("Authorization: Bearer abc", "abc"), ("password=a_token=xyz", "xyz"), ("x aK9xQ2mZ7pLw4TnB8vRc y", "aK9xQ2mZ7pLw4TnB8vRc"), ("token" + "x" * 60 + " 1", "1"), ("aws_secret_" + "x" * 30 + ' = "abcDEFghi"', "abcDEFghi"), ("password     = x7", "x7"), ("token: \"" + "k3 " * 100 + '" y', "k3 " * 100), ("api_key\t\t\t\t\t\tabc", "abc"), ("pass: w0rd", "w0rd"), ("pass the salt", None), ("DB_PASS='o p'", "o p"), ('token="open\nline', None), ("no candidate here", None), ("", None), ("token=", None),
])
def test_candidates(text, value):
    found = [text[a:b] for a, b in secrets.spans(text)]
    assert found[:1] == ([value] if value else found[:1]) and (value or not found or found[0].startswith("x"))


class Others:
    """Findings drawn apart from those of the training: other names, shapes, places and words."""

    CHARS = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"

    def __init__(self, seed):
        self.r = random.Random(seed)

    def of(self, n, chars=None):
        return "".join(self.r.choice(chars or self.CHARS) for _ in range(n))

    def secret(self):
        kinds = [
            lambda: self.of(44, "0123456789ABCDEF"), lambda: f"AKIA{self.of(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", lambda: f"xoxp-{self.of(12, '0123456789')}-{self.of(24)}", lambda: self.of(10) + "!" + self.of(3) + "#",
            lambda: "-".join(self.r.choice(["copper", "lantern", "violet", "marsh", "engine"]) for _ in range(3)) + str(self.r.randint(10, 99)), lambda: self.r.choice(["Summer", "Winter", "Berlin"]) + str(self.r.randint(1990, 2025)) + "!", lambda: "eyJ" + self.of(20) + "." + self.of(40) + "." + self.of(30), lambda: self.of(32, "0123456789abcdef"),
        ]
        name = self.r.choice("mysql_password REDIS_TOKEN stripeSecret github_token vaultSecret userPwd jwt-secret rootPassword wifi_passphrase SENDGRID_API_KEY serviceToken".split())
        place = self.r.choice(["{} = '{}'", "{}: {}", "set {}={}\n", '{{"{}": "{}"}}', "our {} is {} by now", "{} => {}", "<{}>{}", "--{} {}"])
        return name, place, self.r.choice(kinds)()

    def harmless(self):
        kinds = [
            lambda: ("commit", self.of(40, "0123456789abcdef")), lambda: ("md5", self.of(32, "0123456789abcdef")), lambda: ("Order number", self.of(13, "0123456789")), lambda: ("download", f"https://cdn.example.org/{self.of(6)}/{self.r.randint(100, 999)}.zip"), lambda: ("contact", f"{self.of(7).lower()}{self.r.randint(1, 99)}@post.example.net"),
            lambda: ("password", self.r.choice(["is required", "must be reset", "cannot be empty"])), lambda: ("token", self.r.choice(["expired", "<your-token-here>", "${API_TOKEN}"])), lambda: ("at", f"2023-{self.r.randint(10, 12)}-{self.r.randint(10, 28)}T10:{self.r.randint(10, 59)}:00Z"), lambda: ("host", "10.{}.{}.{}".format(*(self.r.randint(100, 250) for _ in range(3)))), lambda: ("in", f"/usr/share/{self.of(5).lower()}/module{self.r.randint(1, 99)}/index.html"),
        ]
        name, value = self.r.choice(kinds)()
        return name, self.r.choice(["{} {}", "{}: {}", "the {} {}"]), value


def test_findings_of_another_kind(spark):
    """Recall and precision on findings that the training's generator did not draw, candidates included."""
    draw, texts, marks = Others(11), [], []
    base = [r["text"] for r in common.table(spark, str(LARGER), "documents").where("length(text) between 200 and 3000").select("text").limit(600).collect()]
    for k in range(600):
        label = k % 2
        name, place, value = draw.secret() if label else draw.harmless()
        words = base[k % len(base)].split(" ")
        cut = draw.r.randint(0, len(words))
        head = " ".join(words[:cut]) + " "
        shown = place.format(name, value)
        texts.append((1_000_000 + k, head + shown + " " + " ".join(words[cut:])))
        marks.append((1_000_000 + k, len(head) + shown.index(value, len(name) if value != name else 0), len(value), label))
    docs = common.table(spark, str(LARGER), "documents").select("doc_id", "text").unionAll(spark.createDataFrame(texts, "doc_id long, text string"))
    found = {}
    for r in secrets.scan(docs).where("doc_id >= 1000000").collect():
        found.setdefault(r["doc_id"], []).append(r)
    met = lambda r, at, n: max(0, min(r["start"] + r["length"], at + n) - max(r["start"], at)) > 0.6 * max(n, r["length"])
    covered = sum(any(met(r, at, n) for r in found.get(d, ())) for d, at, n, label in marks if label)
    caught = sum(any(met(r, at, n) and r["is_secret"] for r in found.get(d, ())) for d, at, n, label in marks if label)
    wrong = sum(any(met(r, at, n) and r["is_secret"] for r in found.get(d, ())) for d, at, n, label in marks if not label)
    assert covered >= 0.97 * 300, covered
    assert caught >= 0.9 * 300 and caught / (caught + wrong) >= 0.9, (caught, wrong)


def test_names_by_the_expression_alone(spark, sf_dir):
    """The automaton finds the places where the expression matches, also in texts whose lower case is longer."""
    texts = [r[0] for r in common.table(spark, sf_dir, "documents").select("text").where("text is not null").collect()]
    draw = random.Random(2)
    parts = "api_key apiKey Pass pass: key= PASSWORD my-token authKey pin=1 access-key Authorization: bearer tokens \u212aey \u017fecret monkey compass".split()
    texts += [draw.choice(["", "\u0130 "]) + draw.choice([" ", "_", ""]).join(draw.choice(parts) for _ in range(8)) for _ in range(300)]
    for t in texts:
        found, at = [], 0
        while m := secrets.CREDENTIAL.search(t, at):
            found.append(m.span())
            at = m.start() + 1
        assert [m.span() for m in secrets._names(t)] == found


def test_long_runs_of_names_end_soon():
    for text in ("token=" * 100_000, "token" * 100_000, "password " * 50_000, "secret='" * 50_000, "key\"" * 50_000, "pass" + " " * 200_000 + "x", "key" * 100_000, "pin_" * 100_000):
        secrets.spans(text)


def test_features_are_finite():
    words = secrets._automaton(["horse", "battery", "corr"])
    for value in ("a", "correcthorsebattery", "漢字", "1" * 5000):
        x = secrets.features(value, "", "", words)
        assert len(x) == secrets.FEATURES and all(np.isfinite(x))
    assert secrets.covered("correcthorsebattery", words) == 16 / 19 and secrets.covered("x", secrets._automaton([])) == 0


def test_dictionary_counts_whole_texts(spark):
    docs = edge.frame(spark, ["horse horse Battery", None, "", "battery HORSE cat x", "naïveté"])
    assert secrets.dictionary(docs)[:2] == ["horse", "battery"] and "naïveté" in secrets.dictionary(docs) and "cat" not in secrets.dictionary(docs)
    assert secrets.dictionary(docs, 1) == ["horse"] and secrets.dictionary(docs, 0) == [] and secrets.dictionary(edge.empty(spark)) == []


def test_forest_beats_each_rule_on_held_out_findings(spark):
    """Planted findings of documents that the forest has not seen: precision and recall, against the best single feature."""
    docs = common.table(spark, str(LARGER), "documents")
    words = spark.sparkContext.broadcast(secrets.dictionary(docs))
    known = common.checkpointed(secrets.planted(docs, words))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = secrets.sampled(known.where(~held))
    out = secrets.judged(known.where(held), secrets.fit(rows), secrets.threshold_of(rows)).join(known.where(held), ["doc_id", "start"]).toPandas()
    assert len(out) > 500 and 0.3 < out["label"].mean() < 0.7
    f1 = lambda said, true: 2 * (said & true).sum() / max(1, said.sum() + true.sum())
    true, said = out["label"].to_numpy() == 1, out["is_secret"].to_numpy()
    precision, recall = (said & true).sum() / said.sum(), (said & true).sum() / true.sum()
    assert precision >= 0.85 and recall >= 0.9, (precision, recall)
    x = np.stack(list(out["features"]))
    rules = max(f1(side * x[:, k] >= side * cut, true) for k in range(x.shape[1]) for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 21))) for side in (1, -1))
    assert f1(said, true) > rules + 0.05


def test_scan(spark):
    filler = [f"some words of document {k} which say little\nand a line more" for k in range(150)]
    docs = edge.frame(spark, [SECRET, None, "", *HARMLESS, edge.LONG, SECRET, *filler])
    out = secrets.scan(docs)
    chance = {}
    for r in out.collect():
        chance.setdefault(r["doc_id"], []).append(r["probability"])
    assert min(chance[0] + chance[8]) >= 0.5 and set(chance) == {0, 3, 4, 5, 6, 8}
    assert max(p for k in (3, 4, 5, 6) for p in chance[k]) < min(chance[0] + chance[8])
    assert out.where("doc_id = 0").count() == 2  # the repeated row has its own findings
    assert secrets.scan(edge.empty(spark)).count() == 0


def test_scan_learns_from_labelled_findings(spark):
    docs = edge.frame(spark, [f"token {k}aZ{k * 7919}Qw{k}x9Kp{k}" for k in range(40)] + [f"order {k}-{k}-2024-{k * 31:08d}" for k in range(40)])
    found = secrets.candidates(docs, spark.sparkContext.broadcast([]))
    labelled = found.select("doc_id", "start", (F.col("doc_id") < 40).cast("int").alias("label")).where("doc_id % 2 = 0")
    out = secrets.scan(docs, labelled).where("doc_id % 2 = 1").toPandas()
    assert ((out["probability"] >= 0.5) == (out["doc_id"] < 40)).mean() > 0.95
    none = secrets.scan(docs, labelled.where("label = 1"))
    assert {r["probability"] for r in none.collect()} == {0.5}


def plain_features(text):
    """The 22 numbers of a text by plain loops over its bytes, words and lines."""
    data = (text or "").encode()
    kind = lambda b: "l" if 97 <= b <= 122 else "u" if 65 <= b <= 90 else "d" if 48 <= b <= 57 else "x" if b > 127 else "b" if b in b" \t\n\x0b\x0c\r" else "p" if b in b".,;:'\"-()" else "!" if b in b"!?" else "o"
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", data)
    lines = [x for x in data.split(b"\n") if x]
    share = lambda a, b: a / max(b, 1)
    of = {k: share(sum(kind(b) == k for b in data), len(data)) for k in "udxbp!o"}
    sizes = [len(w) for w in words]
    mean = share(sum(sizes), len(words))
    pairs = list(zip(words, words[1:]))
    once = lambda x: 1 - share(len(set(x)), len(x))
    return [
        of["u"], of["d"], of["x"], of["p"], of["!"], of["o"], of["b"], of["o"] ** 0.5, of["!"] ** 0.5, of["u"] ** 0.5, np.log1p(len(words)), np.log1p(len(lines)), min(mean, 60), min(60.0, max(0.0, share(sum(n * n for n in sizes), len(words)) - mean**2) ** 0.5),
        share(sum(n <= 3 for n in sizes), len(words)), share(sum(kind(w[0]) == "u" and kind(w[-1]) != "l" for w in words), len(words)), share(sum(kind(w[-1]) in "!o" for w in words), len(words)), once(words), once(pairs), once(lines), np.log1p(share(len(data), len(lines))), float(len(words) < 20),
    ]


def test_quality_features_by_brute_force(spark, sf_dir):
    texts = [r["text"] for r in common.table(spark, sf_dir, "documents").select("text").limit(300).collect()] + [*edge.TEXTS, "A B A B A b!", "x\n\nx\n", "!? $$ é"]
    got = quality.features(pa.array(texts, pa.string()))
    assert got.shape[1] == 22 and np.allclose(got, [plain_features(t) for t in texts], atol=1e-6)


def test_scores_and_threshold_by_brute_force(spark, sf_dir):
    """Strengths by plain features and the fitted weights, the threshold as the quantile of all training labels' strengths, scores in between."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    ranking = quality.fit_ranking(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    strength = {d: float(((np.array(plain_features(t)) - ranking.mean) / ranking.scale).clip(-6, 6) @ ranking.weights) for d, t in texts.items()}
    known = common.checkpointed(quality.strengths(docs, ranking))
    assert all(abs(r["strength"] - strength[r["doc_id"]]) < 1e-6 for r in known.collect())
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, sf_dir).collect()}
    order = sorted(strength, key=strength.__getitem__)
    scores = [got[d]["score"] for d in order]
    assert all(a <= b + 1e-9 for a, b in zip(scores, scores[1:])) and all(0 <= s <= 1 for s in scores)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_clashing_columns_of_scores(spark):
    """Columns named like those of the scores, the labels or the steps between them change nothing."""
    docs = edge.frame(spark, [f"good text number {k} of some length and words" if k % 2 else f"$$$ {k} !!! ###" for k in range(40)])
    odd = docs.withColumns({"score": F.lit("x"), "label": F.lit(5), "quality": F.lit(0), "strength": F.lit(1), "slots": F.lit("s")})
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)], LABELS)
    for scores in (lambda d: quality.strengths(d, quality.fit_ranking(d, labels)), lambda d: toxicity.score(d, toxicity.fit(d, labels))):
        assert sorted(map(tuple, scores(odd).collect()), key=repr) == sorted(map(tuple, scores(docs).collect()), key=repr)
