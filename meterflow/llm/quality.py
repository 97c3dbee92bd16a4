"""Quality classifier (operator 1): Bradley-Terry ranking learned from preference pairs, thresholded at a score quantile.

A pair says that one labelled text is preferred to another. The strength of a text is linear in features of its
characters, words and lines, and the chance that it wins a pair is the logistic function of the difference of the two
strengths; the weights are fitted by Newton steps on the feature differences. The quantile at the share of label 0 among
the strengths of all labelled rows that may be learned from becomes the threshold, and strengths are mapped so that it
has the score 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Words, blank_table, checkpointed, gram_hashes, slices, word_hashes
from .toxicity import training_rows

#: per class, the most labelled rows and bytes that are fitted; pairs for each row of the smaller class; score at the threshold.
PER_CLASS, CLASS_BYTES, PAIRS, AT_THRESHOLD = 4000, 32 << 20, 12, 0.3
#: Ranges that strengths are counted in to find a quantile, and values that are then sorted at once.
RANGES, SORTED = 2048, 20_000
_BLANK = blank_table()
_NEWLINE = blank_table(b"\n")


def _kinds() -> np.ndarray:
    """For each byte: 0 lower case, 1 upper case, 2 digit, 3 beyond ASCII, 4 blank, 5 . , ; : ' - ( ) and quotes, 6 ! and ?, 7 other signs."""
    k = np.full(256, 7, np.int64)
    for kind, chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (4, b" \t\n\x0b\x0c\r"), (5, b".,;:'\"-()"), (6, b"!?")):
        k[list(chars)] = kind
    k[128:] = 3
    return k


_KINDS = _kinds()


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text, all finite; null and empty texts give zeros and ones alike."""
    texts, n = Texts(column), len(column)
    size = np.diff(texts.offsets)
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * 8 + _KINDS[texts.data], minlength=8 * n).reshape(n, 8)
    words, lines = Words(texts, _BLANK), Words(texts, _NEWLINE)
    h, hl = word_hashes(texts.data, words), word_hashes(texts.data, lines)
    doc = words.documents()
    count, n_lines = words.counts(), lines.counts()
    length = (words.ends - words.starts).astype(float)
    total = lambda x: np.bincount(doc, x, minlength=n)
    share = lambda x, y: (x + 0.0) / np.maximum(y, 1)
    grams, at = gram_hashes(h, words, 2)
    capital = (_KINDS[texts.data[words.starts]] == 1) & (_KINDS[texts.data[words.ends - 1]] != 0) if len(h) else np.zeros(0, bool)
    signs = _KINDS[texts.data[words.ends - 1]] >= 6 if len(h) else np.zeros(0, bool)
    mean = share(total(length), count)
    columns = [
        *(share(kinds[:, k], size) for k in (1, 2, 3, 5, 6, 7)),
        share(kinds[:, 4], size),
        np.sqrt(share(kinds[:, 7], size)),
        np.sqrt(share(kinds[:, 6], size)),
        np.sqrt(share(kinds[:, 1], size)),
        np.log1p(count),
        np.log1p(n_lines),
        np.minimum(mean, 60),
        np.sqrt(np.maximum(share(total(length * length), count) - mean**2, 0)).clip(0, 60),
        share(total(length <= 3), count),
        share(total(capital), count),
        share(total(signs), count),
        1 - share(_distinct(h, doc, n), count),
        1 - share(_distinct(grams, doc[at], n), np.bincount(doc[at], minlength=n)),
        1 - share(_distinct(hl, lines.documents(), n), n_lines),
        np.log1p(share(size, n_lines)),
        (count < 20).astype(float),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Ranking:
    """Strengths from features; with a threshold, scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def strengths(self, column: pa.Array) -> np.ndarray:
        return ((features(column) - self.mean) / self.scale).clip(-6, 6) @ self.weights


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights that maximise the chance that each row of better beats the same row of worse."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(d @ w).clip(-30, 30)))
        gradient = d.T @ (1 - p) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rank(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Ranking:
    """The ranking learned from pairs of a row of label 1, the preferred one, and a row of label 0."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = ((x - mean) / scale).clip(-6, 6)
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(x.shape[1]))
    rng, n = np.random.default_rng(seed), PAIRS * min(len(good), len(bad))
    return Ranking(mean, scale, bradley_terry(good[rng.integers(len(good), size=n)], bad[rng.integers(len(bad), size=n)]))


def fit_ranking(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Ranking:
    """The weights, without threshold, from at most per_class labelled rows of each class; all zero with one class or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = training_rows(docs, labels, label, per_class, class_bytes).select("doc_id", "text", "label")
    rows = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")  # at most 2 * per_class rows of numbers
    x = np.stack(list(rows["x"])) if len(rows) else np.zeros((1, features(pa.array([""])).shape[1]))
    return rank(x, rows["label"].to_numpy() if len(rows) else np.zeros(1))


def strengths(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, strength) for each row; null and empty texts are judged by their features like others, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.strengths(batch.column(1)))], ["doc_id", "strength"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, strength double")


def smallest(values: DataFrame, k: int) -> float:
    """The k-th smallest (from 1) of a DataFrame's one double column, exactly: the range that holds it is counted in ever finer ranges."""
    values = values.toDF("v")
    while True:
        low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if low == high:
            return low
        if n <= SORTED:
            return sorted(r["v"] for r in values.collect())[k - 1]
        edges = np.linspace(low, high, RANGES + 1)
        place = F.least(F.floor((F.col("v") - low) / (high - low) * RANGES), F.lit(RANGES - 1)).cast("int")
        counts = {r["p"]: r["n"] for r in values.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for p in sorted(counts):
            if k <= counts[p]:
                break
            k -= counts[p]
        if len(counts) == 1 or edges[1] == edges[0]:
            return low
        values = values.where(place == p)


def at_threshold(ranking: Ranking, known: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """The ranking with its threshold: halfway between the two strengths that part the share of label 0 from the rest.

    known (doc_id, strength) of documents; all rows with a training label count, an id with two labels with neither.
    """
    training = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    training = training.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    met = checkpointed(known.join(training, "doc_id").select("strength", "label"))
    n, bad = met.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    if not 0 < bad < n:
        return ranking
    low, high = (smallest(met.select("strength"), k) for k in (bad, bad + 1))
    return replace(ranking, threshold=float((low + high) / 2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Ranking:
    """fit_ranking() and at_threshold(); with one class or none, every score is 0.3."""
    ranking = fit_ranking(docs, labels, label, per_class)
    return at_threshold(ranking, strengths(docs, ranking), labels, label)


def score(known: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score) of rows (doc_id, strength)."""
    away = F.least(F.greatest(F.col("strength") - ranking.threshold + float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))), F.lit(-500.0)), F.lit(500.0))
    return known.select("doc_id", (1 / (1 + F.exp(-away))).alias("score"))
