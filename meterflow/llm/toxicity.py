"""Toxicity (operator 10): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the distinct hashes of its words, its pairs of neighbours, and its pairs with one or two
words between. A sample of labelled rows, bounded in rows and bytes, is dealt into shards, and FTRL-proximal learns each with a
learning rate for each coordinate and an L1 term that leaves most weights at zero. Folds of the shard's rows, fitted side
by side, choose the L1 term, and the bias is moved to where the scores of rows that their model has not seen part the
labels with the fewest errors; the shards' weights are averaged. The sample's slots that occur more than once, squeezed,
pass the driver to be broadcast for the fits (their bound is the sample's), then the weights that are not zero, which are
broadcast for scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, Words, checkpointed, letter_table, lowered, mixed, slices, word_hashes

SPANS = (0, 1, 2, 3)  # 0: the word; else the pair with the word so many places on
_LETTERS = letter_table()


@dataclass(frozen=True)
class FtrlParams:
    """per_class and class_bytes bound the labelled rows of each class that are fitted; bits sizes the hash space, and so the weights.

    l1: the terms that the folds choose from.
    """

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: tuple[float, ...] = (4.0, 8.0, 16.0)
    l2: float = 0.1
    epochs: int = 4
    folds: int = 3
    shards: int = 1
    per_class: int = 4000
    class_bytes: int = 32 << 20


def features(texts: Texts, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the slot of each occurrence and its document."""
    words = Words(texts, _LETTERS)
    h, doc = word_hashes(lowered(texts), words), words.documents()
    for span in SPANS:
        if span == 0:
            yield (mixed(h) >> np.uint64(64 - bits)).astype(np.int64), doc
        elif len(h) > span:
            inside = doc[:-span] == doc[span:]
            pair = mixed(h[:-span] * np.uint64(2 * span + 1) + (h[span:] >> np.uint64(span)))
            yield (pair >> np.uint64(64 - bits)).astype(np.int64)[inside], doc[:-span][inside]


def distinct_features(batch: pa.Array, bits: int) -> list[np.ndarray]:
    """The sorted distinct slots of each text."""
    found = list(features(Texts(batch), bits))
    both = np.unique(np.concatenate([d << bits | s for s, d in found])) if found else np.zeros(0, np.int64)
    cuts = np.searchsorted(both, np.arange(1, len(batch)) << bits)
    return [x & ((1 << bits) - 1) for x in np.split(both, cuts)]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, p: FtrlParams, l1: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """The weights of `size` slots and the bias; each row is a list of slots of value 1."""
    z, n = np.zeros(size), np.zeros(size)
    bias, order = 0.0, np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - labels[i]
            before = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - before) / p.alpha * w
            bias -= 0.02 * g
    return weights(slice(None)), bias


def compacted(rows: list[np.ndarray], p: FtrlParams) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows with slots numbered from 0, and the slots by these numbers.

    A slot's gradients are below 1, so that one of d rows never leaves zero if d * epochs is no more than the L1 term:
    such slots are left out.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    used = np.bincount(flat, minlength=1 << p.bits) * p.epochs > min(p.l1)
    number, kept = np.cumsum(used, dtype=np.int32) - 1, used[flat]
    ends = np.cumsum(kept)[np.cumsum([len(r) for r in rows], dtype=np.int64) - 1] if len(flat) else np.zeros(len(rows), np.int64)
    ends[np.cumsum([len(r) for r in rows]) == 0] = 0  # rows without slots before all others
    return (np.split(number[flat[kept]], ends[:-1]) if len(rows) else []), np.flatnonzero(used)


def squeezed(numbers: np.ndarray) -> bytes:
    """Ascending numbers in few bytes."""
    return zlib.compress(np.diff(numbers.astype(np.int32), prepend=np.int32(0)).tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32), dtype=np.int32)


def folds_of(n: int, p: FtrlParams, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 7]).permutation(n) % p.folds


def fold_scores(own: list[np.ndarray], labels: np.ndarray, size: int, p: FtrlParams, l1: float, fold: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a fold and their scores by a fit on the others."""
    of = folds_of(len(own), p, seed)
    seen, out = np.flatnonzero(of != fold), np.flatnonzero(of == fold)
    if not len(seen) or not len(out):
        return out, np.zeros(len(out))
    w, bias = ftrl([own[i] for i in seen], labels[seen], size, p, l1, seed)
    return out, np.array([w[own[i]].sum() + bias for i in out])


def chosen_term(unseen: dict[float, np.ndarray], labels: np.ndarray) -> tuple[float, float]:
    """The L1 term with the least log-loss of its unseen scores, and the cut that these call for."""
    loss = {l1: float(np.mean(np.logaddexp(0, np.where(labels == 1, -s, s)))) if len(s) else 0.0 for l1, s in unseen.items()}
    l1 = min(unseen, key=loss.__getitem__)
    return l1, best_cut(unseen[l1], labels)


def learned(rows: list[np.ndarray], labels: np.ndarray, p: FtrlParams, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the bias, of what fit() does over tasks in one place."""
    own, slots = compacted(rows, p)
    unseen = {l1: np.zeros(len(own)) for l1 in p.l1}
    for l1, s in unseen.items():
        for fold in range(p.folds):
            at, values = fold_scores(own, labels, len(slots), p, l1, fold, seed)
            s[at] = values
    l1, cut = chosen_term(unseen, labels)
    w, bias = ftrl(own, labels, len(slots), p, l1, seed)
    at = np.flatnonzero(w)
    return slots[at], w[at], bias - cut


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Halfway between the two neighbouring scores that part the labels with the fewest errors, the highest such; 0 where there is one label.

    Sparse weights leave most texts of label 0 at the bias, which is then far below what separates the labels. Scores
    that separate nothing have their cut above them all.
    """
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s = np.concatenate([[scores[order[0]] + 2], scores[order]])
    errors = np.concatenate([[0], np.cumsum(np.where(labels[order] == 1, -1, 1))])  # of a cut below each score, but for a constant
    ends = np.flatnonzero(s[:-1] > s[1:])
    k = ends[int(np.argmin(errors[ends]))]
    return float(s[k] + s[k + 1]) / 2


@dataclass(frozen=True)
class LinearModel:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    @cached_property
    def used(self) -> np.ndarray:
        """Whether each slot has a weight."""
        t = np.zeros(1 << self.bits, bool)
        t[self.slots] = True
        return t

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text; without features, that of the bias."""
        found = []
        for slot, doc in features(Texts(column), self.bits):
            hit = self.used[slot]  # most features have no weight: only the others are made distinct
            found.append(doc[hit] << self.bits | slot[hit])
        total = np.full(len(column), self.bias)
        if found:
            both = np.unique(np.concatenate(found))
            np.add.at(total, both >> self.bits, self.weights[np.searchsorted(self.slots, both & ((1 << self.bits) - 1))])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int, held_out: bool = True) -> DataFrame:
    """(doc_id, text, label): at most per_class rows of each class, those of the smallest hashes of doc_id, one row for each id.

    Ids that carry both labels are left out, as are null ids and labels; with held_out, so are ids with
    crc32(doc_id as text) mod 5 = 0. Of rows that repeat an id the one whose text has the smallest hash counts. Rows
    are taken while those of the class before them have fewer than class_bytes bytes of text. Ids and labels are ordered
    alone; what meets the texts is a broadcast of at most 2 * per_class rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))).alias("one")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(one).select("doc_id", "label", "one.*")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of per_class rows at most
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0))).where(F.col("before") < class_bytes)
    rows = checkpointed(rows.select(F.col("doc_id").alias("id"), "label", "hash"))
    met = texts.join(F.broadcast(rows), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")))
    return met.select("doc_id", "text", "label").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: FtrlParams | None = None) -> LinearModel:
    """The model from labelled rows; without any, all scores are 0.5. Labels, lang, source and doc_id are no features."""
    p = params or FtrlParams()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = distinct_features(batch.column(0), p.bits)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32())), *batch.columns[1:]], ["slots", "doc_id", "label", "shard"])

    def compact(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")  # shuffled rows come in any order
        own, slots = compacted(list(rows["slots"]), p)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "place": range(-1, len(own)), "label": [0, *rows["label"]], "slots": [squeezed(x) for x in (slots, *own)]})

    sample = training_rows(docs, labels, label, p.per_class, p.class_bytes)
    sample = sample.select("text", "doc_id", "label", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(p.shards)).cast("int").alias("shard"))
    packed = sample.mapInArrow(extract, "slots array<int>, doc_id long, label int, shard int").groupBy("shard").applyInPandas(compact, "shard int, place int, label int, slots binary")
    held: dict[int, tuple[list[bytes], np.ndarray]] = {}
    table = packed.toPandas()  # at most 2 * per_class rows of class_bytes bytes of text, as numbers that occur more than once, squeezed
    for k, rows in table.groupby("shard"):
        rows = rows.sort_values("place", kind="stable")
        held[int(k)] = list(rows["slots"]), rows["label"].to_numpy(float)[1:]
    del table
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(held)
    trials = [(k, l1, fold) for k in held for l1 in p.l1 for fold in range(p.folds)]

    def each(jobs: list, schema: str, work) -> pd.DataFrame:
        """One task for each job: fits of the same rows run side by side."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for n in (n for f in frames for n in f["id"]):
                yield work(n, *jobs[n])

        return spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, schema).toPandas() if jobs else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    def rows_of(k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        (slots, *own), y = shared.value[k]
        return [restored(x) for x in own], y, restored(slots)

    def trial(n: int, k: int, l1: float, fold: int) -> pd.DataFrame:
        own, y, slots = rows_of(k)
        at, s = fold_scores(own, y, len(slots), p, l1, fold, k)
        return pd.DataFrame({"job": n, "row": at, "score": s})

    scores = each(trials, "job int, row int, score double", trial)
    chosen = []
    for k, (_, y) in held.items():
        unseen = {l1: np.zeros(len(y)) for l1 in p.l1}
        for n, part in scores.groupby("job"):
            if trials[n][0] == k:
                unseen[trials[n][1]][part["row"]] = part["score"]
        chosen.append((k, *chosen_term(unseen, y)))

    def final(n: int, k: int, l1: float, cut: float) -> pd.DataFrame:
        own, y, slots = rows_of(k)
        w, bias = ftrl(own, y, len(slots), p, l1, k)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(slots[at], -1).astype(np.int64), "weight": np.append(w[at], bias - cut)})

    mean = each(chosen, "slot long, weight double", final).groupby("slot")["weight"].sum() / p.shards
    slots, weights = mean.index.to_numpy(np.int64), mean.to_numpy(float)
    bias = float(weights[slots == -1].sum())
    keep = (slots >= 0) & (np.abs(weights) > 1e-3)
    return LinearModel(slots[keep], weights[keep], bias, p.bits)


def score(docs: DataFrame, model: LinearModel) -> DataFrame:
    """(doc_id, score) for each row; null and empty texts have the score of the bias, repeated rows the same score each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: LinearModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)

