"""The nearest of a bank of reference vectors, by cosine or with proportions and height, with its margin over the best other label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of references that are broadcast at most; larger banks are refused, as each row is scored against all of them.
MOST_BYTES = 16 << 20


def bank(rows: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, centre): the mean vector of each label, from partial sums by place."""
    at = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "x"))
    means = at.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def nearest(rows: DataFrame, references: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, nearest, similarity, margin): ties go to the smaller label; margin is null with one label.

    references (label, centre), of at most MOST_BYTES, are broadcast and each batch of vectors is scored against all of
    them. Missing components count as 0, null vectors are left out; without references there are no rows.
    """
    size = references.agg(F.sum(F.size("centre") * 8 + 16)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of references, more than {MOST_BYTES}")
    few = sorted(((r["label"], r["centre"]) for r in references.collect()), key=lambda x: x[0])
    width = max((len(c) for _, c in few), default=0)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([_padded(c, width) for _, c in few], float).reshape(-1, width), [x for x, _ in few]))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres, labels = shared.value
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        for vectors in batches:
            x = np.array([_padded(v, width) for v in vectors], float).reshape(-1, width)
            norm = np.array([np.sqrt(sum(float(c) ** 2 for c in v if c is not None)) for v in vectors])
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (x @ unit.T) / norm[:, None]
            order = np.argsort(-s, axis=1, kind="stable")
            best, rows_ = order[:, 0], np.arange(len(s))
            margin = s[rows_, best] - s[rows_, order[:, 1]] if len(labels) > 1 else np.full(len(s), np.nan)
            yield pd.DataFrame({"place": best, "similarity": s[rows_, best], "margin": margin})

    by = rows.where(F.col(vector).isNotNull())
    if not few:
        by = by.limit(0)
    scored = by.select(key, F.pandas_udf(score, "place int, similarity double, margin double")(F.col(vector)).alias("s"))
    label = F.element_at(F.array(*[F.lit(x) for x, _ in few]), F.col("s.place") + 1) if few else F.lit(None)
    one = F.col("s.margin") if len(few) > 1 else F.lit(None).cast("double")
    return scored.select(key, label.alias("nearest"), F.col("s.similarity").alias("similarity"), one.alias("margin"))


def bank_of_shapes(rows: DataFrame, *groups: str) -> DataFrame:
    """(label, centre, aspect, height): a reference of each label and group, from rows (label, embedding, aspect, height)."""
    at = rows.where("embedding is not null and label is not null").select("label", *groups, F.posexplode("embedding").alias("i", "x"))
    means = at.groupBy("label", *groups, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label", *groups)
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    shapes = rows.where("embedding is not null and label is not null").groupBy("label", *groups).agg(F.avg(F.col("aspect").cast("double")).alias("aspect"), F.avg(F.col("height").cast("double")).alias("height"))
    return means.join(shapes, ["label", *groups]).select("label", "centre", "aspect", "height")


def read_glyphs(rows: DataFrame, references: DataFrame, key: str = "vec_id", aspect_cost: float = 0.3, height_cost: float = 0.8) -> DataFrame:
    """(key, best, other, margin, likeness, deviation): each glyph's label by shape, proportions and height.

    rows: (key, embedding, aspect, height); references: (label, centre, aspect, height), of at most MOST_BYTES, broadcast.
    A reference's score is its cosine less aspect_cost for each unit by which the logarithms of the proportions differ and
    height_cost for each by which the heights do. best has the greatest score and other the greatest of another label
    (null if there is none); margin is their difference, likeness the greatest cosine of all, deviation the least
    difference of the logarithms among references of the best label. Equal scores go to the smaller label. Glyphs without
    vector, with a vector of zeros, or without proportions above 0 and height are left out.
    """
    size = references.agg(F.sum(F.size("centre") * 8 + 32)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of references, more than {MOST_BYTES}")
    few = sorted(((r["label"], r["centre"], r["aspect"], r["height"]) for r in references.collect()), key=lambda x: x[0])
    names = sorted({x[0] for x in few})
    width = max((len(x[1]) for x in few), default=0)
    label_of = np.array([names.index(x[0]) for x in few], int)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([_padded(x[1], width) for x in few], float).reshape(len(few), width), label_of, np.array([[x[2], x[3]] for x in few], float).reshape(-1, 2)))

    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        centres, label, shapes = shared.value
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.nan_to_num(centres / np.linalg.norm(centres, axis=1, keepdims=True))
        for vectors, aspects, heights in batches:
            x = np.array([_padded(v, width) for v in vectors], float).reshape(-1, width)
            norm = np.array([np.sqrt(sum(float(c) ** 2 for c in v if c is not None)) for v in vectors])
            likeness = (x @ unit.T) / norm[:, None]
            apart = np.abs(np.log(aspects.to_numpy(float)[:, None] / shapes[:, 0]))
            total = likeness - aspect_cost * apart - height_cost * np.abs(heights.to_numpy(float)[:, None] - shapes[:, 1])
            by_label = np.stack([total[:, label == k].max(axis=1) for k in range(label.max() + 1)], axis=1)
            order, at = np.argsort(-by_label, axis=1, kind="stable"), np.arange(len(x))
            best = order[:, 0]
            second = order[:, 1] if by_label.shape[1] > 1 else np.full(len(x), -1)
            margin = by_label[at, best] - by_label[at, second] if by_label.shape[1] > 1 else np.full(len(x), np.nan)
            near = np.where(label[None, :] == best[:, None], apart, np.inf).min(axis=1)
            yield pd.DataFrame({"best": best, "other": second, "margin": margin, "likeness": likeness.max(axis=1), "deviation": near})

    usable = F.exists("embedding", lambda c: F.coalesce(c != 0, F.lit(False))) & (F.col("aspect") > 0) & F.col("height").isNotNull()
    by = rows.where(F.coalesce(usable, F.lit(False)))
    if not few:
        by = by.limit(0)
    read = F.pandas_udf(score, "best int, other int, margin double, likeness double, deviation double")
    scored = by.select(key, read(F.col("embedding"), F.col("aspect").cast("double"), F.col("height").cast("double")).alias("s"))
    labels = F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(None).cast(references.schema["label"].dataType))
    name = lambda c: F.get(labels, F.nullif(F.col(f"s.{c}"), F.lit(-1)))
    margin = F.when(F.col("s.other") >= 0, F.col("s.margin"))
    return scored.select(key, name("best").alias("best"), name("other").alias("other"), margin.alias("margin"), "s.likeness", "s.deviation")


def zero_or_o(glyphs: DataFrame, line: str, place: str, least: float) -> DataFrame:
    """glyphs (line, place, best, other, margin) with char: an unsure 0 or о is о behind п or before к, as the letter is in no other word, else 0."""
    order = Window.partitionBy(line).orderBy(place)
    unsure = (F.col("margin") < least) & (F.array_sort(F.array("best", "other")) == F.array(F.lit("0"), F.lit("о")))
    letter = (F.lag("best").over(order) == "п") | (F.lead("best").over(order) == "к")
    return glyphs.withColumn("char", F.when(unsure, F.when(letter, "о").otherwise("0")).otherwise(F.col("best")))


def _padded(vector, width: int) -> np.ndarray:
    """The first `width` components; missing ones are 0."""
    out = np.zeros(width)
    own = [0.0 if x is None else float(x) for x in vector[:width]]
    out[: len(own)] = own
    return out
