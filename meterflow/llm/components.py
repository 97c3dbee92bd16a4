"""Connected components by repeated contraction: DataFrame joins and minima only, nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each node and the smallest node of its component among these links; at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b: long); component is the smallest node that can be reached.

    Rows with a null end are no links; nodes without a link to another node are not returned. In each round every
    node joins its smallest neighbour, and the graph is contracted: at least half of the nodes that still have links
    vanish, and a hub costs one row for each of its links. Each round ends in the shared checkpoint folder.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = checkpointed(links.mapInArrow(_forests, "a long, b long").distinct())
    labels = None
    while not links.isEmpty():
        ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpointed(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).withColumn("up", F.least("node", "up")))
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            step = up.select(F.col("node").alias("component"), "up")
            labels = checkpointed(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        links = (
            links.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        links = checkpointed(links.mapInArrow(_forests, "a long, b long").distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
