"""Embedding near-dedup (operator 6): collision counting on many one-dimensional projections.

Unit vectors are projected on random lines. Each table sorts the vectors of a label along one line of its own, inside
cells of several other lines; each vector opens a window around its own projection and collides with the vectors of its
cell in it. The collisions of a pair over all tables are binomial; the number of tables and the count that a pair must
reach are calibrated so that a pair at the least cosine that still links is lost with a chance of 1 - recall. The cells
grow finer with the number of vectors, so that a vector meets a few strangers in each table, however many there are.
Pairs that reach the count are verified by their cosine in double precision.

Only row numbers are sorted and counted. A cell with many members, the mark of a group of near copies, sends no pairs:
its members are first verified against one of them, and only cells that this leaves in parts are searched with their
vectors. The neighbours of a vector all lie in its component and are counted there: at once where the component is so
narrow that all its members must be linked, in bounded blocks of vectors otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, comb, cos, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunk_pairs, mixed
from .components import components, forest

#: Cells and windows in standard deviations of a linked pair's difference on a line; vectors of a label that a vector meets by chance in a table.
CELL, HALF_WINDOW, STRANGERS = 5.3, 2.0, 2.0
#: Members of a cell up to which its pairs are counted, and vectors that are compared in one task at once.
CROWD, BLOCK = 24, 2048


def chances(cosine: float, lines: int) -> tuple[float, float]:
    """That a pair at this cosine and a pair at right angles collide in a table of this many cell lines."""
    near = _same_cell(1.0) ** lines * erf(HALF_WINDOW / sqrt(2))
    apart = 1 / sqrt(1 - cosine)  # the ratio of the two differences
    return near, _same_cell(apart) ** lines * erf(HALF_WINDOW / apart / sqrt(2))


def _same_cell(deviation: float) -> float:
    """The chance of one cell of width CELL, placed at random, for a normal difference of this deviation."""
    x = np.linspace(-CELL, CELL, 2001)
    y = (1 - np.abs(x) / CELL) * np.exp(-((x / deviation) ** 2) / 2) / (deviation * sqrt(2 * np.pi))
    return float(y.sum() * (x[1] - x[0]))


def calibrated(chance: float, tables: int, recall: float) -> int:
    """The largest collision count that a pair with this chance in each table reaches with at least this recall."""
    lost = 0.0
    for count in range(tables + 1):
        lost += comb(tables, count) * chance**count * (1 - chance) ** (tables - count)
        if lost > 1 - recall:
            return count
    return tables


def plan(cosine: float, recall: float, vectors: int) -> tuple[int, int, int]:
    """(cell lines, tables, least count) for labels of at most so many vectors; the count is 2 at least."""
    lines = 1
    while vectors * chances(cosine, lines)[1] > STRANGERS and lines < 40:
        lines += 1
    chance, tables = chances(cosine, lines)[0], 2
    while calibrated(chance, tables, recall) < 2:
        tables += max(1, tables // 16)
    return lines, tables, calibrated(chance, tables, recall)


def _units(column) -> np.ndarray:
    x = np.stack(list(column)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _lines(d: int, lines: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit directions, the cell lines of each table before its sorted ones, and each cell line's shift and factor."""
    rng = np.random.default_rng(20)
    directions = rng.standard_normal((d, tables * (lines + 1)))
    factors = rng.integers(1, 1 << 62, tables * lines).astype(np.uint64) | np.uint64(1)
    return directions / np.linalg.norm(directions, axis=0), rng.random(tables * lines), factors


def cells(units: np.ndarray, cosine: float, lines: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell (uint64) and the place in windows' half widths of each row in each table."""
    d = units.shape[1]
    directions, shift, factors = _lines(d, lines, tables)
    p = units @ directions / sqrt((2 - 2 * cosine) / d)
    where = np.floor(p[:, : tables * lines] / CELL + shift).astype(np.int64).view(np.uint64) * factors
    cell = where.reshape(len(units), tables, lines).sum(axis=2, dtype=np.uint64)
    return mixed(cell + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)), p[:, tables * lines :] / HALF_WINDOW


def collisions(cell: np.ndarray, place: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs (smaller, greater) of equal cells whose places differ by 1 at most; rows are sorted by cell and place."""
    a, b, i = [], [], np.arange(len(cell))
    for lag in range(1, len(cell)):
        i = i[i + lag < len(cell)]
        i = i[(cell[i] == cell[i + lag]) & (place[i + lag] - place[i] <= 1)]
        if not len(i):
            break
        a.append(np.minimum(node[i], node[i + lag]))
        b.append(np.maximum(node[i], node[i + lag]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def reached(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of unit vectors: each search compares its newest rows with those not yet reached."""
    a, b, rest = [], [], np.arange(len(x))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.full(len(rest), -1)
            for at in range(0, len(front), BLOCK):
                part = front[at : at + BLOCK]
                open_ = np.flatnonzero(found < 0)
                near = x[rest[open_]] @ x[part].T >= cosine
                hit = near.any(axis=1)
                found[open_[hit]] = part[near[hit].argmax(axis=1)]
            a.append(found[found >= 0])
            b.append(rest[found >= 0])
            front, rest = rest[found >= 0], rest[found < 0]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def embedding_links(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.999) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding, label).

    Rows are compared only with rows of the same label and the same number of components. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows whose label is null, link with nothing. Equal vectors of a
    label are compared once and counted each; a row without vec_id links and counts like any other but never names a
    component: its component_id is null unless its component has a vec_id. Repeated rows stay. An empty table gives no
    rows. cosine lies above 0 and below 1.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    v = F.when(usable, F.transform("v", lambda c: c + F.lit(0.0)))  # -0.0 becomes 0.0
    rows = rows.select("vec_id", F.xxhash64("label").alias("kind"), v.alias("v"))
    rows = checkpointed(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("kind", F.size("v"), "v"))))
    ids = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(rows.where("node is not null").select("node", "kind", "v").dropDuplicates(["node"]))
    largest = nodes.groupBy("kind", F.size("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lines, tables, least = plan(cosine, recall, largest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pd.DataFrame({"node": batch.column(0).to_numpy(), "kind": batch.column(1).to_numpy(), "v": batch.column(2).to_pandas()})
            for _, same in own.groupby(own["v"].map(len)):
                for at in range(0, len(same), 512):
                    some = same.iloc[at : at + 512]
                    cell, spot = cells(_units(some["v"]), cosine, lines, tables)
                    cell = mixed(cell ^ mixed(some["kind"].to_numpy().view(np.uint64))[:, None])
                    columns = [pa.array(cell.ravel().view(np.int64)), pa.array(spot.ravel()), pa.array(np.repeat(some["node"].to_numpy(), tables))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "place", "node"])

    met = nodes.mapInArrow(place, "cell long, place double, node long")
    sizes = met.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size > 1")
    met = checkpointed(met.join(sizes, "cell"))

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                own = [np.concatenate(x) for x in zip(rest, own)]
            if len(own[0]):
                cut = int(np.searchsorted(own[0], own[0][-1]))  # the last cell may go on in the next batch
                rest = [x[cut:] for x in own]
                yield pair_batch(*collisions(*[x[:cut] for x in own]))
        if rest is not None:
            yield pair_batch(*collisions(*rest))

    small = met.where(F.col("size") <= CROWD).select("cell", "place", "node").repartition("cell").sortWithinPartitions("cell", "place")
    pairs = small.mapInArrow(collide, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = checkpointed(pairs.where(F.col("n") >= least).select("a", "b"))
    crowds = met.where(F.col("size") > CROWD).select("cell", "node", "first", "size")
    with_first = crowds.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_units(batch.column(k).to_pandas()) for k in (2, 3))
                good = np.einsum("ij,ij->i", x, y) >= cosine
                yield pair_batch(batch.column(0).to_numpy()[good], batch.column(1).to_numpy()[good])

    def verified(some: DataFrame) -> DataFrame:
        both = some.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
        return both.where(F.size("x") == F.size("y")).select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    links = checkpointed(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionAll(with_first).distinct()))
    so_far = components(links)
    end = lambda c: so_far.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    crowds = crowds.join(so_far, "node", "left").withColumn("c", F.coalesce("component", "node"))
    parted = crowds.groupBy("cell").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("cell")
    open_ = chunk_pairs(crowds.join(parted, "cell").select("cell", "node", "size"), F.ceil(F.col("size") * 2 / BLOCK))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": []}).astype("int64")]
        for _, same in part.groupby(part["v"].map(len)):
            p, q = reached(_units(same["v"]), cosine)
            node = same["node"].to_numpy()
            found.append(pd.DataFrame({"a": node[p], "b": node[q]}))
        return pd.concat(found)

    more = open_.join(nodes.select("node", "v"), "node").groupBy("cell", "i", "j").applyInPandas(search, "a long, b long")
    found = components(checkpointed(links.unionAll(verified(apart)).unionAll(more)))

    counted = _neighbours(nodes.join(found, "node").join(ids, "node").select("component", "node", "v", "copies"), cosine)
    names = ids.join(found, "node", "left").select("node", "id", "copies", F.coalesce("component", "node").alias("c"))
    least_id = names.groupBy("c").agg(F.min("id").alias("component_id"))
    result = names.join(least_id, "c").join(counted, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = rows.where("node is not null").select("vec_id", "node").join(result, "node").select("vec_id", "n_links", "component_id")
    return good.unionAll(rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _neighbours(members: DataFrame, cosine: float) -> DataFrame:
    """(node, n): copies of other nodes linked with each node of members (component, node, v, copies), which holds whole components.

    A component of over BLOCK members of which all lie within half the angle of a link from their mean has all pairs
    linked; the others are compared by chunks.
    """
    members = checkpointed(members)
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("total"))
    large = checkpointed(members.join(whole.where(F.col("size") > BLOCK), "component"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    unit = large.select("component", "node", F.transform("v", lambda c: c / norm).alias("u"))
    mean = unit.groupBy("component").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("m"))
    dot = F.aggregate(F.zip_with("u", "m", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    long_ = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, c: s + c * c))
    narrow = unit.join(mean, "component").groupBy("component").agg(F.min(dot / long_).alias("least"))
    narrow = checkpointed(narrow.where(F.col("least") >= cos(acos(cosine) / 2) + 1e-9).select("component"))
    sure = large.join(narrow, "component", "left_semi").select("node", (F.col("total") - F.col("copies")).alias("n"))
    wide = members.join(whole, "component").join(narrow, "component", "left_anti").select("component", "node", "v", "copies", "size")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        x, copies, mine = _units(part["v"]), part["copies"].to_numpy(), part["mine"].to_numpy()
        within, n = part["i"].iloc[0] == part["j"].iloc[0], np.zeros(len(part), np.int64)
        for at in range(0, len(part), 1024):
            near = x[at : at + 1024] @ x.T >= cosine
            if not within:
                near &= mine[at : at + 1024, None] != mine[None, :]
            n[at : at + 1024] = near @ copies
        if within:
            n -= copies  # a vector is not its own neighbour
        return pd.DataFrame({"node": part["node"], "n": n})

    blocks = chunk_pairs(wide, F.ceil(F.col("size") * 2 / BLOCK)).groupBy("component", "i", "j").applyInPandas(count, "node long, n long")
    return sure.unionAll(blocks).groupBy("node").agg(F.sum("n").alias("n"))
