"""Hard negatives by inner product: best-first search in STR-packed R-trees of bounding boxes.

Rows are dealt to shards by ranges of label and leading coordinate, and every shard is packed sort-tile-recursively. A box
of coordinates gives an interval of inner products with an anchor, so a search takes boxes by their greatest possible
score and leaves out those outside its window of scores or strictly below the k-th score found. All anchors, in blocks,
meet all shards; what the shards find is merged by rank.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components of a shard and of a block of anchors, at 8 bytes each the most that a task holds of them.
SHARD_CELLS, BLOCK_CELLS = 1 << 20, 1 << 15
#: Blocks that a task takes to one shard, where there are enough pairs of blocks and shards for as many tasks.
GROUP, TASKS = 4, 256
#: Rows of a leaf and children of an inner node.
LEAF, FANOUT = 128, 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Sums below this are whole numbers in double precision.
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Mining:
    """scale: a component x becomes floor(scale * x). An anchor has `positives` positives, each with `negatives` negatives.

    A negative's score lies between low and high hundredths of the positive's.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: int) -> tuple[int, int]:
        """The least and greatest negative score that the positive's allows."""
        return -(-self.low * score // 100), self.high * score // 100


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need: a type letter, then the rows end to end."""
    for letter in "hi":
        if not v.size or (np.abs(v).max() <= np.iinfo(letter).max):
            return letter.encode() + v.astype(letter).tobytes()
    return b"d" + v.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, chr(data[0]), offset=1).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def widened(v: np.ndarray, dims: int) -> np.ndarray:
    """Shorter vectors go on with zeros."""
    return np.pad(v, ((0, 0), (0, dims - v.shape[1])))


def tiled(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of sort-tile-recursive packing along the coordinates that vary most."""
    spread = np.argsort(-points.var(axis=0), kind="stable")[:3] if len(points) else []

    def order(at: np.ndarray, axes: list[int]) -> np.ndarray:
        if len(at) <= leaf or not len(axes):
            return at
        at = at[np.argsort(points[at, axes[0]], kind="stable")]
        slabs = int(np.ceil((-(-len(at) // leaf)) ** (1 / len(axes))))
        size = -(-(-(-len(at) // leaf)) // slabs) * leaf
        return np.concatenate([order(at[k : k + size], axes[1:]) for k in range(0, len(at), size)])

    return order(np.arange(len(points)), list(spread))


class Tree:
    """Packed rows with the boxes of leaves and of the nodes above; node 0 is the root, `first` and `last` bound a node's children.

    A node is a leaf from `leaves` on, and its children are rows then.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        cuts = np.arange(0, len(ids), LEAF)
        levels = [(cuts, np.minimum(cuts + LEAF, len(ids)), np.minimum.reduceat(v, cuts), np.maximum.reduceat(v, cuts), np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts))]
        while len(levels[0][0]) > 1:
            _, _, low, high, least, most = levels[0]
            cuts = np.arange(0, len(low), FANOUT)
            levels.insert(0, (cuts, np.minimum(cuts + FANOUT, len(low)), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))
        starts = np.cumsum([0] + [len(x[0]) for x in levels])
        self.leaves = int(starts[-2])
        above = [(starts[k + 1], starts[k + 1]) for k in range(len(levels) - 1)] + [(0, 0)]  # children are numbered level by level
        self.first = np.concatenate([x[0] + a for x, (a, _) in zip(levels, above)]).tolist()
        self.last = np.concatenate([x[1] + a for x, (_, a) in zip(levels, above)]).tolist()
        self.low, self.high, self.least, self.most = (np.concatenate([x[k] for x in levels]) for k in range(2, 6))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product of each anchor (row) with any point of each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Search:
    """One anchor against one tree; scores of a leaf are kept for the next search of the same anchor."""

    def __init__(self, tree: Tree, anchor: np.ndarray, anchor_id: int, label: int, low: np.ndarray, high: np.ndarray, exact: bool):
        self.tree, self.anchor, self.id, self.label, self.low, self.high, self.exact = tree, anchor, anchor_id, label, low.tolist(), high.tolist(), exact
        self.met: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        alone, with_label = tree.least == tree.most, (tree.least <= label) & (label <= tree.most)
        self.useful = {True: with_label.tolist(), False: (~(alone & with_label)).tolist()}

    def scores(self, leaf: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of a leaf's rows with the anchor's label or, if not same, with others; never of the anchor's own id."""
        if (leaf, same) not in self.met:
            a, b = self.tree.first[leaf], self.tree.last[leaf]
            s = self.tree.v[a:b] @ self.anchor
            if not self.exact:
                s = np.array([min(max(int(x), LOWEST), HIGHEST) for x in s], object)
            labels, ids = self.tree.labels[a:b], self.tree.ids[a:b]
            for kind in (True, False):
                take = ((labels == self.label) == kind) & (ids != self.id)
                self.met[leaf, kind] = s[take], ids[take]
        return self.met[leaf, same]

    def best(self, found: list[tuple[int, int]], k: int, same: bool, least: int = LOWEST, most: int = HIGHEST) -> None:
        """Adds to the k first (score, -id) with scores between least and most; found is a heap whose root is the k-th."""
        low, high, useful, leaves = self.low, self.high, self.useful[same], self.tree.leaves
        queue = [(-min(high[0], most), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and -bound < found[0][0]:
                break
            if node >= leaves:
                s, ids = self.scores(node, same)
                floor = max(least, found[0][0]) if len(found) == k else least
                for j in np.flatnonzero((s >= floor) & (s <= most)):
                    entry = (int(s[j]), -int(ids[j]))
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                continue
            for child in range(self.tree.first[node], self.tree.last[node]):
                if useful[child] and low[child] <= most and high[child] >= least and (len(found) < k or high[child] >= found[0][0]):
                    heapq.heappush(queue, (-min(high[child], most), child))


def _rows(vectors: pa.Array, scale: int) -> np.ndarray:
    lengths = np.diff(np.asarray(vectors.offsets))
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _pack(scale: int, cells: int, tile: bool):
    """Rows of a partition as packed rows of at most `cells` components, in the tree's order if tile."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        dims = max(x[3].shape[1] for x in held)
        keys = [np.concatenate([x[k] for x in held]) for k in range(3)]
        v = np.concatenate([widened(x[3], dims) for x in held])
        if tile:
            labels, at = keys[2], np.argsort(keys[2], kind="stable")
            cuts = np.flatnonzero(np.diff(labels[at], prepend=labels[at][:1] - 1))
            at = np.concatenate([part[tiled(v[part])] for part in np.split(at, cuts[1:])])
            keys, v = [x[at] for x in keys], v[at]
        columns = [[len(v)], *[[x.astype("q").tobytes()] for x in keys], [packed(v)]]
        arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4])]
        if not tile:
            arrays.append(pa.array([[p for x in held for p in x[4]]], pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(arrays, ["n", "rows", "ids", "labels", "vectors", "positives"][: len(arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a few rows at a time, so that no more than `cells` are held
                part = batch.slice(at, 256)
                at += len(part)
                v = _rows(part.column(3), scale)
                if held and size + v.size > cells:
                    yield flush(held)
                    held, size = [], 0
                held.append((*[part.column(k).to_numpy() for k in range(3)], v, *([] if tile else [part.column(4).to_pylist()])))
                size += v.size
        if held:
            yield flush(held)

    return run


PACKED = "n int, rows binary, ids binary, labels binary, vectors binary"
FOUND = "row long, positive int, score long, id long"


def _search(mining: Mining):
    """What each anchor of a block finds in a shard: its positives, or where it has them, the negatives of each one's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # carried from shard to shard, so that a later one is searched above the k-th
        for batch in batches:
            for r in batch.to_pylist():
                v, a = unpacked(r["vectors"], r["n"]), unpacked(r["a_vectors"], r["a_n"])
                dims = max(v.shape[1], a.shape[1])
                v, a = widened(v, dims), widened(a, dims)
                exact = float(np.abs(v).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(1, dims) < EXACT
                if not exact:  # Python's integers, slow and of any size
                    v, a = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (v, a))
                if shard != (r["shard"], dims, exact):
                    shard, tree = (r["shard"], dims, exact), Tree(np.frombuffer(r["ids"], "q"), np.frombuffer(r["labels"], "q"), v)
                rows, ids, labels = (np.frombuffer(r[x], "q") for x in ("a_rows", "a_ids", "a_labels"))
                low, high = tree.bounds(a)
                for k, positives in enumerate(r["positives"]):
                    search = Search(tree, a[k], int(ids[k]), int(labels[k]), low[k], high[k], exact)
                    if positives is None:
                        search.best(found[int(rows[k]), 0], mining.positives, True)
                        continue
                    for place, score in enumerate(positives, 1):
                        least, most = mining.window(score)
                        if least <= most:
                            search.best(found[int(rows[k]), place], mining.negatives, False, least, most)
        entries = ((row, place, score, -i) for (row, place), heap in found.items() for score, i in heap)
        while part := list(itertools.islice(entries, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), [pa.int64(), pa.int32(), pa.int64(), pa.int64()])], ["row", "positive", "score", "id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and positive, numbered from 1; ranks are cut in every task before the rows are dealt."""
    place = F.row_number().over(Window.partitionBy("row", "positive").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _met(shards: DataFrame, anchors: DataFrame, n_shards: int, n_blocks: int, mining: Mining) -> DataFrame:
    """FOUND of every block of anchors in every shard: blocks go to each bucket of shards, shards to each group of blocks."""
    groups = -(-n_blocks // GROUP) if n_shards * n_blocks > TASKS else n_blocks
    blocks = anchors.repartition(n_blocks).mapInArrow(_pack(mining.scale, BLOCK_CELLS, False), PACKED + ", positives array<array<long>>")
    blocks = blocks.select(*[F.col(c).alias(f"a_{c}") for c in ("n", "rows", "ids", "labels", "vectors")], "positives")
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("a_rows"), F.lit(groups))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    shards = shards.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(n_shards)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    shards, blocks = (x.repartition(2 * n_shards * groups, "bucket", "group") for x in (shards, blocks))  # a number that is not lowered for small tables
    return shards.join(blocks, ["bucket", "group"]).mapInArrow(_search(mining), FOUND)


def mine(rows: DataFrame, is_anchor: Column, mining: Mining | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    rows: (vec_id, embedding, label), other columns are not read. A score is the inner product of components made whole by
    floor(scale * x). An anchor's positives are the first rows of its label, its negatives the first rows of other labels
    inside the positive's window; higher scores come first, then smaller vec_ids. Rows with a null id, label, vector or
    component, or a component that is not finite, take no part. Rows with an anchor's vec_id are not its positives or
    negatives; other repeated rows count each by itself, also as anchors. A shorter vector goes on with zeros. Scores
    beyond 64 bits become the nearest long. Empty tables and anchors without partners give no rows.
    """
    m = mining or Mining()
    vector = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    kept = written(kept)
    columns = ["row", "id", "label", "v"]
    size = kept.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("v")).alias("dims")).first()
    dims = max(1, size["dims"] or 1)
    n_shards, n_blocks = (-(-max(1, size[k]) // max(1, cells // dims)) for k, cells in (("n", SHARD_CELLS), ("anchors", BLOCK_CELLS)))
    ranged = kept.select(*columns).repartitionByRange(n_shards, "label", F.get("v", F.lit(0)), "id")
    shards = written(ranged.mapInArrow(_pack(m.scale, SHARD_CELLS, True), PACKED).withColumn("shard", F.monotonically_increasing_id()))
    anchors = kept.where("is_anchor").select(*columns)
    met = _met(shards, anchors.withColumn("positives", F.lit(None).cast("array<long>")), n_shards, n_blocks, m)
    positives = _first(met, m.positives).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    positives = written(positives.select("row", "anchor_id", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda x: x["positive_score"])
    wanted = anchors.join(positives.groupBy("row").agg(scores.alias("positives")), "row")  # at most m.positives in a group
    found = _first(_met(shards, wanted, n_shards, n_blocks, m), m.negatives)
    found = found.select("row", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(positives, ["row", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
