"""Benchmark decontamination (operator 5): greedy string tiling of benchmark items in documents.

Documents and items that share a seed, a run of SEED words, are joined; in each such pair the longest common runs of
words that overlap no earlier one are marked again and again, with running Karp-Rabin hashes that find the matches of
one length at a time. An item leaks into a document if the marked tiles cover at least `coverage` of its words, in
whatever order its passages stand there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, Texts, Words, bloom_of, checkpointed, gram_hashes, letter_table, slices, word_hashes

SEED, COVERAGE = 5, 0.8
#: The seeds of a benchmark are broadcast up to so many; a larger one is joined by shuffled seeds.
BROADCAST_SEEDS = 2_000_000
#: Bytes up to which a filter of a larger benchmark's seeds is broadcast.
FILTER_BYTES = 64 << 20
_LETTERS = letter_table()
_WORD = re.compile("[^\x00-&(-/:-@\\[-`{-\x7f]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits, apostrophes and characters beyond ASCII."""
    return _WORD.findall((text or "").lower())


def _seeds(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words (of the whole text if it has fewer) and the row of each; letters count as lower-case ones."""
    texts = Texts(pa.array([(t or "").lower() for t in column.to_pylist()], pa.string()))
    words = Words(texts, _LETTERS)
    h, doc = word_hashes(texts.data, words), words.documents()
    grams, at = gram_hashes(h, words, k)
    return grams, doc[at]


def tiles(document: list, item: list, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in document, start in item, length), longest first, of at least `shortest` words.

    Among matches of one length the earliest in the item, then in the document, is marked. A length is searched with
    running hashes over the runs that are still unmarked on both sides; equal hashes are compared word by word.
    """
    shortest = min(shortest, len(item)) or 1
    codes = {w: n for n, w in enumerate(dict.fromkeys(item))}
    t = [codes[w] for w in item]
    d, place = _runs([codes.get(w, -1) for w in document], shortest)
    free_d, free_t = [x >= 0 for x in d], [True] * len(t)
    found = []
    length = _longest_match(d, free_d, t, free_t, shortest, min(_longest(free_d), len(t)))
    while length:
        table: dict[int, list[int]] = {}
        for at, h in _running(d, free_d, length):
            table.setdefault(h, []).append(at)
        for at, h in _running(t, free_t, length):
            for other in table.get(h, ()):
                if all(free_d[other : other + length]) and all(free_t[at : at + length]) and d[other : other + length] == t[at : at + length]:
                    found.append((place[other], at, length))
                    free_d[other : other + length] = free_t[at : at + length] = [False] * length
                    break
        length = _longest_match(d, free_d, t, free_t, shortest, min(length - 1, _longest(free_d), _longest(free_t)))
    return found


def _longest_match(d: list[int], free_d: list[bool], t: list[int], free_t: list[bool], shortest: int, most: int) -> int:
    """The length, from shortest to most, of the longest free runs with equal hashes; 0 if there are none.

    Runs of one length that match give runs of any smaller one, so that the length is found by halving.
    """
    low, high = shortest - 1, most
    while low < high:
        length = (low + high + 1) // 2
        if {h for _, h in _running(t, free_t, length)}.isdisjoint(h for _, h in _running(d, free_d, length)):
            high = length - 1
        else:
            low = length
    return low if low >= shortest else 0


def _runs(codes: list[int], shortest: int) -> tuple[list[int], list[int]]:
    """The runs of at least `shortest` codes that are not -1, a -1 after each, and where each code stood."""
    out, place, start = [], [], 0
    while start < len(codes):
        if codes[start] < 0:
            start += 1
            continue
        end = start
        while end < len(codes) and codes[end] >= 0:
            end += 1
        if end - start >= shortest:
            out += [*codes[start:end], -1]
            place += range(start, end + 1)
        start = end
    return out, place


def _longest(free: list[bool]) -> int:
    most = run = 0
    for f in free:
        run = run + 1 if f else 0
        most = max(most, run)
    return most


def _running(codes: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each run of `length` free codes: the hash of one run is made from the one before it."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top, h, run = pow(base, length - 1, modulus), 0, 0
    for i, (c, f) in enumerate(zip(codes, free)):
        if not f:
            h = run = 0
            continue
        if run >= length:
            h = (h - (codes[i - length] + 1) * top) % modulus
        h, run = (h * base + c + 1) % modulus, run + 1
        if run >= length:
            yield i - length + 1, h


def covered(document: list, item: list, seed: int = SEED) -> float:
    """The share of the item's words that tiles cover; 0 without words."""
    return sum(n for _, _, n in tiles(document, item, seed)) / len(item) if item else 0.0


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, coverage) of each pair of a document and a benchmark item with at least this coverage.

    Words are lower-cased and lose their punctuation. Tiles have at least `seed` words, or the whole item where it has
    fewer. Null and empty texts match nothing; repeated rows of docs give repeated results; items with one item_id are
    items of their own; a null doc_id is returned as null. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # an upper bound of the number of seeds
    return (_leaks_broadcast if size <= BROADCAST_SEEDS else _leaks_joined)(texts, items, coverage, seed)


class _Items:
    """Benchmark items by their seeds. Runs of fewer words stand for items shorter than a seed."""

    def __init__(self, rows: list, seed: int):
        self.ids = [r["item_id"] for r in rows]
        self.words = [words_of(r["text"]) for r in rows]
        self.seed, self.seeds = seed, {}
        for k in range(1, seed + 1):
            own = [n for n, w in enumerate(self.words) if w and min(len(w), seed) == k]
            if own:
                grams, of = _seeds(pa.array([rows[n]["text"] for n in own]), k)
                order = np.argsort(grams, kind="stable")
                self.seeds[k] = grams[order], np.array(own)[of][order]

    def pairs(self, column: pa.Array) -> list[tuple[int, int]]:
        """(row, item) with a shared seed."""
        found = []
        for k, (grams, own) in self.seeds.items():
            h, row = _seeds(column, k)
            low = np.searchsorted(grams, h)
            hit = np.flatnonzero(grams[np.minimum(low, len(grams) - 1)] == h)
            low, high = low[hit], np.searchsorted(grams, h[hit], "right")
            many = high - low
            item = own[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            found.append(np.unique(np.repeat(row[hit], many) * len(self.ids) + item))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return list(zip((both // max(1, len(self.ids))).tolist(), (both % max(1, len(self.ids))).tolist()))


def _leaks_broadcast(docs: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_Items(items.collect(), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), []
            last, own = -1, []
            for row, item in known.pairs(batch.column(1)):
                if row != last:
                    last, own = row, words_of(batch.column(1)[row].as_py())
                share = covered(own, known.words[item], seed)
                if share >= coverage:
                    out.append((ids[row], known.ids[item], share))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "item_id", "coverage"])

    return docs.mapInArrow(run, "doc_id long, item_id long, coverage double")


def _leaks_joined(docs: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    """The same by a join of seeds, for benchmarks that are too large to broadcast: only pairs that share one meet their texts.

    Documents send only seeds that a Bloom filter of the benchmark's seeds takes for its own, of the lengths that items
    have. An item of n words whose tiles cover coverage * n of them holds at least one seed in `seed` covered words, so
    that a leak shares coverage * n / seed seed places with the document: the item's most frequent places, fewer than
    that by one, are left out of the join without losing a pair, and with them the seeds that many items share.
    """
    spark = docs.sparkSession
    docs, items = docs.withColumn("row", F.xxhash64("doc_id", "text")), items.withColumn("item", F.xxhash64("item_id", "text"))
    places = checkpointed(items.select(F.col("item").alias("id"), "text").distinct().mapInArrow(_hashed(range(1, seed + 1), seed, None), "id long, seed long, k int"))
    places = places.withColumnRenamed("id", "item")
    lengths = sorted(r["k"] for r in places.select("k").distinct().collect())  # at most `seed` numbers
    known = places.select("seed").distinct()
    count = known.count()
    filter_ = spark.sparkContext.broadcast(bloom_of(known, count)) if Bloom.size(count) <= FILTER_BYTES else None
    left = docs.select(F.col("row").alias("id"), "text").mapInArrow(_hashed(lengths, None, filter_), "id long, seed long, k int").withColumnRenamed("id", "row").distinct()
    left = checkpointed(left.join(known, "seed", "left_semi"))
    often = left.groupBy("seed", "k").agg(F.count(F.lit(1)).alias("often"))
    ranked = places.join(often, ["seed", "k"])
    number = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("often"), "seed"))  # an item's own places
    words = places.groupBy("item").agg((F.count(F.lit(1)) + F.max("k") - 1).alias("words"))
    spare = F.ceil(F.col("words") * F.lit(coverage) / F.col("k") - 1e-9) - 1
    right = ranked.withColumn("number", number).join(words, "item").where(F.col("number") > spare).select("item", "seed", "k").distinct()
    pairs = left.join(right, ["seed", "k"]).select("row", "item").distinct()
    met = pairs.join(docs, "row").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [covered(words_of(d), words_of(t), seed) for d, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shares, pa.float64())], ["doc_id", "item_id", "coverage"])
            yield out.filter(pa.array([s >= coverage for s in shares], pa.bool_()))

    return met.select("doc_id", "text", "item_id", "item_text").mapInArrow(tile, "doc_id long, item_id long, coverage double")


def _hashed(lengths, whole: int | None, filter_):
    """Rows (id, seed, k) of batches (id, text): every run of k words for each k; with `whole` only runs of that many, or of the whole text where it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = np.array([len(words_of(t)) for t in batch.column(1).to_pylist()]) if whole else None
            for k in lengths:
                grams, row = _seeds(batch.column(1), k)
                if whole:
                    own = np.minimum(counts, whole)[row] == k
                    grams, row = grams[own], row[own]
                if filter_ is not None:
                    own = filter_.value.holds(grams.view(np.int64))
                    grams, row = grams[own], row[own]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(grams.view(np.int64)), pa.array(np.full(len(row), k, np.int32))], ["id", "seed", "k"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks; rows without doc_id are kept unless their text leaks."""
    place = docs.columns.index("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > BROADCAST_SEEDS:
        marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("key"))
        texts = marked.select(F.col("key").alias("doc_id"), F.col("row.text").cast("string").alias("text")).dropDuplicates(["doc_id"])
        bad = _leaks_joined(texts, items, coverage, seed).select(F.col("doc_id").alias("key")).distinct()
        return marked.join(bad, "key", "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(_Items(items.collect(), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            clean = np.ones(batch.num_rows, bool)
            last, own = -1, []
            for row, item in known.pairs(batch.column(place)):
                if row != last:
                    last, own = row, words_of(batch.column(place)[row].as_py())
                if clean[row] and covered(own, known.words[item], seed) >= coverage:
                    clean[row] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
