"""SimHash near-dedup (operator 7): links between fingerprints that few bits separate, found with pivot distance tables.

Distinct fingerprints are dealt out by masks: with r differing bits at most, of b blocks of bits at least b - r are
equal, so some choice of b - r blocks gives both fingerprints one key. Inside a group of equal keys, Hamming distances
to reference fingerprints (pivots) are tabled; by the triangle inequality a pair whose distances to any pivot differ by
more than r cannot be linked, and only the survivors are compared bit by bit. Tasks return a spanning forest of the
links that they find, not the pairs.

Word shingles owe a similarity, not a number of bits: near_similar takes as candidates the texts that share one of their
least shingle hashes and whose fingerprints of 256 bits over distinct shingles are within a radius that a pair of the
similarity hardly exceeds. Candidates are sent as a spanning forest; its components hold every pair that may be linked,
and in each the exact shingle sets are searched from one text to those it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, bloom_of, checkpointed, chunk_pairs, slices
from .components import components, forest

#: Members of a group that are compared in one task; larger groups are compared chunk by chunk.
GROUP = 4096
#: Candidate pairs that a task holds before it sends them on.
PART = 1 << 16
#: Least shingle hashes that two texts must share one of: a pair of similarity s shares none with a chance of (1 - s) ** LEAST at most.
LEAST = 10
#: Words of 64 bits of the fingerprint that parts candidates from chance meetings.
WORDS = 4
WORD_COLUMNS = [f"w{n}" for n in range(WORDS)]
#: Bytes up to which a filter of the texts to verify is broadcast, and shingle hashes that are searched in one task.
FILTER_BYTES, HASHES = 64 << 20, 4_000_000
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, 12, dtype=np.uint64)


def _gram_hashes(text: str | None, k: int) -> Iterator[bytes]:
    """The big-endian hashes of a text's runs of k words, 65,536 at a time; of the whole text if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], (ends[k - 1 :] - 1).tolist()
    else:
        starts, ends = starts[:1], [len(joined)]
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 1 << 16):
        yield b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])


def _majority(hashes: Iterator[bytes]) -> int:
    bits, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h) // 8
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words."""
    return _majority(_gram_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(distinct: int, bits: int) -> list[int]:
    """Masks of which every two fingerprints within `bits` bits share one key; more blocks, and so longer keys, for more fingerprints."""
    blocks = bits + 1 + sum(distinct > 1 << limit for limit in (22, 30))
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) - (1 << 64 if sum(c) >= 1 << 63 else 0) for c in combinations(block, blocks - bits)]


def near_pairs(fp: np.ndarray, same: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """linked() in parts of about PART pairs."""
    away = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((away[:, 0], same))
    fp, same, away = fp[order], same[order], away[order]
    found, held, i = [], 0, np.arange(len(fp))
    for lag in range(1, len(fp)):
        i = i[i + lag < len(fp)]
        i = i[(same[i] == same[i + lag]) & (away[i + lag, 0] - away[i, 0] <= bits)]  # rows are sorted by the first pivot's distance: once too far, too far for longer lags
        if not len(i):
            break
        near = i[np.abs(away[i, 1:] - away[i + lag, 1:]).max(axis=1) <= bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= bits]
        found.append((order[near], order[near + lag]))
        held += len(near)
        if held >= PART:
            yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            found, held = [], 0
    if held:
        yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def linked(fp: np.ndarray, same: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of equal `same` (a group's number, ascending) whose fingerprints differ in `bits` bits at most."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pairs(fp, same, bits)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that come sorted by group, the first column; what follows the last whole group waits for the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        rest = [x[cut:] for x in rows]
        if cut:
            yield [x[:cut] for x in rows]
    if rest is not None:
        yield rest


def _links_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _search(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, ids in _whole_groups(batches):
            i, j = linked(fp.view(np.uint64), np.unique(group, return_inverse=True)[1], bits)
            yield _links_of(*forest(ids[i], ids[j]))

    return run


def _dealt(keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows with fp, `names` and their group's size as rows (group, fp, *others) sorted by group: groups of over GROUP members by pairs of chunks."""
    others = [c for c in keys.columns if c not in (*names, "size")]
    keys = keys.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("size") * 2 / GROUP)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("mine")).alias("low"), F.greatest(c, F.col("mine")).alias("high")))
    pairs = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))).otherwise(F.filter(each, lambda p: p["low"] < p["high"]))
    dealt = keys.withColumn("mine", mine).select(*others, *names, F.explode(pairs).alias("p"))
    dealt = dealt.select(F.xxhash64(*names, "p.low", "p.high").alias("group"), *others)  # groups that share a number are only compared needlessly
    return dealt.repartition("group").sortWithinPartitions("group")


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints within `bits` bits of each other. prints: distinct (fp, id), both long.

    Groups of over GROUP members are dealt into chunks; every two chunks meet in one task, so that a group of any size
    is compared whole and no task gets more than two chunks.
    """
    choices = masks(prints.count(), bits)
    keys = prints.select("fp", "id", F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(choices)])).alias("k"))
    keys = keys.select("fp", "id", "k.mask", "k.key")
    sizes = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = _dealt(keys.join(sizes, ["mask", "key"]), ["mask", "key"])
    return dealt.mapInArrow(_search(bits), "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: its fingerprint and the smallest doc_id that links reach.

    Equal fingerprints are one node, so copies cost nothing beyond a partial minimum. Null and empty texts have
    fingerprint zero and are linked like any other. A row without doc_id links like any other and takes the name of its
    class (null if no row of the class has an id); repeated rows stay, each with the same answer. Rows of different
    texts that share a doc_id are judged each by its own text. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, k))
    return _named(prints, _classes(prints, bits))


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, c): the class of each distinct fingerprint of prints, named by its smallest fingerprint."""
    distinct = checkpointed(prints.select("fp").distinct())
    found = components(links(distinct.select("fp", F.col("fp").alias("id")), bits)).withColumnRenamed("node", "fp")
    return checkpointed(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("c")))


def _named(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of prints; ids are reduced to one for each fingerprint before classes meet."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    ids = classes.join(least, "fp").groupBy("c").agg(F.min("id").alias("component_id"))
    return prints.join(classes.join(ids, "c").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def hexed(fp):
    """The 16 lowercase hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_unique(docs: DataFrame, k: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each class of simhash_components, as first_of_each picks it."""
    prints = checkpointed(fingerprints(docs.withColumn("doc_id", _row_key(docs)), k).withColumnRenamed("doc_id", "key"))
    return first_of_each(docs, prints.join(_classes(prints, bits), "fp").select("key", "c"))


def _row_key(docs: DataFrame):
    """A row's name, made of its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one row of each class: of the smallest doc_id, rows without one last; of one id that of the smallest key.

    classes (key, c): the class of each row of docs by _row_key. Rows that repeat doc_id and text have one key, and of
    them the row stays whose other columns come first as JSON. Only keys are shuffled for the decision; then rows whose
    key may have lost or is repeated meet the keys that stay, and all others stay in their place.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _row_key(docs).alias("key"))
    rows = checkpointed(keyed.select("id", "key").join(classes.dropDuplicates(["key"]), "key").groupBy("key", "c").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    stay = checkpointed(rows.groupBy("c").agg(first).select(F.col("first.key").alias("key")))
    contested = checkpointed(rows.join(stay, "key", "left_anti").select("key").unionAll(rows.where("rows > 1").select("key")))
    count = contested.count()
    if Bloom.size(count) > FILTER_BYTES:
        sure, unsure = None, keyed
    else:
        filter_ = docs.sparkSession.sparkContext.broadcast(bloom_of(contested, count))

        def may_lose(wanted: bool):
            def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(filter_.value.holds(batch.column(2).to_numpy()) == wanted))

            return pick

        sure, unsure = (keyed.mapInArrow(may_lose(w), keyed.schema) for w in (False, True))
    order = Window.partitionBy("key").orderBy(F.to_json("row"))
    kept = unsure.join(stay, "key", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
    return kept if sure is None else sure.select("row.*").unionAll(kept)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of k words."""
    return np.unique(np.frombuffer(b"".join(_gram_hashes(text, k)), ">u8")).astype(np.uint64)


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Another hash of each hash, with other bits for each word: splitmix64."""
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    z = z ^ z >> np.uint64(31)
    z = (z + np.uint64(word * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(31)


def signature(own: np.ndarray) -> list[int]:
    """The fingerprint of a set of shingles in WORDS words of 64 bits; copies of a shingle count once, as in the similarity."""
    parts = [own[at : at + (1 << 16)] for at in range(0, len(own), 1 << 16)]
    return [_majority(_spread(x, w).astype(">u8").tobytes() for x in parts) for w in range(1, WORDS + 1)]


def _node(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def radius(similarity: float, bits: int = 64, loss: float = 1e-6) -> int:
    """The bits within which fingerprints of a pair of this similarity lie but for a chance of `loss`.

    A bit differs with the chance angle / pi for large sets of equal size, where the cosine is 2s / (1 + s); in sets of a
    few shingles, where one vote decides, with 3 / 16 at similarity 0.8, a quarter more. Bits are taken as independent.
    """
    p = 1.25 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    over, r = 1.0, -1
    while over > loss and r < bits:
        r += 1
        over -= comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def _candidates(kinds: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all kinds (node, size, least, w0 to the last word) which share a least hash and may be as similar as that."""
    bits, wide = radius(similarity), radius(similarity, 64 * WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, size, node, *more in _whole_groups(batches):
            a = b = np.zeros(0, np.int64)  # one forest for all parts of the groups' pairs
            for i, j in near_pairs(fp.view(np.uint64), np.unique(group, return_inverse=True)[1], bits):
                away = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in (fp, *more))  # signed, it would count the magnitude's bits
                fit = (away <= wide) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                a, b = forest(np.concatenate([a, node[i[fit]]]), np.concatenate([b, node[j[fit]]]))
            yield _links_of(a, b)

    keys = kinds.select(F.col("w0").alias("fp"), F.col("size").alias("shingles"), "node", *WORD_COLUMNS[1:], F.explode("least").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return _dealt(keys.join(sizes, "key"), ["key"]).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all sets of sorted distinct hashes with at least this Jaccard similarity; two empty sets are equal.

    From one set after the other that has been reached, the common hashes of all sets not yet reached are counted at once.
    """
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(size)
    starts, held = ends - size, np.zeros(len(flat) + 1, bool)
    a, b, rest = [], [], np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        own = np.concatenate([flat[starts[k] : ends[k]] for k in rest]) if len(rest) else flat[:0]
        while front and len(rest):
            one = front.pop()
            held[flat[starts[one] : ends[one]]] = True
            sums = np.concatenate([[0], np.cumsum(held[own])])
            held[flat[starts[one] : ends[one]]] = False
            to = np.cumsum(size[rest])
            both = sums[to] - sums[to - size[rest]]
            near = both / np.maximum(size[rest] + size[one] - both, 1) >= similarity if size[one] else size[rest] == 0
            if near.any():
                a += [one] * int(near.sum())
                b += rest[near].tolist()
                front += rest[near].tolist()
                own = own[np.repeat(~near, size[rest])]
                rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of docs: links join texts whose sets of k-word shingles have at least this Jaccard similarity.

    Equal sets are one node; null and empty texts have the empty set, and are linked with each other. Every row's text
    links, also one without doc_id, but only ids name a component. Of two texts, one shared hash among the LEAST least
    makes a candidate; the exact sets decide. Candidates are sent as a forest, and the texts of each of its components are
    searched together, in chunks where they are many, so that no pairs of a large class are sent.
    """
    rows = _similar(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k, similarity)
    names = rows.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "c").select("doc_id", "component_id")


def _similar(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, c): the class of each row of texts (doc_id, text), named by one of its sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                own = shingles(t, k)
                out.append((_node(own), len(own), own[:LEAST].view(np.int64).tolist(), signature(own)))
            node, size, least, words = zip(*out)
            words = np.array(words, np.uint64).view(np.int64).T
            columns = [batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(least, pa.list_(pa.int64())), *map(pa.array, words)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "node", "size", "least", *WORD_COLUMNS])

    texts = texts.withColumn("own", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = checkpointed(texts.mapInArrow(sketch, "doc_id long, own long, node long, size long, least array<long>, " + ", ".join(f"{w} long" for w in WORD_COLUMNS)))
    clusters = components(checkpointed(_candidates(rows.dropDuplicates(["node"]), similarity))).withColumnRenamed("component", "cluster")
    members = rows.groupBy("node").agg(F.min("own").alias("own"), F.max("size").alias("size")).join(clusters, "node")
    members = checkpointed(members.select("cluster", "node", "own", "size"))
    count = members.count()
    wanted = texts.sparkSession.sparkContext.broadcast(bloom_of(members.select("own"), count)) if Bloom.size(count) <= FILTER_BYTES else None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = batch.column(1).to_numpy()
            at = np.flatnonzero(wanted.value.holds(own)) if wanted is not None else np.arange(len(own))
            sets = [shingles(batch.column(0)[int(n)].as_py(), k).view(np.int64) for n in at]
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(sets, pa.list_(pa.int64()))], ["own", "hashes"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        p, q = alike([np.asarray(s, np.int64) for s in part["hashes"]], similarity)
        node = part["node"].to_numpy()
        return pd.DataFrame({"a": node[p], "b": node[q]}).astype("int64")

    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("sum"))
    chunks = F.greatest(F.ceil(F.col("many") * 2 / GROUP), F.ceil(F.col("sum") * 2 / HASHES))
    dealt = chunk_pairs(members.join(sizes, "cluster"), F.when((F.col("many") <= GROUP) & (F.col("sum") <= HASHES), F.lit(1)).otherwise(chunks).cast("int"))
    sets = texts.select("text", "own").mapInArrow(whole, "own long, hashes array<long>").join(members.select("own").distinct(), "own", "left_semi").dropDuplicates(["own"])
    met = dealt.select("cluster", "i", "j", "node", "own").join(checkpointed(sets), "own")
    found = components(checkpointed(met.groupBy("cluster", "i", "j").applyInPandas(search, "a long, b long")))
    return rows.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))


def near_similar(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class of similar_components, as first_of_each picks it."""
    rows = _similar(docs.select(_row_key(docs).alias("doc_id"), F.col("text").cast("string").alias("text")), k, similarity)
    return first_of_each(docs, rows.select(F.col("doc_id").alias("key"), "c"))
