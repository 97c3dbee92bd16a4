"""Line dedup (operator 2): sharded cuckoo filters backed by exact reference counts, reversible by document deletions.

A LineIndex has two DataFrames: `counts` (key, refs), the number of documents that hold each line key, and `filters`
(shard, state), one cuckoo filter for each shard of the keys that reached the threshold. Inserting or deleting
documents adds or subtracts their keys in the counts; keys that cross the threshold enter or leave their shard's
filter. A shard that would become too full is built anew from the exact counts, and when the frequent keys outgrow the
shards, each shard is split. A line whose key is not in a filter is kept without looking further; the keys that a
filter takes for members are confirmed by the exact counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed

#: A shard has at most this many members, and the filters with their exceptions are broadcast up to this many bytes.
SHARD_KEYS, BROADCAST_BYTES = 1 << 15, 32 << 20
KEY_BYTES, SLOTS, KICKS = 16, 4, 400
#: A filter is built for this share of its places and built anew beyond the other.
SPARSE, FULL = 0.6, 0.9
#: Keys that so small a share of all documents' lines hold are joined; the others, 1 / HOT_SHARE at most, are broadcast.
HOT_SHARE = 1e-5


def line_key(line: bytes) -> bytes:
    """The line with `[\\x20\\x09-\\x0D]` stripped and A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; one that finds no place after KICKS moves goes to an exact, counted stash."""

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: Counter[tuple[int, int]] | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash = stash if stash is not None else Counter()

    @classmethod
    def sized(cls, members: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, members) / (SLOTS * SPARSE))))))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: uint64 (n, 2). Fingerprint, never 0, and the two buckets, each the other's partner under the fingerprint."""
        print_ = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        low = np.uint64(self.buckets - 1)
        one = (keys[:, 1] >> np.uint64(8)) & low
        return print_, one.astype(np.int64), (one ^ self._step(print_)).astype(np.int64)

    def _step(self, print_: np.ndarray) -> np.ndarray:
        return ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)) & np.uint64(self.buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(keys)
        found = (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)
        if self.stash:
            found |= [(p, a) in self.stash or (p, b) in self.stash for p, a, b in zip(print_.tolist(), one.tolist(), two.tolist())]
        return found

    def insert(self, keys: np.ndarray) -> None:
        moves = np.random.default_rng(len(keys))
        table = self.table.tolist()
        step = {}
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                if 0 in table[at]:
                    table[at][table[at].index(0)] = p
                    break
            else:
                at = b
                for slot in moves.integers(SLOTS, size=KICKS).tolist():
                    p, table[at][slot] = table[at][slot], p
                    if p not in step:
                        step[p] = int(self._step(np.array([p], np.uint16))[0])
                    at ^= step[p]
                    if 0 in table[at]:
                        table[at][table[at].index(0)] = p
                        break
                else:
                    self.stash[p, at] += 1
        self.table = np.array(table, np.uint16).reshape(self.buckets, SLOTS)

    def delete(self, keys: np.ndarray) -> None:
        """Removes one entry of each member; a key that was never inserted must not be given.

        Members of equal fingerprints and places are alike: which of them loses its entry makes no difference.
        """
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                if len(slot := np.flatnonzero(self.table[at] == p)):
                    self.table[at, slot[0]] = 0
                    break
                if self.stash[p, at] > 0:
                    self.stash[p, at] -= 1
                    break
        self.stash = +self.stash

    def state(self) -> bytes:
        stash = np.array(sorted((p, at, n) for (p, at), n in self.stash.items()), np.int64).reshape(-1, 3)
        return np.array([self.buckets, len(stash)], np.int64).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def load(cls, state: bytes) -> CuckooFilter:
        buckets, n = np.frombuffer(state, np.int64, 2).tolist()
        end = 16 + 2 * SLOTS * buckets
        stash = np.frombuffer(state, np.int64, 3 * n, end).reshape(-1, 3).tolist()
        return cls(buckets, np.frombuffer(state, np.uint16, SLOTS * buckets, 16).reshape(buckets, SLOTS).copy(), Counter({(p, at): k for p, at, k in stash}))


def _wide(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def document_keys(docs: DataFrame) -> DataFrame:
    """(key): each document's distinct line keys of at least one code point, hashed to 128 bits; rows are documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[bytes] = []
                for t in batch.column(0).slice(at, 500).to_pylist():
                    keys = {line_key(x) for x in (t or "").encode().split(b"\n")}
                    keys.discard(b"")
                    out += map(digest, keys)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary")


def _shard(shards: int):
    """A key's shard, from its last four bytes; with twice the shards, each is split in two."""
    return (F.conv(F.hex(F.substring("key", KEY_BYTES - 3, 4)), 16, 10).cast("long") % shards).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """min_docs documents make a key frequent; filters (shard, buckets, state) part the keys into `shards`, a power of two."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10) -> LineIndex:
        """Rows are documents, also where they repeat a doc_id or text; null and empty texts add no key."""
        counts = checkpointed(document_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("refs")))
        return cls(counts, docs.sparkSession.createDataFrame([], "shard int, buckets long, state binary"), 0, min_docs)._fitted(None)

    def _fitted(self, crossed: DataFrame | None) -> LineIndex:
        """The index whose filters hold the frequent keys of its counts.

        crossed (key, way): keys that entered (1) or left (-1) since the filters were made. Shards that it would make
        too full, and all shards where they are too few, are built from the counts, which hold every frequent key.
        """
        frequent = self.frequent()
        shards = max(1, self.shards)
        total = frequent.count()
        while total > shards * SHARD_KEYS * 0.8:  # a share of room, for shards differ a little in size
            shards *= 2
        if crossed is None or shards != self.shards:
            changes = frequent.select(_shard(shards), F.lit(None).cast("binary").alias("state"), "key", F.lit(1).alias("way"))
        else:
            members = frequent.groupBy(_shard(shards)).agg(F.count(F.lit(1)).alias("members"))
            full = members.join(self.filters.select("shard", "buckets"), "shard", "left").where(F.col("members") > F.coalesce("buckets", F.lit(0)) * SLOTS * FULL)
            full = F.broadcast(checkpointed(full.select("shard")))  # a row for each shard at most
            moved = crossed.select(_shard(shards), F.lit(None).cast("binary").alias("state"), "key", "way").join(full, "shard", "left_anti")
            anew = frequent.select(_shard(shards), F.lit(None).cast("binary").alias("state"), "key", F.lit(1).alias("way")).join(full, "shard", "left_semi")
            old = self.filters.select("shard", "state", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("way")).join(full, "shard", "left_anti")
            changes = moved.unionAll(anew).unionAll(old)
        return replace(self, shards=shards, filters=checkpointed(changes.groupBy("shard").applyInPandas(_filled, "shard int, buckets long, state binary")))

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = document_keys(docs).groupBy("key").agg((F.count(F.lit(1)) * sign).alias("refs"))
        both = self.counts.select("key", "refs", F.col("refs").alias("old")).unionAll(delta.select("key", "refs", F.lit(0).cast("long").alias("old")))
        both = checkpointed(both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("old").alias("old")))
        is_, was = F.col("refs") >= self.min_docs, F.col("old") >= self.min_docs
        crossed = both.where(is_ != was).select("key", F.when(is_, 1).otherwise(-1).alias("way"))
        return replace(self, counts=both.where("refs > 0").select("key", "refs"))._fitted(crossed)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs: rows that were inserted before, with their texts."""
        return self._changed(docs, -1)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs).select("key")

    def exceptions(self, docs: DataFrame, states: Broadcast) -> DataFrame:
        """(key): line keys of docs that their shard's filter takes for members and the exact counts do not."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.load(s) for k, s in states.value.items()}
            sent: set[bytes] = set()  # what the filters take for members is mostly a few frequent keys
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    keys = {line_key(x) for t in batch.column(0).slice(at, 500).to_pylist() for x in (t or "").encode().split(b"\n")}
                    keys.discard(b"")
                    own = [*map(digest, keys)]
                    hits = [k for k, m in zip(own, member(filters, own, shards)) if m and k not in sent] if own else []
                    if len(sent) > 100_000:
                        sent.clear()
                    sent.update(hits)
                    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary())], ["key"])

        hits = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary").distinct()
        return hits.join(self.frequent(), "key", "left_anti")


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; a new one is made where the rows hold no state."""
    state, keys = rows["state"].dropna(), rows[rows["way"] != 0]
    came, gone = (_wide(keys.loc[keys["way"] == w, "key"]) for w in (1, -1))
    f = CuckooFilter.load(state.iloc[0]) if len(state) else CuckooFilter.sized(len(came))
    f.delete(gone)
    f.insert(came)
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "buckets": [f.buckets], "state": [f.state()]})


def drop_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with a new text column that lacks all lines whose key the index has as frequent, and `n_lines`, `n_dropped`.

    The documents need not be those of the index. A null or empty text is one empty line and becomes the empty text;
    empty lines stay. All other columns stay, n_lines and n_dropped excepted, which are replaced. The filters and their
    exceptions are broadcast while they have at most BROADCAST_BYTES; beyond that the lines are joined with the exact
    counts, with the same result.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    size = index.filters.agg(F.sum(F.length("state"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        context = docs.sparkSession.sparkContext
        states = context.broadcast({r["shard"]: bytes(r["state"]) for r in index.filters.collect()})
        wrong = checkpointed(index.exceptions(docs, states))
        if size + KEY_BYTES * wrong.count() <= BROADCAST_BYTES:
            return _drop_broadcast(docs, index.shards, states, context.broadcast(frozenset(bytes(r["key"]) for r in wrong.collect())))
    return _drop_joined(docs, index)


def _schema(docs: DataFrame):
    return docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema


def _drop_broadcast(docs: DataFrame, shards: int, states: Broadcast, exceptions: Broadcast) -> DataFrame:
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, wrong = {k: CuckooFilter.load(s) for k, s in states.value.items()}, exceptions.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [t.encode().split(b"\n") for t in part.column(place).to_pylist()]
                keys = [digest(k) if (k := line_key(x)) else b"" for lines in split for x in lines]
                gone = np.array([bool(k) for k in keys])
                rows = np.flatnonzero(gone)
                if len(rows):
                    gone[rows] = member(filters, [keys[r] for r in rows], shards)
                    for r in np.flatnonzero(gone):
                        gone[r] = keys[r] not in wrong
                texts, n_lines, n_dropped, k = [], [], [], 0
                for lines in split:
                    out = gone[k : k + len(lines)]
                    texts.append(b"\n".join([x for x, g in zip(lines, out) if not g]).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(int(out.sum()))
                    k += len(lines)
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.column(place).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*part.schema.names, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, _schema(docs))


def member(filters: dict[int, CuckooFilter], keys: list[bytes], shards: int) -> np.ndarray:
    """Whether each key is in its shard's filter."""
    found, wide = np.zeros(len(keys), bool), _wide(keys)
    shard = wide.view(">u4")[:, 3].astype(np.int64) % shards
    for s, f in filters.items():
        at = np.flatnonzero(shard == s)
        if len(at):
            found[at] = f.contains(wide[at])
    return found


def _drop_joined(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Lines as rows, joined with the frequent keys; each document's lines meet again by a key of its own content.

    Keys that more than HOT_SHARE of all references go to are few whatever the input's size; they are broadcast, so
    that no key of the join has more than that share of the rows.
    """
    place, names = docs.columns.index("text"), docs.columns
    total = index.counts.agg(F.sum("refs")).first()[0] or 0
    hot = index.counts.where(F.col("refs") >= max(index.min_docs, total * HOT_SHARE)).select("key")
    common = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in hot.collect()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.expr("unhex(sha2(to_json(struct(*)), 256))").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, keys = [], []
                for i, t in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500).to_pylist()):
                    found = {digest(k) for x in t.encode().split(b"\n") if (k := line_key(x))} - common.value
                    ids += [i] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], ["id", "key"])

    lines = rows.select("id", "row.text").mapInArrow(run, "id binary, key binary").distinct()
    gone = lines.join(index.frequent(), "key").groupBy("id").agg(F.collect_list("key").alias("gone"))
    whole = rows.join(gone, "id", "left").select("row", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, n_lines, n_dropped = [], [], []
            for t, keys in zip(columns[place].to_pylist(), batch.column(1).to_pylist()):
                lines, keys = t.encode().split(b"\n"), set(keys or ())
                kept = [x for x in lines if not (k := line_key(x)) or (d := digest(k)) not in keys and d not in common.value]
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return whole.mapInArrow(cut, _schema(docs))
