"""Helpers that the text operators share: durable cuts of the lineage and vectorised words over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task; one longer document is a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch, in the JVM and again in a Python worker; a longer document is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parts of a Bloom filter that are merged by themselves.
FILTER_PARTS = 16
#: The bytes that end a word in `[^\x20\x09-\x0D]+`.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python bounded in bytes: by default they take 10,000 rows, whatever their length.

    A smaller bound that the session has already is kept.
    """
    own = spark.conf.get(BATCH_SETTING).lower().rstrip("b")
    if not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that outlives executors, from spark.checkpoint.dir.

    Where that names none, a local session gets a temporary folder, and a cluster an error: its executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df from checkpoint files in the shared folder."""
    shared_folder(bounded(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df reread from a Parquet table of its own in the shared folder, with a folder for each value of the columns `by`."""
    at = f"{shared_folder(bounded(df.sparkSession))}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Texts:
    """The UTF-8 bytes of a column's texts end to end; null is the empty text.

    data: uint8, offsets: int64, one more than there are texts.
    """

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        large = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        if n == 0 or data is None:
            self.data, self.offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
            return
        at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        self.data, self.offsets = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Where the words of texts stand: starts and ends in bytes, first[d] to first[d + 1] are document d's words.

    blank: for each of the 256 byte values, whether it separates words.
    """

    def __init__(self, texts: Texts, blank: np.ndarray):
        n = len(texts.data)
        inside = ~blank[texts.data]
        edge = np.zeros(n + 1, bool)
        edge[texts.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _BASE


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of one running polynomial, so that no word is touched by itself."""
    up, down = _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[words.ends] - sums[words.starts]) * down[words.starts])


def gram_hashes(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that lie in one document, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + hashes[j : j + n]
    last = np.repeat(words.first[1:], words.counts())[:n]
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mixed(h[at]), at


def blank_table(separators: bytes = BLANKS) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


def letter_table() -> np.ndarray:
    """Separators are all ASCII bytes but letters, digits and the apostrophe; bytes over 127 belong to words."""
    t = np.ones(256, bool)
    t[128:] = False
    t[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'")] = False
    return t


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose texts have about `most` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = Texts(column).offsets[1:]
        at = 0
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lowered(texts: Texts) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    d = texts.data
    return np.where((d >= 65) & (d <= 90), d + np.uint8(32), d).astype(np.uint8)


def chunk_pairs(rows: DataFrame, chunks, name: str = "node") -> DataFrame:
    """rows with `mine`, `i` and `j`: a key of several chunks is dealt so that every two of them, and each by itself, meet in one group.

    chunks: the number for a row's key; `mine` is the row's own by the hash of `name`.
    """
    rows = rows.withColumn("_chunks", F.greatest(F.lit(1), chunks).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(name), F.col("_chunks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(F.least(c, F.col("mine")).alias("i"), F.greatest(c, F.col("mine")).alias("j")))
    return rows.withColumn("_p", F.explode(each)).withColumns({"i": F.col("_p.i"), "j": F.col("_p.j")}).drop("_p", "_chunks")


class Bloom:
    """A Bloom filter of 64-bit keys with about ten bits a key; its size is known before it is built."""

    def __init__(self, keys: int, bits: np.ndarray | None = None):
        self.low = np.uint64((1 << max(10, int(np.ceil(np.log2(max(1, keys) * 8))))) - 1)
        self.bits = np.zeros((int(self.low) + 1) // 8, np.uint8) if bits is None else bits

    @staticmethod
    def size(keys: int) -> int:
        return (1 << max(10, int(np.ceil(np.log2(max(1, keys) * 8))))) // 8

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(keys.view(np.uint64))
        for k in range(5):
            yield (h + np.uint64(k) * (h >> np.uint64(33) | np.uint64(1))) & self.low

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def __contains__(self, key) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys))
        for k, place in enumerate(self._places(keys)):
            place = place[at]
            at = at[(self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(at):
                break
        found = np.zeros(len(keys), bool)
        found[at] = True
        return found


def bloom_of(keys: DataFrame, count: int) -> Bloom:
    """The filter of a DataFrame's one long column; tasks make filters, their parts are merged on executors, and the driver gets each part once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Bloom(count)
        for batch in batches:
            f.add(batch.column(0).to_numpy())
        for k, part in enumerate(np.split(f.bits, FILTER_PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(bits.as_buffer(), np.uint8)
                parts[k] = parts[k] | own if k in parts else own.copy()
        for k, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    schema = "part int, bits binary"
    merged = keys.coalesce(FILTER_PARTS).mapInArrow(build, schema).repartition(FILTER_PARTS, "part").mapInArrow(merge, schema)
    f = Bloom(count)
    size = len(f.bits) // FILTER_PARTS
    for row in merged.toLocalIterator():  # one filter of the size that was checked
        f.bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return f
