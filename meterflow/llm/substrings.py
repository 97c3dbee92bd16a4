"""Substring dedup (operator 8): suffix automata over words, with the first document of each state, in content shards.

A span of at least `window` words that also begins in an earlier document is removed. Text is dealt out by content, so
that all copies of a window meet without any two documents being compared: the least hash among a window's runs of
GRAM words, its anchor, is the same in every copy; a segment is a run of windows with one anchor. Only segments whose
anchor occurs in several documents are kept, equal ones with their first document only. These segments are the
reference; each shard of them has one suffix automaton for each anchor, and streaming a segment through it gives, at
each word, the longest match and the first document that holds the window that ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Texts, Words, blank_table, bloom_of, checkpointed, gram_hashes, slices, word_hashes

WINDOW, GRAM = 13, 5
#: Anchors of at least so many documents are dealt out window by window; of more than 1 / HOT_ANCHORS of all occurrences, if that is more.
HOT, HOT_ANCHORS = 2000, 50_000_000
#: The filter of shared anchors is broadcast up to this many bytes; a larger one is left out, and all segments are then shuffled.
BROADCAST_BYTES = 64 << 20
_BLANK = blank_table()
_MOST, _ANCHOR = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64((1 << 48) - 1)
#: Distinct segments that a task holds back to merge equal ones.
HELD = 40_000


class Segments:
    """The segments of texts: anchor (int64), document, first word and number of windows of each."""

    def __init__(self, texts: Texts, window: int, gram: int):
        self.data, self.words = texts.data, Words(texts, _BLANK)
        h = word_hashes(self.data, self.words)
        grams, at = gram_hashes(h, self.words, gram)
        own = np.full(len(h), _MOST)
        own[at] = grams
        n = max(0, len(h) - window + 1)
        last = np.repeat(self.words.first[1:], self.words.counts())[:n]
        valid = np.arange(n) + window <= last
        least, place = own[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - gram + 1):
            less = own[j : j + n] < least
            np.copyto(least, own[j : j + n], where=less)
            np.copyto(place, j, where=less)
        place += np.arange(n)
        start = np.flatnonzero(valid & ~np.concatenate([[False], valid[:-1] & (place[1:] == place[:-1])])) if n else np.zeros(0, np.int64)
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & (place[1:] == place[:-1]), [False]])) if n else np.zeros(0, np.int64)
        self.anchor, self.start, self.windows = (least[start] & _ANCHOR).view(np.int64), start, stop - start + 1
        self.document = np.searchsorted(self.words.first, start, "right") - 1
        self.hashes, self.window = h, window

    def keep(self, rows: np.ndarray) -> None:
        self.anchor, self.start, self.windows, self.document = self.anchor[rows], self.start[rows], self.windows[rows], self.document[rows]

    def split(self, rows: np.ndarray) -> None:
        """Each window of these rows becomes a segment of its own, under a hash of the window."""
        many = self.windows[rows]
        start = np.repeat(self.start[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        h = np.zeros(len(start), np.uint64)
        for j in range(self.window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[start + j]
        document = np.repeat(self.document[rows], many)
        self.keep(~rows)
        self.anchor, self.start = np.concatenate([self.anchor, h.view(np.int64)]), np.concatenate([self.start, start])
        self.windows, self.document = np.concatenate([self.windows, np.ones(len(start), np.int64)]), np.concatenate([self.document, document])

    def content(self) -> np.ndarray:
        """A 64-bit hash of the words of each segment."""
        h, n = np.zeros(len(self.start), np.uint64), self.windows + self.window - 1
        for j in range(int(n.max(initial=0))):
            more = j < n
            h[more] = h[more] * np.uint64(0xD6E8FEB86659FD93) + self.hashes[self.start[more] + j]
        return h.view(np.int64)

    def texts(self) -> list[bytes]:
        """The words of each segment, joined by single blanks."""
        raw = self.data.tobytes()
        first, last = self.words.starts[self.start].tolist(), self.words.ends[self.start + self.windows + self.window - 2].tolist()
        return [b" ".join(raw[a:b].split()) for a, b in zip(first, last)]


def _anchors(docs: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """(anchor, docs, low, high): documents that each anchor occurs in (counted per task, at most), the smallest and largest id.

    Tasks send one packed array for each part of the anchors' range, and parts are sorted in numpy: a few bytes for
    each segment, with the ids of a hot anchor reduced to two before they are sent.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            both = _extremes(np.concatenate(held))
            held.clear()
            part = both[:, 0] % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(1, parts))
            chunks = [(k, _pack(x)) for k, x in enumerate(np.split(both[order], cuts)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([x for _, x in chunks], pa.binary())], ["part", "packed"])

        size = 0
        for batch in slices(batches):
            s = Segments(Texts(batch.column(1)), window, gram)
            ids = batch.column(0).to_numpy()[s.document]
            held.append(np.stack([s.anchor, ids, ids, np.ones(len(ids), np.int64)], axis=1))
            size += len(ids)
            if size > 300_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(k, []).append(_unpack(x))
        for k in list(held):
            both = _extremes(np.concatenate(held.pop(k)))
            both = both[both[:, 1] < both[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, j])) for j in (0, 3)], ["anchor", "docs"])

    packed = docs.mapInArrow(pack, "part int, packed binary")
    return packed.repartition(parts, "part").mapInArrow(count, "anchor long, docs long")


def _pack(rows: np.ndarray) -> bytes:
    """Rows of one id as six bytes of anchor and the id in as few bytes as the ids need; the others whole."""
    one = (rows[:, 1] == rows[:, 2]) & (rows[:, 3] == 1)
    ids = rows[one, 1]
    base = int(ids.min(initial=1 << 62))
    width = next(w for w in (1, 2, 4, 8) if len(ids) == 0 or int(ids.max()) - base < 1 << (8 * w - 1))
    head = np.array([len(ids), base, width], np.int64).tobytes()
    anchors = np.ascontiguousarray(rows[one, 0]).view(np.uint8).reshape(-1, 8)[:, :6]
    return head + anchors.tobytes() + (ids - base).astype(f"i{width}").tobytes() + rows[~one].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, base, width = np.frombuffer(data, np.int64, 3).tolist()
    anchors = np.zeros((n, 8), np.uint8)
    anchors[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 24).reshape(-1, 6)
    ids = np.frombuffer(data, f"i{width}", n, 24 + 6 * n).astype(np.int64) + base
    rest = np.frombuffer(data, np.int64, -1, 24 + (6 + width) * n).reshape(-1, 4) if len(data) > 24 + (6 + width) * n else np.zeros((0, 4), np.int64)
    return np.concatenate([np.stack([anchors.view(np.int64)[:, 0], ids, ids, np.ones(n, np.int64)], axis=1), rest])


def _extremes(rows: np.ndarray) -> np.ndarray:
    """Rows (anchor, low, high, count), one for each anchor."""
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    return np.stack([rows[first, 0], np.minimum.reduceat(rows[:, 1], first), np.maximum.reduceat(rows[:, 2], first), np.add.reduceat(rows[:, 3], first)], axis=1)


class SuffixAutomaton:
    """Of several word sequences; first[s] is the smallest document that holds the words of state s."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(1 << 62)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state for the longest words of q that lead through p; q's shorter words move to it."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, document: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
            else:
                state, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = state
                    p = self.link[p]
                if p >= 0:
                    self.link[state] = self._split(p, self.next[p][word], word)
                last = state
            if document < self.first[last]:
                self.first[last] = document

    def finish(self) -> None:
        """A state's words are suffixes of those of the states that link to it, and so occur wherever these do."""
        first, link = self.first, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def statistics(self, words: list, window: int) -> list[int]:
        """For each window of the words the smallest document that holds it, 2^62 if none does: the longest match at each word is followed over the suffix links down to the state of its last `window` words."""
        state = matched = 0
        out = []
        for n, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if n >= window:
                s = state
                if matched >= window:
                    while self.length[self.link[s]] >= window:
                        s = self.link[s]
                out.append(self.first[s] if matched >= window else 1 << 62)
        return out


def first_documents(segments: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each (segment, its first document) and each of its windows, the first document that holds the window."""
    if len(segments) == 1:
        text, document = segments[0]
        return [[document] * (text.count(b" ") + 2 - window)]
    words = [t.split(b" ") for t, _ in segments]
    automaton = SuffixAutomaton()
    for w, (_, document) in zip(words, segments):
        automaton.add(w, document)
    automaton.finish()
    return [automaton.statistics(w, window) for w in words]


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): for each document that loses words, the spans [from, to) of word numbers to remove, which may overlap.

    docs: (doc_id long, text string) without null ids.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = checkpointed(_anchors(docs, window, gram, parts))
    total = shared.count()
    occurrences = shared.agg(F.sum("docs")).first()[0] or 0
    hot = shared.where(F.col("docs") >= max(HOT, occurrences // HOT_ANCHORS)).select("anchor")  # HOT_ANCHORS at most, and so a filter within BROADCAST_BYTES
    small = Bloom.size(total) <= BROADCAST_BYTES
    known = spark.sparkContext.broadcast((bloom_of(shared.select("anchor"), total) if small else None, bloom_of(hot, n) if (n := hot.count()) else None))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Segments]]:
        anchors, hot = known.value
        for batch in slices(batches):
            s = Segments(Texts(batch.column(1)), window, gram)
            if anchors is not None:
                s.keep(anchors.holds(s.anchor))
            if hot is not None:
                s.split(hot.holds(s.anchor))  # the few that it takes for hot are split in every document alike
            yield batch.column(0).to_numpy()[s.document], s

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal segments of a task are merged, so that one that every document has is sent a few times for each task."""
        held: dict[tuple[int, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(a, h, *x) for (a, h), x in held.items()]
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "hash", "segment", "first", "last"])

        for ids, s in segments(batches):
            for key, text, i in zip(zip(s.anchor.tolist(), s.content().tolist()), s.texts(), ids.tolist()):
                x = held.get(key)
                if x is None:
                    held[key] = [text, i, i]
                elif i < x[1]:
                    x[1] = i
                elif i > x[2]:
                    x[2] = i
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; an anchor has fewer segments than the documents that make one hot, or one window's (others are split)."""
        anchor, own = None, {}
        out: list[tuple[int, int, list[int]]] = []

        def close() -> None:
            for (h, (_, _, last)), first in zip(own.items(), first_documents([x[:2] for x in own.values()], window)):
                if min(first) < last:
                    out.append((anchor, h, first))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["anchor", "hash", "firsts"])

        for batch in batches:
            for a, h, text, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    if own:
                        close()
                    anchor, own = a, {}
                x = own.get(h)
                own[h] = (text, first, last) if x is None else (text, min(first, x[1]), max(last, x[2]))
            yield batch_of()
        if own:
            close()
        yield batch_of()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in segments(batches):
            start = s.start - s.words.first[s.document]
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor), pa.array(s.content()), pa.array(ids), pa.array(start.astype(np.int32))], ["anchor", "hash", "doc_id", "start"])

    kinds = docs.mapInArrow(distinct, "anchor long, hash long, segment binary, first long, last long")
    kinds = kinds.repartition("anchor").sortWithinPartitions("anchor")
    firsts = checkpointed(kinds.mapInArrow(shard, "anchor long, hash long, firsts array<long>"))
    found = docs.mapInArrow(places, "anchor long, hash long, doc_id long, start int")
    spans = found.join(firsts, ["anchor", "hash"])
    starts = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    spans = spans.select("doc_id", starts.alias("at")).where(F.size("at") > 0)
    runs = spans.select("doc_id", F.array_min("at").alias("low"), F.array_max("at").alias("high"), "at")
    whole = runs.where("high - low + 1 = size(at)").select("doc_id", "low", (F.col("high") + window).alias("to"))
    split = runs.where("high - low + 1 <> size(at)").select("doc_id", F.explode("at").alias("low")).select("doc_id", "low", (F.col("low") + window).alias("to"))
    return whole.unionAll(split).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("low").alias("from"), "to")).alias("spans"))


def kept_words(text: str | None, spans) -> tuple[int, list[bytes]]:
    """The number of words, and the words that no span covers."""
    words = (text or "").encode().split()
    if not spans:
        return len(words), words
    inside = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        inside[s["from"]] += 1
        inside[s["to"]] -= 1
    keep = np.cumsum(inside)[:-1] == 0
    return len(words), [w for w, k in zip(words, keep) if k]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for each row of docs, text being the kept words joined by single blanks.

    A window of `window` words that also starts in a document with a smaller doc_id is removed; windows are judged on
    the input. Rows that share a doc_id are one document's and don't remove from each other, but each loses what either
    would. Rows without doc_id neither lose words nor take any from others. Null and empty texts have no words. An
    empty table gives no rows.
    """
    return _removed(docs, window, lambda words: b" ".join(words).decode(), "text")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats() with the SHA-256 of the text, kept_sha256, in its place."""
    return _removed(docs, window, lambda words: hashlib.sha256(b" ".join(words)).hexdigest(), "kept_sha256")


def _removed(docs: DataFrame, window: int, shown, name: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = checkpointed(removed_spans(texts.where("doc_id is not null and text is not null"), window))
    schema = f"doc_id long, {name} string, n_words long, n_removed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            rows = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), removed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shown(w) for _, w in rows], pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(w) for n, w in rows], pa.int64())],
                ["doc_id", name, "n_words", "n_removed"],
            )

    n = spans.count()
    if Bloom.size(n) > BROADCAST_BYTES:
        return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    losing = docs.sparkSession.sparkContext.broadcast(bloom_of(spans.select("doc_id"), n))  # only texts that may lose words meet their spans

    def may_lose(wanted: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                at = losing.value.holds(ids.fill_null(-1).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(at == wanted))

        return pick

    alone = texts.mapInArrow(may_lose(False), texts.schema).mapInArrow(run, schema)
    met = texts.mapInArrow(may_lose(True), texts.schema).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return alone.unionAll(met.mapInArrow(run, schema))

