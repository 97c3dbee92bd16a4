"""Secret scans (operator 4): candidates by pattern, false positives removed by a random forest.

Candidates are runs of key characters with a digit, and whatever is assigned to or follows a word for a credential.
Features of a candidate: its length, its character transitions, how much of it a dictionary of the corpus's own frequent
words covers, whether it looks like a path or address, and the words beside it. The forest (Spark ML, trained on
executors) learns from labelled findings, a table (doc_id, start, label). Where people have labelled none, secrets of
several kinds and harmless look-alikes are planted at known places of a bounded sample of documents: their labels come
from what was planted, not from the features.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, Words, blank_table, checkpointed, lowered, slices, word_hashes

#: Findings that the forest is fitted on at most, trees and their depth.
SAMPLE, TREES, DEPTH = 20_000, 30, 9
#: Folds that choose the threshold, and the recall that it has at least on them.
FOLDS, RECALL = 2, 0.9
#: Documents that get planted findings, findings planted in each, and characters of a document that they are planted in.
PLANTED_DOCS, PLANTED_EACH, PLANTED_CHARS = 1000, 8, 2000
#: Most frequent words of the corpus that make the dictionary, and letters that a word of it has at least.
DICTIONARY, LETTERS = 20_000, 4

RUN = re.compile(r"[A-Za-z0-9_\-/+=.:@~]{12,}")
#: Words for a credential; those of the second kind count only as parts of a name that something is assigned to.
CREDENTIAL = re.compile(
    r"(passwo?r?d|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer|authorization|credentials?)|(?<![A-Za-z])(?:pass|key|auth|pin)(?![a-z])|(?-i:(?<=[a-z])(?:Pass|Key|Auth|Pin)(?![a-z]))",
    re.IGNORECASE | re.ASCII,
)
#: What a match of the above begins with: an automaton finds these places, and the expression is tried there alone.
_BEGINS = ahocorasick.Automaton()
for _word in "pass pwd secret token api access private bearer authorization credential key auth pin".split():
    _BEGINS.add_word(_word, len(_word))
_BEGINS.make_automaton()
_REST = re.compile(r"[A-Za-z0-9_-]*+")
#: An assignment, a verb or nothing behind a name: the value begins where it ends.
_LINK = re.compile(r"[\"']?+\s*+([:=]{1,2}>?)?+(?:is\b|was\b)?+\s*+(?:(?:bearer|basic)\s++)?+", re.IGNORECASE)
_CLOSING = {'"': re.compile('["\n]'), "'": re.compile("['\n]")}
_PLAIN_END = re.compile(r"[\s\"']|$")
#: Names after which a value that looks like a key is none.
PLAIN_NAMES = set("commit revision checksum sha md sum digest hash etag id uuid guid order invoice ticket build version file path batch serial ref session trace row page url see".split())
_TRAIL = ".,;:!?)]}>"
_NEAR = re.compile(r"[A-Za-z]+")
_BREAKS = blank_table(bytes(c for c in range(128) if not chr(c).isalpha()))
_KIND = {**{c: "l" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "u" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "d" for c in "0123456789"}}
PAIRS = [a + b for a in "luds" for b in "luds"]
#: Slots for the last two words before a candidate, each hashed to one, and for the word after it.
SLOTS = 48
BEFORE, AFTER = 48, 16


def _names(text: str) -> Iterator[re.Match]:
    """The matches of CREDENTIAL in order, overlapping ones too."""
    low = text.lower()
    if len(low) == len(text):
        starts = sorted({end + 1 - size for end, size in _BEGINS.iter(low)})
        yield from (m for m in (CREDENTIAL.match(text, a) for a in starts) if m)
        return
    at = 0
    while m := CREDENTIAL.search(text, at):  # characters whose lower case is longer shift the places
        yield m
        at = m.start() + 1


def named_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, named) of each candidate: values that follow a credential's name, the inner one where they overlap, and runs with a digit that overlap none.

    Every character is passed a fixed number of times, whatever the names and values are.
    """
    found: list[tuple[int, int]] = []
    at = run_end = 0
    for m in _names(text):
        if m.start() < at:
            continue
        link = _LINK.match(text, _REST.match(text, m.end()).end())
        at = start = link.end()  # the value may hold a name itself
        sign = text[start : start + 1]
        if not m.group(1) and not link.group(1):
            continue
        if sign in _CLOSING and (close := _CLOSING[sign].search(text, start + 1)) and close.group() == sign:
            start, end = start + 1, close.start()
        elif not sign or sign in ":=\"'":
            continue
        else:
            run_end = run_end if start < run_end else _PLAIN_END.search(text, start).start()  # one end for all values of a run
            end = run_end
            while end > start and text[end - 1] in _TRAIL:
                end -= 1
        if end > start:
            if found and found[-1][1] > start:
                found.pop()
            found.append((start, end))
    taken = iter([*found, (len(text) + 1, len(text) + 1)])
    low, high = next(taken)
    runs = []
    for m in RUN.finditer(text):
        start, end = m.span()
        while high <= start:
            low, high = next(taken)
        if low >= end and any(c.isdigit() for c in m.group()):
            runs.append((start, end, False))
    return sorted([*((a, b, True) for a, b in found), *runs])


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate."""
    return [(a, b) for a, b, _ in named_spans(text)]


def covered(value: str, words: ahocorasick.Automaton | None) -> float:
    """The share of a value's characters in dictionary words that don't overlap, the one that ends first and is longest first."""
    if words is None or not len(words):
        return 0.0
    at = total = 0
    for end, size in words.iter(value.lower()):
        if end + 1 - size >= at:
            at, total = end + 1, total + size
    return total / len(value)


def features(value: str, before: str, after: str, words: ahocorasick.Automaton | None, named: bool = False) -> list[float]:
    """The numbers of one candidate with the characters before and after it; named: whether it follows a credential's name."""
    n, kinds = len(value), "".join(_KIND.get(c, "s") for c in value)
    moves = Counter(map("".join, zip(kinds, kinds[1:])))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    near = [0.0] * SLOTS
    for k, w in enumerate([*_NEAR.findall(before)[-2:], *_NEAR.findall(after)[:1]]):
        near[xxhash.xxh32_intdigest(f"{k == 2}{w.lower()}") % SLOTS] = 1.0
    stripped = before.rstrip(" \"'")
    last = _NEAR.findall(before)[-1:]
    return [
        math.log(n),
        entropy,
        entropy / max(1.0, math.log2(n)),
        *(moves[p] / max(1, n - 1) for p in PAIRS),
        *(kinds.count(k) / n for k in "luds"),
        covered(value, words),
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        value.count("/") / n,
        value.count(".") / n,
        value.count("-") / n,
        float("://" in value or value.startswith("www.")),
        float("@" in value),
        float(value[:1] in ("<", "$", "{", "%", "*")),
        float(stripped[-1:] in ("=", ":")),
        float(before[-1:] in ("'", '"') and after[:1] == before[-1:]),
        float(named),
        float(bool(last) and last[0].lower() in PLAIN_NAMES),
        *near,
    ]


FEATURES = 3 + len(PAIRS) + 4 + 12 + SLOTS


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of LETTERS letters or more, A-Z as a-z, that are so frequent in all whole texts that at most `size` words are: the commonest first.

    ASCII signs and digits part words. Words are counted slice by slice before they are dealt. The least count is found from the numbers of words of each count, so that only the dictionary reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column(0))
            data = lowered(texts)
            own = Words(texts, _BREAKS)
            starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            long = np.flatnonzero(starts[own.ends] - starts[own.starts] >= LETTERS)
            _, first, n = np.unique(word_hashes(data, own)[long], return_index=True, return_counts=True)
            at = long[first]
            words = [data[a:b].tobytes().decode() for a, b in zip(own.starts[at], own.ends[at])]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["w", "n"])

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w string, n long")
    counts = checkpointed(words.groupBy("w").agg(F.sum("n").alias("n")))
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    reached = F.sum("words").over(Window.orderBy(F.desc("n")))  # one row for each distinct count: a square root of the corpus at most
    least = by.withColumn("reached", reached).where(F.col("reached") <= size).agg(F.min("n")).first()[0]
    if least is None:
        return []
    return [r["w"] for r in sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["w"]))]


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    if words:
        a.make_automaton()
    return a


def _rows(i, text: str, words: ahocorasick.Automaton) -> Iterator[tuple]:
    for start, end, named in named_spans(text):
        value = text[start:end]
        yield i, start, end - start, hashlib.sha256(value.encode()).hexdigest(), features(value, text[max(0, start - BEFORE) : start], text[end : end + AFTER], words, named)


FOUND = "doc_id long, start int, length int, secret_sha256 string, features array<double>"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())]


def candidates(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(doc_id, start, length, secret_sha256, features) of each candidate; start counts characters. Null and empty texts have none.

    words: the broadcast dictionary().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(words.value)
        for batch in slices(batches):
            out = [row for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in _rows(i, t or "", known)]
            columns = list(zip(*out)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


class Planter:
    """Draws secrets and look-alikes with their surroundings; both kinds use most shapes of values and of contexts."""

    _HEX, _LOW, _UP, _DIGITS, _SIGNS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$%&*+-_?@^~"
    _CORES = "password passwd pwd pass token secret api_key access_key access_token client_secret auth_token private_key secret_key credential passphrase apikey".split()
    _AFFIXES = "db my app user smtp admin prod old web cloud".split()
    _OTHERS = "commit revision checksum sha256 md5 etag id uuid order invoice ticket build version file path batch serial ref session trace row".split()
    _HOLDERS = "your_password_here changeme example required <TOKEN> ******** null undefined xxxxxxxx ${PASSWORD} TODO placeholder N/A reset expired ring".split()

    def __init__(self, seed: int, words: list[str]):
        self.r, self.words = np.random.default_rng(seed), words[:2000] or ["house", "river", "stone", "winter"]

    def of(self, chars: str, n: int) -> str:
        return "".join(chars[k] for k in self.r.integers(0, len(chars), n))

    def one(self, items):
        return items[int(self.r.integers(len(items)))]

    def name(self) -> str:
        """The name of a credential: a word for it, with a part before or after it or without, in one of the usual spellings."""
        parts = [self.one(self._CORES)]
        if self.r.random() < 0.5:
            parts.insert(int(self.r.integers(2)), self.one(self._AFFIXES) if self.r.random() < 0.5 else self.one(self.words)[:8])
        style = int(self.r.integers(5))
        if style == 0:
            return "_".join(parts).upper()
        if style == 1:
            first, *rest = "_".join(parts).split("_")
            return first + "".join(x.capitalize() for x in rest)
        return self.one(("_", "-")).join(parts) if style < 4 else " ".join("_".join(parts).split("_"))

    def secret(self) -> str:
        alnum = self._LOW + self._UP + self._DIGITS
        kind = int(self.r.integers(9))
        if kind == 0:
            return self.of(self._HEX, self.one((32, 40, 48, 64)))
        if kind == 1:
            return base64.b64encode(self.r.bytes(int(self.r.integers(15, 45)))).decode()
        if kind == 2:
            return self.one(("AKIA", "ASIA")) + self.of(self._UP + self._DIGITS, 16)
        if kind == 3:
            return self.one(("ghp_", "sk_live_", "xoxb-", "glpat-")) + self.of(alnum, int(self.r.integers(20, 37)))
        if kind == 4:
            return self.of(alnum + self._SIGNS, int(self.r.integers(8, 21)))
        if kind == 5:
            return self.one(("", "-", ".", "_")).join(self.one(self.words) for _ in range(int(self.r.integers(2, 5)))) + self.one(("", "", "-", "_")) + self.of(self._DIGITS, int(self.r.integers(0, 4)))
        if kind == 6:
            return self.one(self.words)[:8] + self.of(self._DIGITS, int(self.r.integers(1, 5))) + self.one(("", "!", "$"))
        if kind == 7:
            return ".".join(base64.urlsafe_b64encode(self.r.bytes(n)).decode().rstrip("=") for n in (15, 30, 24))
        return self.of(alnum, int(self.r.integers(16, 41)))

    def lookalike(self) -> str:
        kind = int(self.r.integers(11))
        if kind == 0:
            return self.of(self._HEX, self.one((32, 40, 64)))
        if kind == 1:
            return str(uuid.UUID(bytes=self.r.bytes(16)))
        if kind == 2:
            return self.of(self._DIGITS, int(self.r.integers(12, 20)))
        if kind == 3:
            return f"20{self.of(self._DIGITS, 2)}-0{self.one('123456789')}-1{self.one(self._DIGITS)}T12:{self.of('012345', 2)}:{self.of('012345', 2)}Z"
        if kind == 4:
            return self.one(("/", "./", "~/")) + "/".join(self.part() for _ in range(int(self.r.integers(2, 5)))) + f"/{self.one(self.words)}{self.of(self._DIGITS, 2)}.{self.one(('so', 'txt', 'html', 'py'))}"
        if kind == 5:
            return f"{self.one(('https://', 'http://', 'www.'))}{self.part()}.example.{self.one(('com', 'org', 'net'))}/{self.part()}/{self.of(self._DIGITS, int(self.r.integers(1, 7)))}{self.one(('', '.html', '.zip'))}"
        if kind == 6:
            return f"{self.part()}{self.one(('', '.', '_'))}{self.of(self._DIGITS, 2)}@{self.one(self.words)}{self.one(('', '1'))}.example.{self.one(('com', 'org', 'net'))}"
        if kind == 7:
            return f"{self.one(self.words)}-{self.one(self._DIGITS)}.{self.of(self._DIGITS, 2)}.{self.one(self._DIGITS)}-rc{self.one(self._DIGITS)}"
        if kind == 8:
            return f"{self.one(self.words)}_{self.one(self.words)}_{self.of(self._DIGITS, 2)}"
        if kind == 9:
            return ".".join(str(int(x)) for x in self.r.integers(100, 256, 4))
        if self.r.random() < 0.5:
            return self.one(("<{}>", "${{{}}}", "{{{{{}}}}}", "%{}%", "your-{}-here", "<your_{}>")).format(self.name().replace(" ", "-"))
        return self.one(self._HOLDERS)

    def part(self) -> str:
        """A part of an address: a word or characters."""
        return self.one(self.words) if self.r.random() < 0.5 else self.of(self._LOW + self._DIGITS, int(self.r.integers(4, 11)))

    def finding(self, label: int) -> tuple[str, str, str]:
        """(before, value, after)."""
        value = self.secret() if label else self.lookalike()
        held = not label and (value in self._HOLDERS or not value[:1].isalnum() and value[:1] not in "/.~" or value.startswith("your-"))
        words_only = value.replace("-", "").replace("_", "").isalpha()
        likely = 0.95 if label else 0.3 if any(c in value for c in "/:@.") or words_only else 0.05
        name = self.name() if held or self.r.random() < likely else self.one(self._OTHERS)
        before, after = self.one((('{} = "', '"'), ("{}: ", ""), ("{}=", ""), ("export {}=", ""), ("the {} is ", ""), ("my {} was ", ""), ('"{}": "', '",'), ("{} '", "'"), ("{}     = ", ""), ("{} := ", "")))
        if not held and self.r.random() < 0.1:
            before, after = self.one((("Authorization: Bearer ", ""), ("Authorization: Basic ", ""))) if label else self.one((("see ", ""), ("", ""), ("(", ")"), ("at ", ",")))
        return before.format(name), value, after


def planted(docs: DataFrame, words: Broadcast, most: int = PLANTED_DOCS) -> DataFrame:
    """The rows of candidates() with a label, from at most `most` documents (of the smallest hashes) with planted findings.

    A candidate has the label of the planted finding that covers most of it and is mostly covered by it; what the
    documents held before has none and is left out. The draw depends on doc_id and text alone.
    """
    text = F.substring(F.coalesce(F.col("text").cast("string"), F.lit("")), 1, PLANTED_CHARS)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null").withColumn("seed", F.xxhash64("doc_id", "text"))
    picked = some.select("doc_id", "seed").orderBy(F.xxhash64("doc_id", F.lit(4)), "seed").limit(most).distinct()  # numbers only; then `most` texts
    some = some.join(F.broadcast(picked), ["doc_id", "seed"], "left_semi").dropDuplicates(["doc_id", "seed"]).select("doc_id", "text", "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(words.value)
        for batch in batches:
            out = []
            for i, t, seed in zip(*(c.to_pylist() for c in batch.columns)):
                p = Planter(seed & (1 << 63) - 1, words.value)
                pieces = re.split(r"(?<=\s)", t)
                where = sorted(p.r.integers(0, len(pieces) + 1, PLANTED_EACH).tolist(), reverse=True)
                marks = []
                for at in where:
                    label = int(p.r.random() < 0.5)
                    pieces[at:at] = [(*p.finding(label), label)]
                whole = ""
                for x in pieces:
                    if isinstance(x, str):
                        whole += x
                    else:
                        whole += (" " if whole and not whole[-1].isspace() else "") + x[0]
                        marks.append((len(whole), len(whole) + len(x[1]), x[3]))
                        whole += x[1] + x[2] + " "
                for row in _rows(i, whole, known):
                    start, end = row[1], row[1] + row[2]
                    for a, b, label in marks:
                        both = min(b, end) - max(a, start)
                        if both > 0.8 * max(b - a, end - start):
                            out.append((*row, label))
            columns = list(zip(*out)) or [()] * (len(_KINDS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*_KINDS, pa.int32()])], [*(f.split()[0] for f in FOUND.split(", ")), "label"])

    return some.mapInArrow(run, FOUND + ", label int")


def sampled(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, x): at most `sample` rows (features, label) of labelled candidates, those of the smallest hashes, half of each label."""
    half = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("secret_sha256", "doc_id", "start"), "doc_id", "start").limit(sample // 2)
        half = part if half is None else half.unionAll(part)
    return checkpointed(half.select("doc_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("x")))


def fit(rows: DataFrame, trees: int = TREES) -> RandomForestClassificationModel | None:
    """A forest from rows (label, x); None unless both labels occur."""
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=DEPTH, seed=4).fit(rows)


def threshold_of(rows: DataFrame, least_recall: float = RECALL, folds: int = FOLDS, trees: int = TREES // 3) -> float:
    """The probability from which findings of folds that a forest has not seen are secrets: best F1 of the cuts with at least this recall.

    Rows of one document are in one fold. 0.5 where a fold lacks a label.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(folds))
    seen = []
    for k in range(folds):
        model = fit(rows.where(fold != k), trees)
        if model is None:
            return 0.5
        part = model.transform(rows.where(fold == k)).select("label", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("cut"))
        seen.append(part.groupBy("label", "cut").count())
    counts = np.zeros((2, 101))
    for part in seen:
        for r in part.collect():  # 202 rows at most
            counts[int(r["label"]), r["cut"]] += r["count"]
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    if not above[1, 0]:
        return 0.5
    recall, f1 = above[1] / above[1, 0], 2 * above[1] / (above[0] + above[1] + above[1, 0])
    fits = np.flatnonzero(recall >= least_recall)
    return int(fits[np.argmax(f1[fits])]) / 100


def judged(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, secret_sha256, probability, is_secret) of candidates; without a model the probability is 0.5."""
    if model is None:
        scored = found.withColumn("probability", F.lit(0.5))
    else:
        scored = model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "length", "secret_sha256", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(doc_id, start, length, secret_sha256, probability, is_secret) of each candidate; is_secret from `threshold` on.

    Without a threshold the one that folds of the labelled findings give.

    labelled: (doc_id, start, label) of findings that people have judged; planted findings where it is None. Repeated
    rows give repeated findings; candidates of rows without doc_id are judged like others. An empty table gives no rows.
    """
    words = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    if labelled is None:
        found, known = candidates(docs, words), planted(docs, words)
    else:
        found = checkpointed(candidates(docs, words))
        known = found.join(labelled.select("doc_id", "start", "label").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
    rows = sampled(known)
    return judged(found, fit(rows), threshold_of(rows) if threshold is None else threshold)
