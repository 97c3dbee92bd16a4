"""SentencePiece vocabularies as weighted transducers (operator 3) and as unigram tries (operator 9)."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Where the public vocabulary files lie; a parameter of every operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of a worker's cache of distinct pre-tokens, and nodes of its trie; a full one is begun again.
CACHED, NODES = 150_000, 500_000
#: Characters beyond which a pre-token gets no nodes in the trie.
LONG = 1000


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of one protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            n, at = read_varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and normaliser settings of one model file's bytes."""

    def __init__(self, data: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.vocab_size()
        self.data = data
        self.unknown = sp.unk_id()
        self.byte = {}
        self.ids: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        self.text = [b""] * n  # what each id decodes to
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.text[i] = piece.replace(SPACE, " ").encode()
        spec = {k: v for k, v in fields(data) if k in (2, 3)}
        trainer, normaliser = dict(fields(spec.get(2, b""))), dict(fields(spec.get(3, b"")))
        self.bpe = trainer.get(3, 1) == 2
        if normaliser.get(2):
            raise ValueError("the model has a compiled character map; only whitespace normalisers are compiled here")
        self.dummy_prefix, self.fold_spaces = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.longest = max(map(len, self.ids), default=1)
        self.matches = ahocorasick.Automaton()  # all pieces that end at each character, as (id, number of characters)
        for piece, i in self.ids.items():
            self.matches.add_word(piece, (i, len(piece)))
        self.matches.make_automaton()
        self._lengths = np.array([len(x) for x in self.text])
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def normalised(self, text: str) -> str:
        """What Normaliser.composed gives for a whole text, by its runs instead of its characters."""
        if self.fold_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def decoded(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        n = self._lengths[ids]
        out = self._bytes[np.repeat(self._starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
        return (out[1:] if self.dummy_prefix and out[:1] == b" " else out).decode(errors="replace")


_PRE = re.compile(f"{SPACE}?[^{SPACE}\n\t]+|{SPACE}+(?={SPACE})|{SPACE}|[\n\t]+")


class Table(dict):
    """Values of distinct keys, made when first asked for; long keys aren't kept.

    A full table becomes the older one, from which keys that are asked for again come back; what nobody asked for since
    goes when the next is full.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if isinstance(key, int) or len(key) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Splitter:
    """Values of a text's pre-tokens: runs of blanks, words with one leading blank, runs of line ends and tabs.

    No piece crosses from one to the next. Lines of words between single blanks, the usual case, are split at once.
    """

    def __init__(self, v: Vocabulary, value):
        self.v = v
        self.bare, self.led = Table(value), Table(lambda w: value(SPACE + w))

    def values(self, text: str) -> list:
        v = self.v
        if v.fold_spaces or not v.dummy_prefix:
            return [*map(self.bare.__getitem__, self._pretokens(v.normalised(text)))]
        out: list = []
        if not text:
            return out
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.bare["\n"])
            if "  " in line or "\t" in line or SPACE in line or line[:1] in ("", " ") or line[-1] == " ":
                out += map(self.bare.__getitem__, self._pretokens((SPACE if not n else "") + line.replace(" ", SPACE)))
                continue
            words = line.split(" ")
            if n:
                out.append(self.bare[words[0]])
                words = words[1:]
            out += map(self.led.__getitem__, words)
        return out

    def _pretokens(self, normal: str) -> list[str]:
        """The last blank of a run belongs to the run where the word after it does not take it."""
        out: list[str] = []
        for x in _PRE.findall(normal):
            if out and x[0] == SPACE and not out[-1].strip(SPACE) and not self.takes(x):
                out[-1] += SPACE
                x = x[1:]
            if x:
                out.append(x)
        return out

    def takes(self, word: str) -> bool:
        return len(word) > 1


class Normaliser:
    """The normaliser as a transducer: for each state and kind of character, what an arc writes and where it leads.

    Kinds are the blank and any other character, which is written as it is (None). All arcs weigh nothing.
    """

    START, TEXT, GAP = range(3)

    def __init__(self, dummy_prefix: bool, fold_spaces: bool):
        lead = SPACE if dummy_prefix else ""
        self.arcs: dict[tuple[int, bool], tuple[str, str | None, int]] = {  # (state, blank): (written before, the character or another, next state)
            (self.START, False): (lead, None, self.TEXT),
            (self.TEXT, False): ("", None, self.TEXT),
            (self.GAP, False): (SPACE, None, self.TEXT),
            (self.START, True): ("", "", self.START) if fold_spaces else (lead, SPACE, self.TEXT),
            (self.TEXT, True): ("", "", self.GAP) if fold_spaces else ("", SPACE, self.TEXT),
            (self.GAP, True): ("", "", self.GAP),
        }
        #: States whose arcs lead back to them and write one character each.
        self.loops = {k for k in range(3) if self.arcs[k, False] == ("", None, k) and self.arcs[k, True] == ("", SPACE, k)}

    def composed(self, text: str, state: int = START) -> str:
        """The output side of the transducer composed with a text, read from a state."""
        if state in self.loops:
            return text.replace(" ", SPACE)
        out, arcs = [], self.arcs
        for char in text:
            before, own, state = arcs[state, char == " "]
            out += (before, char if own is None else own)
        return "".join(out)


class PieceTransducer:
    """Normaliser, pieces and byte fallback as weighted transducers, composed with a text; the cheapest path is its encoding.

    A state is a position and the piece that ends there. In a unigram model an arc costs the negated score of its
    piece. In a BPE model the arcs are those of the transducer of proper encodings: piece b may follow piece a only if
    merging the text of a and b gives back a and b, so that the arc costs nothing, and any other costs infinity; one
    path has a finite cost, and it is the encoding by merges. A character without a piece goes over its bytes. Both
    kinds of model take one path, found in the tropical semiring: costs add along a path, and the least cost into each
    position is kept.
    """

    def __init__(self, v: Vocabulary, bpe: bool | None = None):
        self.v, self.bpe = v, v.bpe if bpe is None else bpe
        self.normaliser = Normaliser(v.dummy_prefix, v.fold_spaces)
        self._free = len(v.text)
        self._pairs = Table(self._arc)
        self._piece = {i: p for p, i in v.ids.items()}
        self._sizes = {i: len(p) for p, i in v.ids.items()}
        self._spines: dict[int, tuple] = {}
        self._chars = {p for p in v.ids if len(p) == 1}
        self._least = 0.0 if self.bpe else -max(v.score)
        self._bytes = 0.0 if self.bpe else 10.0 - min(v.score)
        self.splitter = _BlankRuns(self)
        self._blanks = v.ids.get(SPACE * max((len(p) for p in v.ids if not p.strip(SPACE)), default=1), -1)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts that merging the best-scored neighbours, the first of equals first, leaves of a short text; the last two that merged."""
        ids, score, parts, last = self.v.ids, self.v.score, list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spine(self, piece: int) -> tuple | None:
        """The parts at the piece's left and at its right edge while it is merged, each with the score of its merge; None if merging its text doesn't give it."""
        found = self._spines.get(piece, 0)
        if found == 0:
            text = self._piece[piece]
            parts, last = self.merged(text)
            if len(parts) > 1:
                found = None
            elif last is None:
                found = ((text, math.inf),), ((text, math.inf),)
            else:
                own = (text, self.v.score[piece])
                found = (*self._spine(self.v.ids[last[0]])[0], own), (*self._spine(self.v.ids[last[1]])[1], own)
            self._spines[piece] = found
        return found

    def _arc(self, pair: int) -> float:
        """The weight of an arc from the first piece of a pair, or from none, to the second."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if not self.bpe:
            return -self.v.score[b]
        if a != self._free and not (self._piece[a] + self._piece[b]).strip(SPACE):
            return 0.0 if a == self._blanks else math.inf  # equal scores: blanks merge from the left into the longest piece
        return 0.0 if self._apart(a, b) else math.inf

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives a and b: no part at the edge of a ever merges across with one of b."""
        right = self._spine(b)
        if right is None:
            return False
        if a == self._free:
            return True
        left, right, ids, score = self._spine(a)[1], right[0], self.v.ids, self.v.score
        i, j, n, m = 0, 0, len(left) - 1, len(right) - 1
        while True:
            across = ids.get(left[i][0] + right[j][0])
            x, y = left[i + 1][1] if i < n else -math.inf, right[j + 1][1] if j < m else -math.inf
            if across is not None and score[across] > x and score[across] >= y:
                return False
            if i == n and j == m:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def shortest_path(self, normal: str) -> list[int]:
        """The ids along the cheapest path over a normalised text."""
        n, pairs, least = len(normal), self._pairs, self._least
        cost, last = [0.0] + [math.inf] * n, [self._free << 32] * (n + 1)
        odd = [] if self._chars.issuperset(normal) else [k for k, c in enumerate(normal) if c not in self._chars]  # have an arc over their bytes
        next_odd, done = odd[0] if odd else n, 0
        for at, (piece, size) in self.v.matches.iter(normal):
            end = at + 1
            start = end - size
            while next_odd < start:  # all arcs into the place before it are known by now
                self._over_bytes(next_odd, cost, last)
                done += 1
                next_odd = odd[done] if done < len(odd) else n
            best = cost[end]
            if cost[start] + least < best:
                total = cost[start] + pairs[last[start] | piece]
                if total < best:
                    cost[end], last[end] = total, piece << 32
        for k in odd[done:]:
            self._over_bytes(k, cost, last)
        out: list[int] = []
        while n:
            piece = last[n] >> 32
            if piece == self._free:
                out += self._fallback(normal[n - 1])
                n -= 1
            else:
                out.append(piece)
                n -= self._sizes[piece]
        return out[::-1]

    def _over_bytes(self, at: int, cost: list[float], last: list[int]) -> None:
        if cost[at] + self._bytes < cost[at + 1]:
            cost[at + 1], last[at + 1] = cost[at] + self._bytes, self._free << 32

    def _fallback(self, char: str) -> list[int]:
        v = self.v
        return [v.byte.get(b, v.unknown) for b in reversed(char.encode())] if v.byte else [v.unknown]

    def packed(self, token: str) -> bytes:
        """The ids of a pre-token inside a text, as bytes."""
        return array("i", self.shortest_path(self.normaliser.composed(token, Normaliser.TEXT))).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids of a whole text; none for null and empty ones."""
        if self.bpe and not self.v.inner_space:
            return np.frombuffer(b"".join(self.splitter.values(text or "")), np.int32)
        return np.array(self.shortest_path(self.normaliser.composed(text or "")), np.int32)


class _BlankRuns(Splitter):
    def __init__(self, t: PieceTransducer):
        super().__init__(t.v, t.packed)
        self.t = t

    def takes(self, word: str) -> bool:
        return self.t.shortest_path(word)[0] != self.v.ids.get(SPACE)


_loaded: dict[str, PieceTransducer] = {}


def transducer(data: bytes) -> PieceTransducer:
    """The transducer of a model file's bytes, one for each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceTransducer(Vocabulary(data))
    return _loaded[key]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, input_ids array<int>, n_tokens long, round_trip boolean) for each row of docs.

    The ids are those of the SentencePiece library for the same file. round_trip says whether decoding them gives the
    text as normalised with blanks for U+2581. Null and empty texts have no ids. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared.value)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            ends = np.cumsum([0] + [len(x) for x in ids])
            same = [_plain(t.v, x) == t.v.decoded(i) for x, i in zip(texts, ids)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "input_ids", "n_tokens", "round_trip"])

    return _texts(docs).mapInArrow(run, "doc_id long, input_ids array<int>, n_tokens long, round_trip boolean")


def _plain(v: Vocabulary, text: str | None) -> str:
    normal = v.normalised(text or "").replace(SPACE, " ")
    return normal[1:] if v.dummy_prefix and normal[:1] == " " else normal


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, input_ids); null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = transducer(shared.value).v
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.decoded(x or ()) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "input_ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """encode() with the SHA-256 of the ids as little-endian int32 in place of the ids."""
    rows = encode(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            out = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string()), batch.column(3)], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def _bytes(model: str) -> bytes:
    with open(model, "rb") as f:  # a vocabulary file on the driver, of a few hundred kilobytes; executors get its bytes
        return f.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class UnigramTrie:
    """Distinct pre-tokens in a trie whose nodes hold the best unigram score of their prefix and its number of tokens.

    A node's forward score is the best, over the pieces that end there, of the score before the piece plus the
    piece's own; of equal scores the one with fewer tokens counts. It is computed once, when the first pre-token with
    that prefix comes, and the count at a pre-token's last node is its number of tokens.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        # A BPE file stores ranks, not probabilities: its pieces get the log-probabilities of Zipf's law at their rank.
        self.score = v.score if not v.bpe else [-math.log(i + 2.0) for i in range(len(v.score))]
        self.unknown = min(self.score) - 10.0
        self._start()

    def _start(self) -> None:
        self.nodes: dict[tuple[int, str], int] = {}  # a node by its parent and the character that leads to it
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # score and tokens by node; 0 is the empty prefix

    def tokens(self, token: str) -> int:
        if len(token) > LONG:
            return self._long(token)
        if len(self.best) + len(token) > NODES:
            self._start()
        nodes, path = self.nodes, [0]
        for char in token:
            node = nodes.get((path[-1], char))
            if node is None:
                break
            path.append(node)
        known = len(path) - 1
        if known == len(token):
            return self.best[path[-1]][1]
        scores = [self.best[n] for n in path]
        for end, found in self._forward(token, known, scores.__getitem__):
            scores.append(found)
            nodes[path[-1], token[end - 1]] = len(self.best)
            path.append(len(self.best))
            self.best.append(found)
        return scores[-1][1]

    def _long(self, token: str) -> int:
        """The count of a token that gets no nodes: only the last scores that a piece can reach back to are held."""
        size = self.v.longest + 1
        ring = [(0.0, 0)] * size
        for end, found in self._forward(token, 0, lambda at: ring[at % size]):
            ring[end % size] = found
        return ring[len(token) % size][1]

    def _forward(self, token: str, known: int, before: Callable[[int], tuple[float, int]]) -> Iterator[tuple[int, tuple[float, int]]]:
        """(end, score and tokens) of each prefix longer than `known`; before gives those of shorter ones, as far back as a piece is long."""
        end, best, count = known + 1, -math.inf, 0
        for at, (piece, size) in self.v.matches.iter(token, max(0, known + 1 - self.v.longest)):
            if at < known:
                continue
            while end <= at:  # the first piece that ends here: what came before is whole
                yield end, self._closed(token, end, best, count, before)
                end, best, count = end + 1, -math.inf, 0
            score, n = before(at + 1 - size)
            s = score + self.score[piece]
            if s > best or s == best and n + 1 < count:
                best, count = s, n + 1
        while end <= len(token):
            yield end, self._closed(token, end, best, count, before)
            end, best, count = end + 1, -math.inf, 0

    def _closed(self, token: str, end: int, best: float, count: int, before: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """Score and tokens of a prefix; a last character that is no piece may go over its bytes."""
        char = token[end - 1]
        if char not in self.v.ids:
            size = len(char.encode()) if self.v.byte else 1
            score, n = before(end - 1)
            if score + self.unknown * size > best:
                best, count = score + self.unknown * size, n + size
        return best, count


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row: tokens of the unigram segmentation of its whole text.

    Pre-tokens are words with their leading blank, runs of blanks and of line ends. Each Python worker keeps one trie
    and one table of terminal counts, both bounded. Null and empty texts have 0 tokens; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie(transducer(shared.value).v)
        split = Splitter(trie.v, trie.tokens)
        for batch in slices(batches):
            counts = [split.values(t or "") for t in batch.column(1).to_pylist()]
            totals = [sum(c) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array([len(c) for c in counts], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
