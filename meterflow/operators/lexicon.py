"""Reading by a lexicon: how well each of its strings explains a recogniser's per-step probabilities, and which group that speaks for.

A matrix is array<array<float>>: for each step the log-probability of each symbol; `blank` is the index of no symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_text(matrix: Column, alphabet: str, blank: int) -> Column:
    """The likeliest symbol of each step (the first of equals) without repeats and blanks."""
    steps = F.transform(matrix, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    fresh = F.filter(F.transform(steps, lambda s, i: F.when((s != blank) & ((i == 0) | (s != F.get(steps, i - 1))), s)), lambda s: s.isNotNull())
    return F.concat_ws("", F.transform(fresh, lambda s: F.substring(F.lit(alphabet), s + 1, F.lit(1))))


def ctc_scores(matrices: list[np.ndarray], texts: list[str], alphabet: str, blank: int) -> np.ndarray:
    """log P(text) under each matrix, summed over all alignments: one forward pass for all rows at once.

    Texts that no alignment of so many steps can give have minus infinity.
    """
    n = len(texts)
    out = np.full(n, -np.inf)
    if not n:
        return out
    place = {c: k for k, c in enumerate(alphabet)}
    steps, size = np.array([len(m) for m in matrices]), np.array([2 * len(t) + 1 for t in texts])
    labels = np.full((n, size.max()), blank)
    for k, t in enumerate(texts):
        labels[k, 1 : 2 * len(t) : 2] = [place[c] for c in t]
    rows = np.arange(n)
    padded = np.zeros((n, max(steps.max(), 1), len(alphabet) + 1))
    for k, m in enumerate(matrices):
        padded[k, : len(m)] = m
    skip = np.zeros(labels.shape, bool)  # a label may follow the one before the last blank unless they are equal
    skip[:, 2:] = (labels[:, 2:] != blank) & (labels[:, 2:] != labels[:, :-2])
    alpha = np.full(labels.shape, -np.inf)
    with np.errstate(divide="ignore"):
        for t in range(steps.max()):
            live = t < steps
            now = padded[rows[:, None], t, labels]
            if t == 0:
                new = np.full(labels.shape, -np.inf)
                new[:, :2] = now[:, :2]
            else:
                one, two = np.full(labels.shape, -np.inf), np.full(labels.shape, -np.inf)
                one[:, 1:], two[:, 2:] = alpha[:, :-1], alpha[:, :-2]
                new = np.logaddexp(np.logaddexp(alpha, one), np.where(skip, two, -np.inf)) + now
            alpha = np.where(live[:, None], new, alpha)
    last = alpha[rows, size - 1]
    before = np.where(size > 1, alpha[rows, np.maximum(size - 2, 0)], -np.inf)
    return np.where(steps > 0, np.logaddexp(last, before), np.where(size == 1, 0.0, -np.inf))


class Trie:
    """Distinct strings over an alphabet as a prefix tree, so that strings share the forward scores of their prefixes.

    Nodes are numbered level by level; 0 is the empty prefix. `of` is the node of each string.
    """

    def __init__(self, strings: list[str], alphabet: str):
        place = {c: k for k, c in enumerate(alphabet)}
        nodes: dict[tuple[int, int], int] = {}
        parent, label, self.of = [0], [-1], np.zeros(len(strings), np.int64)
        at = [0] * len(strings)
        for depth in range(max(map(len, strings), default=0)):
            for k, s in enumerate(strings):
                if depth < len(s):
                    key = at[k], place[s[depth]]
                    if key not in nodes:
                        nodes[key] = len(parent)
                        parent.append(key[0])
                        label.append(key[1])
                    at[k] = nodes[key]
        self.of[:] = at
        self.parent, self.label = np.array(parent), np.array(label)
        self.repeats = self.label == self.label[self.parent]

    def scores(self, matrices: np.ndarray, blank: int) -> np.ndarray:
        """log P(string) for each string (rows) under each of the matrices (images, steps, symbols), summed over all alignments.

        For each prefix the sums of the alignments that end in its last symbol and in a blank are carried from step to
        step for all images at once. They are carried as probabilities, by each step's greatest, for images where no
        alignment's can leave the range of doubles, else as logarithms.
        """
        images, steps, width = matrices.shape
        peak = matrices.max(axis=2)
        least = np.where(np.isneginf(matrices), np.inf, matrices).min(axis=2)
        plain = np.isfinite(peak).all(axis=1) & ((peak - least).sum(axis=1, where=np.isfinite(peak)) < RANGE) & (steps * np.log(width) < RANGE)
        out = np.empty((len(self.of), images))
        if plain.any():
            some = np.exp(matrices[plain] - peak[plain][:, :, None])
            with np.errstate(divide="ignore"):
                out[:, plain] = np.log(self._forward(some, blank, np.add, np.multiply, 0.0, 1.0)[self.of]) + peak[plain].sum(axis=1)
        if not plain.all():
            out[:, ~plain] = self._forward(matrices[~plain], blank, np.logaddexp, np.add, -np.inf, 0.0)[self.of]
        return out

    def _forward(self, matrices: np.ndarray, blank: int, plus: np.ufunc, times: np.ufunc, none: float, one: float) -> np.ndarray:
        """The sums of all prefixes (rows) under the matrices, whose cells are added up by `plus` and multiplied by `times`."""
        cells = np.ascontiguousarray(matrices.transpose(1, 2, 0))
        symbol, rest = np.full((len(self.parent), len(matrices)), none), np.full((len(self.parent), len(matrices)), none)
        rest[0] = one
        again = np.flatnonzero(self.repeats)
        for step in cells:
            ended = plus(rest, symbol)
            come = ended[self.parent]
            come[again] = rest[self.parent[again]]
            symbol = times(plus(symbol, come), step[self.label])
            symbol[0] = none
            rest = times(ended, step[blank])
        return plus(rest, symbol)


#: Bytes of a lexicon that are broadcast, strings of a chunk of a larger one, cells of a table of forward scores, images of
#: a task, and how far logarithms may lie apart in doubles.
BROADCAST_BYTES, CHUNK, CELLS, IMAGES, RANGE = 16 << 20, 20_000, 1 << 18, 1024, 700.0


class _Lexicon:
    """Sets of strings (strings, groups, n), ready to score images: each set's n groups have the same score; the first are named."""

    def __init__(self, sets: list[tuple[list[str], list[str], int]], alphabet: str):
        sets = sorted((list(groups), sorted(strings), n) for strings, groups, n in sets)
        self.strings = sorted({s for _, strings, _ in sets for s in strings})
        place = {s: k for k, s in enumerate(self.strings)}
        self.groups = [groups for groups, _, _ in sets]
        self.weight = np.log([n for _, _, n in sets])
        self.size = np.array([len(strings) for _, strings, _ in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.member = np.array([place[s] for _, strings, _ in sets for s in strings], np.int64)
        self.lengths = np.array([len(s) for s in self.strings])
        self.trie = Trie(self.strings, alphabet)

    def best(self, matrices: list[np.ndarray], greedy: list[str], blank: int, window: int | None, top: int) -> list[list[tuple]]:
        """For each image its first `top` groups with their likeliest strings and log-sums, and a row (null, null, log-sum of all groups)."""
        size = np.array([len(m) for m in matrices])
        out: list = [[] for _ in matrices]
        for steps in np.unique(size) if self.groups else []:
            same = np.flatnonzero(size == steps)
            per = max(1, CELLS // len(self.trie.parent))
            for at in range(0, len(same), per):
                some = same[at : at + per]
                ll = self.trie.scores(np.stack([matrices[k] for k in some]).reshape(len(some), steps, -1), blank)
                for k, own in zip(some, np.ascontiguousarray(ll.T)):
                    if window is not None and greedy[k]:
                        own = np.where(np.abs(self.lengths - len(greedy[k])) <= window, own, -np.inf)
                    out[k] = self._ranked(own[self.member], top)
        return out

    def _ranked(self, own: np.ndarray, top: int) -> list[tuple]:
        peak = np.maximum.reduceat(own, self.first)
        shift = np.where(peak > -np.inf, peak, 0.0)
        with np.errstate(divide="ignore"):
            total = np.log(np.add.reduceat(np.exp(own - np.repeat(shift, self.size)), self.first)) + shift
        if total.max() == -np.inf:
            return []
        least = np.partition(total, -top)[-top] if top < len(total) else -np.inf
        sets = np.flatnonzero((total >= least) & (total > -np.inf))
        named = sorted((-total[k], group, k) for k in sets for group in self.groups[k])[:top]
        at = {k: self.member[self.first[k] + own[self.first[k] : self.first[k] + self.size[k]].argmax()] for _, _, k in named}
        every = total + self.weight
        return [(group, self.strings[at[k]], float(-g)) for g, group, k in named] + [(None, None, float(every.max() + np.log(np.exp(every - every.max()).sum())))]


def string_sets(members: DataFrame, top: int) -> DataFrame:
    """(strings, groups, n): each set of strings that groups of members (group, string) have, its first `top` groups and how many have it."""
    own = members.groupBy("group").agg(F.array_sort(F.collect_set("string")).alias("strings"))
    place = F.row_number().over(Window.partitionBy("strings").orderBy("group"))
    first = own.withColumn("place", place).where(F.col("place") <= top).groupBy("strings").agg(F.array_sort(F.collect_list("group")).alias("groups"))
    return own.groupBy("strings").agg(F.count(F.lit(1)).alias("n")).join(first, "strings").select("strings", "groups", "n")


def lexicon_matches(images: DataFrame, lexicon: DataFrame, alphabet: str, blank: int, oov: float = 0.05, top: int = 3, window: int | None = None) -> DataFrame:
    """(image, greedy, group, string, share, place): the `top` groups of each image (image, matrix) by their share.

    lexicon: (group, string). All strings are scored; with `window` only those whose length is within it of the greedy
    reading's, all again where that is empty. A group's score is the log-sum of its strings, and its share is taken
    over all groups and, where the greedy reading is not in the lexicon, over that reading too with weight `oov`. Groups
    that no alignment can give are left out; an image of which nothing can be scored has one row of nulls. Groups with
    the same strings have the same score, which is computed once for all of them. Images are dealt to tasks by their
    number and scored there, against a lexicon that is broadcast while its sets have at most BROADCAST_BYTES; chunks of
    a larger one meet blocks of images.
    """
    tasks = max(1, -(-images.count() // IMAGES))
    read = images.repartition(tasks, "image").withColumn("greedy", greedy_text(F.col("matrix"), alphabet, blank)).select("image", "greedy", F.flatten("matrix").alias("matrix"))
    members = lexicon.where("string <> '' and group is not null").select(F.col("group").cast("string").alias("group"), "string")
    sets = string_sets(members.where(F.translate("string", alphabet, "") == ""), top)
    bytes_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    size, strings = (x or 0 for x in sets.agg(F.sum(bytes_of("strings") + bytes_of("groups")), F.sum(F.size("strings"))).first())
    width = len(alphabet) + 1
    found = "struct<group string, string string, g double>"

    def rows_of(matrix: pd.Series) -> list[np.ndarray]:
        return [np.asarray(m if m is not None else [], float).reshape(-1, width) for m in matrix]

    if size <= BROADCAST_BYTES:
        shared = images.sparkSession.sparkContext.broadcast([(r["strings"], r["groups"], r["n"]) for r in sets.collect()])

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            own = _Lexicon(shared.value, alphabet)
            for matrix, greedy in batches:
                yield pd.Series(own.best(rows_of(matrix), list(greedy), blank, window, top))

        groups = read.withColumn("found", F.pandas_udf(run, f"array<{found}>")("matrix", "greedy"))
        groups = groups.select("image", "greedy", "matrix", F.filter("found", lambda x: x["group"].isNotNull()).alias("best"), F.get(F.filter("found", lambda x: x["group"].isNull()), F.lit(0))["g"].alias("all"))
    else:
        chunks = -(-strings // CHUNK)

        def meet(images: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
            own = _Lexicon(list(zip(sets["strings"], sets["groups"], sets["n"])), alphabet)
            best = own.best(rows_of(images["matrix"]), list(images["greedy"]), blank, window, top)
            return pd.DataFrame([(k, *x) for k, found in zip(images["image"], best) for x in found], columns=["image", "group", "string", "g"])

        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("long")
        blocks = read.withColumn("block", deal("image", tasks)).withColumn("part", each(chunks)).repartition(tasks * chunks, "part", "block")
        parts = sets.withColumn("part", deal("strings", chunks)).withColumn("block", each(tasks)).repartition(tasks * chunks, "part", "block")
        image = images.schema["image"].dataType.simpleString()
        rows = blocks.groupBy("part", "block").cogroup(parts.groupBy("part", "block")).applyInPandas(meet, f"image {image}, group string, string string, g double")
        named = F.when(F.col("group").isNotNull(), F.struct((-F.col("g")).alias("g"), "group", "string"))
        by = rows.groupBy("image").agg(F.array_sort(F.collect_list(named)).alias("a"), F.collect_list(F.when(F.col("group").isNull(), F.col("g"))).alias("sums"))
        peak = F.array_max("sums")
        total = peak + F.log(F.aggregate("sums", F.lit(0.0), lambda t, x: t + F.exp(x - peak)))
        best = F.transform(F.slice("a", 1, top), lambda x: F.struct(x["group"].alias("group"), x["string"].alias("string"), (-x["g"]).alias("g")))
        groups = read.join(by.select("image", best.alias("best"), total.alias("all")), "image", "left")

    def alone(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for matrix, greedy in batches:
            yield pd.Series(ctc_scores(rows_of(matrix), [g or "" for g in greedy], alphabet, blank))

    groups = groups.join(members.select(F.col("string").alias("greedy"), F.lit(True).alias("listed")).distinct(), "greedy", "left")
    reading = F.when(F.col("listed").isNull() & F.lit(oov > 0), F.pandas_udf(alone, "double")("matrix", "greedy") + float(np.log(oov)) if oov > 0 else F.lit(None))
    groups = groups.withColumn("own", reading)
    peak = F.greatest(F.coalesce("all", F.lit(float("-inf"))), F.coalesce("own", F.lit(float("-inf"))))
    norm = peak + F.log(F.coalesce(F.exp(F.col("all") - peak), F.lit(0.0)) + F.coalesce(F.exp(F.col("own") - peak), F.lit(0.0)))
    groups = groups.withColumn("norm", F.when(peak > float("-inf"), norm)).select("image", "greedy", "norm", F.posexplode_outer("best").alias("at", "x"))
    share = F.exp(F.col("x.g") - F.col("norm"))
    return groups.select("image", "greedy", F.col("x.group").alias("group"), F.col("x.string").alias("string"), share.alias("share"), (F.col("at") + 1).cast("int").alias("place"))
