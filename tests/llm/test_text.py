"""SentencePiece (3), decontamination (5), token counts (9) and the pipeline."""

from __future__ import annotations

import copy
import math
from collections import Counter

import edge
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from meterflow.llm import common, decontaminate, pieces, queries, simhash

ODD = [*edge.TEXTS, "  two  blanks ", "tab\tand\nline\n\n end ", "▁ raw mark", "😀 emoji\u0000 nul", "a" * 300, "日本語のテキスト", " " * 40, "mixed  ▁▁ x", "don't stop!!! 3.14"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def test_encoding_is_the_library_s(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    for df, n in ((docs, docs.count()), (edge.frame(spark, ODD).select("doc_id", "text"), len(ODD) + 2)):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = pieces.encode(df).collect()
        assert len(got) == n
        key = lambda i, ids: (-1 if i is None else i, tuple(ids))
        assert Counter(key(r["doc_id"], r["input_ids"]) for r in got) == Counter(key(i, sp.encode(t or "")) for i, t in texts)
        assert all(r["n_tokens"] == len(r["input_ids"]) for r in got)


def test_round_trip(spark, vocabulary):
    docs = edge.frame(spark, ODD)
    encoded = pieces.encode(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).where("doc_id is not null").collect()}
    for n, t in enumerate(ODD):
        assert back[n] == pieces._plain(vocabulary, t)
    assert encoded.where("round_trip").count() == docs.count()
    assert pieces.encode(edge.empty(spark)).count() == 0


def test_path_is_the_cheapest_of_all(vocabulary):
    """Both kinds of arcs against every path over pieces and bytes."""
    for bpe in (False, True):
        t = pieces.PieceTransducer(vocabulary, bpe)
        for token in ("▁hello", "▁there", "abc", "▁ab", "▁▁▁", "a漢b", "xx▁▁"):
            every = []

            def walk(at, ids, last, cost, token=token, every=every, t=t):
                if at == len(token):
                    every.append((cost, ids))
                for end in range(at + 1, len(token) + 1):
                    piece = vocabulary.ids.get(token[at:end])
                    if piece is not None:
                        walk(end, [*ids, piece], piece, cost + t._arc(last << 32 | piece))
                    elif end == at + 1:
                        walk(end, [*ids, *(vocabulary.byte[b] for b in token[at].encode())], t._free, cost + t._bytes)

            walk(0, [], t._free, 0.0)
            least = min(c for c, _ in every)
            assert t.shortest_path(token) in [ids for c, ids in every if math.isclose(c, least, abs_tol=1e-9)]
            if bpe:
                assert sum(math.isfinite(c) for c, _ in every) == 1


def test_normaliser_composes_like_its_runs(vocabulary):
    v = copy.copy(vocabulary)
    for v.dummy_prefix in (True, False):
        for v.fold_spaces in (True, False):
            n = pieces.Normaliser(v.dummy_prefix, v.fold_spaces)
            for t in [*ODD, "  a  b ", " ", "   ", "a", " \n a"]:
                assert n.composed(t or "") == v.normalised(t or "")


def plain_count(trie, token):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        found = []
        for start in range(end):
            i = trie.v.ids.get(token[start:end])
            if i is not None:
                found.append((best[start][0] + trie.score[i], -best[start][1] - 1))
        if token[end - 1] not in trie.v.ids:
            n = len(token[end - 1].encode())
            found.append((best[end - 1][0] + n * trie.unknown, -best[end - 1][1] - n))
        score, count = max(found)
        best[end] = score, -count
    return best[-1][1]


def test_token_counts(spark, vocabulary):
    trie = pieces.UnigramTrie(vocabulary)
    for t in ODD:
        split = pieces.Splitter(vocabulary, lambda w: w)
        for w in set(split.values(t or "")):
            if len(w) < 80:
                assert trie.tokens(w) == plain_count(trie, w), w
    docs = edge.frame(spark, ODD)
    got = pieces.token_counts(docs)
    assert got.count() == docs.count()
    counts = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in got.where("doc_id is not null").collect()}
    assert counts[1] == counts[2] == (0, 0)
    split = pieces.Splitter(vocabulary, lambda w: w)
    for n, t in enumerate(ODD[:6]):
        assert counts[n][0] == sum(plain_count(trie, w) for w in split.values(t or ""))
    assert pieces.token_counts(edge.empty(spark)).count() == 0


def test_token_counts_of_long_runs(vocabulary, monkeypatch):
    import tracemalloc

    trie, rng = pieces.UnigramTrie(vocabulary), np.random.default_rng(6)
    odd = ["".join(rng.choice(list("theinga日é"), n)) for n in (5, 60, 150, 299)]
    expected = [plain_count(trie, w) for w in odd]
    assert [trie.tokens(w) for w in odd] == [trie.tokens(w) for w in odd] == expected
    assert [trie._long(w) for w in odd] == expected
    monkeypatch.setattr(pieces, "NODES", 100)
    assert [trie.tokens(w) for w in odd] == expected
    runs = ["".join(rng.choice(list("abcdefghij日本語"), n)) for n in (20_000, 20_000, 200_000)]
    tracemalloc.start()
    assert all(0 < trie.tokens(w) <= 3 * len(w) for w in runs)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def plain_tiles(document, item, shortest):
    """Greedy string tiling by comparing every pair of places."""
    shortest = min(shortest, len(item)) or 1
    used_d, used_t, total = set(), set(), 0
    while True:
        longest, found = 0, None
        for j in range(len(item)):
            for i in range(len(document)):
                n = 0
                while i + n < len(document) and j + n < len(item) and document[i + n] == item[j + n] and i + n not in used_d and j + n not in used_t:
                    n += 1
                if n > longest:
                    longest, found = n, (i, j)
        if longest < shortest:
            return total
        used_d.update(range(found[0], found[0] + longest))
        used_t.update(range(found[1], found[1] + longest))
        total += longest


def test_tiles_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(120):
        item = [f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 16))]
        document = [f"w{x}" for x in rng.integers(0, 7, rng.integers(0, 40))]
        for shortest in (2, 3, 5):
            assert decontaminate.covered(document, item, shortest) == plain_tiles(document, item, shortest) / len(item)


ITEM = "Which of these nine rivers flows north past the old stone mill before it reaches the inland sea near Port Hale?"


def leak_cases():
    w = ITEM.split()
    reordered = " ".join(w[10:] + ["meanwhile"] + w[:10])
    return [f"before {ITEM} after", reordered, ITEM.upper().replace(" ", ",  "), " ".join(w[:11]), "nothing of the kind at all here", None, "", "short one", *edge.TEXTS]


def test_leaks(spark, monkeypatch):
    docs = edge.frame(spark, leak_cases())
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string")
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    expected = []
    for r in docs.collect():
        for i in items.collect():
            own, item = decontaminate.words_of(r["text"]), decontaminate.words_of(i["text"])
            share = plain_tiles(own, item, 5) / len(item) if item and len(own) < 400 else 0.0
            if share >= 0.8:
                expected.append((-1 if r["doc_id"] is None else r["doc_id"], i["item_id"], round(share, 9)))
    shape = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in df.collect())
    assert {e[0] for e in expected} >= {0, 1, 2, 7}
    assert shape(decontaminate.leaks(docs, items)) == sorted(expected)
    for limit in (decontaminate.FILTER_BYTES, 0):
        monkeypatch.setattr(decontaminate, "FILTER_BYTES", limit)
        joined = decontaminate._leaks_joined(docs.select("doc_id", "text"), texts, 0.8, 5)
        assert set(shape(joined)) == set(expected)
    named = docs.withColumns({c: F.lit(c) for c in ("leak_key", "key", "row", "item")})
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        clean = decontaminate.drop_leaks(named, items)
        assert clean.columns == named.columns and {tuple(r)[-4:] for r in clean.collect()} == {("leak_key", "key", "row", "item")}
        assert {r["doc_id"] for r in clean.where("doc_id is not null").collect()} == set(range(len(leak_cases()))) - {e[0] for e in expected}
    assert decontaminate.leaks(edge.empty(spark), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_leaks_by_join_are_those_by_broadcast(spark, sf_dir):
    docs, items = (common.table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    shared = " and this is a phrase that all of them have in common"
    items = items.withColumn("text", F.concat("text", F.when(F.col("item_id") % 2 == 0, F.lit(shared)).otherwise(F.lit(""))))
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(shared)))).select("doc_id", "text")
    shape = lambda df: {(r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in df.collect()}
    expected = shape(decontaminate.leaks(docs, items, 0.6))
    assert expected and shape(decontaminate._leaks_joined(docs, items.select("item_id", "text"), 0.6, 5)) == expected


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    docs = common.table(spark, sf_dir, "documents")
    benchmark = common.table(spark, sf_dir, "benchmark").collect()
    stages = [f for _, f in corpus_pipeline.STAGES]
    calm = common.checkpointed(stages[0](spark, docs, sf_dir))
    assert calm.columns == docs.columns and 0.8 * docs.count() <= calm.count() <= docs.count()
    cut = common.checkpointed(stages[1](spark, calm, sf_dir))
    assert cut.count() == calm.count() and cut.where("n_chars <> length(text)").count() == 0
    unique = common.checkpointed(stages[2](spark, cut, sf_dir))
    prints = {r["doc_id"]: simhash.fingerprint(r["text"], 5) for r in unique.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() > 3 for a in prints for b in prints if a < b)
    clean = common.checkpointed(stages[3](spark, unique, sf_dir))
    kept = {r["doc_id"] for r in clean.collect()}
    words = [w for w in (decontaminate.words_of(b["text"]) for b in benchmark) if w]
    leaking = {r["doc_id"] for r in unique.collect() if any(decontaminate.covered(decontaminate.words_of(r["text"]), w) >= 0.8 for w in words)}
    assert kept == set(prints) - leaking
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    expected = {r["doc_id"]: sp.encode(r["text"]) for r in clean.collect()}
    assert {r["doc_id"]: list(r["input_ids"]) for r in queries.queries()["pipeline"](spark, sf_dir).collect()} == expected


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, columns that clash with those of the stages, and tables without rows."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, n_lines int, row string, own long, N_Dropped string"
    prose = [" ".join(f"w{(n * 31 + k * k) % 997}" for k in range(60)) for n in range(12)]
    rows = [(n, t, "en", None, 1, n, "r", 5, "x") for n, t in enumerate([*prose, None, "", "  \n\t", prose[0]])]
    rows += [rows[1], (None, prose[2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    marks = [(n, 1, int(n % 2)) for n in range(6)]
    for name, few in (("full", False), ("none", True)):
        tables = {"documents": spark.createDataFrame(rows[:0] if few else rows, schema), "labels": spark.createDataFrame(marks[:0] if few else marks, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([] if few else [(1, prose[5]), (2, None)], "item_id long, text string")}
        for t, df in tables.items():
            df.write.parquet(str(tmp_path / name / f"{t}.parquet"))
    docs = common.table(spark, str(tmp_path / "full"), "documents")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path / "full"))
        assert out.columns == docs.columns and {r["N_Dropped"] for r in out.collect()} <= {"x", None}
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path / "full")).collect()
    texts = [r["text"] for r in out if r["doc_id"] is not None]
    assert sum(t == prose[0] for t in texts) == 1 and sum(t == prose[1] for t in texts) == 1 and prose[5] in texts
    assert prose[5] not in [r["text"] for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path / "full")).collect()]
    assert all(r["round_trip"] is not None for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
