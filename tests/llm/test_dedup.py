"""Line dedup (2), embeddings (6), SimHash (7) and substrings (8): against SQL and brute force, odd rows, skew."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import edge
import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from meterflow.llm import components, lines, projections, queries, simhash, sql, substrings


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, sf_dir, name):
    columns, rows = oracle.of_spark(queries.queries()[name](spark, sf_dir))
    assert (columns, rows) == oracle.of_sql(sf_dir, sql.ORACLES[name])


def lowest(links, nodes):
    """The smallest node reachable from each, by plain search."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        stack, out[n] = [n], n
        while stack:
            for m in near[stack.pop()]:
                if m not in out:
                    out[m] = n
                    stack.append(m)
    return out


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    expected = lowest(links, {x for ab in links if ab[0] != ab[1] for x in ab})
    assert got == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(texts, least):
    counts = defaultdict(int)
    for t in texts:
        for k in {lines.line_key(x) for x in (t or "").encode().split(b"\n")} - {b""}:
            counts[k] += 1
    out = []
    for t in texts:
        own = (t or "").encode().split(b"\n")
        kept = [x for x in own if counts.get(lines.line_key(x), 0) < least]
        out.append((b"\n".join(kept).decode(), len(own), len(own) - len(kept)))
    return sorted(out)


def test_lines_of_odd_rows(spark, monkeypatch):
    texts = [*edge.TEXTS, "A\nb\n\n", " a\t\nB", "a\nc", "\x0ba\x0c\n\xa0a"]
    docs = edge.frame(spark, texts)
    got = lines.drop_lines(docs, lines.LineIndex.build(docs, 3))
    assert set(docs.columns) <= set(got.columns)
    all_texts = [r["text"] for r in docs.collect()]
    assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == plain_lines(all_texts, 3)
    clashing = docs.withColumns({c: F.lit(c) for c in ("gone", "row", "id", "key")})
    for share in (lines.HOT_SHARE, 1.0):
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        joined = lines._drop_joined(clashing.drop("n_lines").fillna({"text": ""}), lines.LineIndex.build(docs, 3))
        assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in joined.collect()) == plain_lines(all_texts, 3)
        assert {(r["gone"], r["row"], r["id"], r["key"]) for r in joined.collect()} == {("gone", "row", "id", "key")}
    none = edge.empty(spark)
    assert lines.drop_lines(none, lines.LineIndex.build(none)).count() == 0


def test_line_index_is_reversible(spark):
    first = spark.createDataFrame([(k, f"common\nown {k}") for k in range(12)], "doc_id long, text string")
    more = spark.createDataFrame([(k, "common\nrare\nlate") for k in range(20, 32)], "doc_id long, text string")
    state = lambda i: ({bytes(r["key"]) for r in i.frequent().collect()}, {tuple(r) for r in i.counts.collect()})
    index = lines.LineIndex.build(first, 10)
    grown = index.insert(more)
    assert state(grown) == state(lines.LineIndex.build(first.unionAll(more), 10))
    back = grown.delete(more)
    assert state(back) == state(index)
    cut = lambda i: [r["n_dropped"] for r in lines.drop_lines(more, i).collect()]
    assert cut(grown) == [3] * 12 and cut(back) == [1] * 12


def test_line_index_grows_and_shrinks_like_a_new_one(spark, monkeypatch):
    """From an empty table by 50,000 keys, of which half go: shards split, full filters are built anew, no member is lost."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 4096)
    text = lambda low, high: "\n".join(f"line {k}" for k in range(low, high))
    docs = lambda *bounds: spark.createDataFrame([(n, text(*b)) for n, b in enumerate(bounds) for _ in range(2)], "doc_id long, text string")
    index = lines.LineIndex.build(docs((0, 5)).limit(0), 2).insert(docs((0, 5))).insert(docs((5, 3000), (3000, 25_000)))
    grown = index.insert(docs((25_000, 50_000)))
    assert grown.shards > index.shards > 1
    back = grown.delete(docs((25_000, 50_000)))
    for got, low, high in ((grown, 0, 50_000), (back, 0, 25_000)):
        new = lines.LineIndex.build(docs((low, high)), 2)
        rows = docs((0, 50_000), (60_000, 70_000))  # also lines that the index has never seen
        dropped = {(r["doc_id"], r["n_dropped"]) for r in lines.drop_lines(rows, got).collect()}
        assert dropped == {(r["doc_id"], r["n_dropped"]) for r in lines.drop_lines(rows, new).collect()} == {(0, high), (1, 0)}
        members = sum(int((lines.CuckooFilter.load(bytes(r["state"])).table != 0).sum()) for r in got.filters.collect())
        assert members == high


def test_stash_counts_equal_entries():
    f, keys = lines.CuckooFilter(16), np.random.default_rng(8).integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    f.insert(keys)
    f = lines.CuckooFilter.load(f.state())
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all()
    f.delete(keys[10_000:])
    assert not f.stash and not f.table.any()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    f = lines.CuckooFilter.sized(2500)
    f.insert(keys[:2500])
    f = lines.CuckooFilter.load(f.state())
    assert f.contains(keys[:2500]).all() and f.contains(keys[2500:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.contains(keys[1000:2500]).all() and f.contains(keys[:1000]).mean() < 0.01
    full = lines.CuckooFilter(16)
    full.insert(keys[:200])  # more than its places: the stash takes the rest
    assert full.contains(keys[:200]).all() and lines.CuckooFilter.load(full.state()).contains(keys[:200]).all()


def plain_fingerprint(text, k):
    words = [w for w in bytes((text or "").encode()).lower().split() if w]
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark):
    for k in (3, 5):
        for t in edge.TEXTS:
            assert simhash.fingerprint(t, k) == plain_fingerprint(t, k)


def test_simhash_components(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 90, 300)) for _ in range(25)]
    near = [t + f" end{n}" for t in base[:15] for n in range(4)]
    texts = [*edge.TEXTS, *base, *near]
    docs = edge.frame(spark, texts)
    own = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.where("doc_id is not null").collect()}
    links = [(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 3]
    expected = lowest(links, own)
    assert len({expected[n] for n in own}) < len(own) - 10
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    kept = simhash.near_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(expected.values()))
    assert simhash.simhash_components(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("keep", [simhash.near_unique, simhash.near_similar])
@pytest.mark.parametrize("limit", [simhash.FILTER_BYTES, 0])
def test_one_row_of_each_class_by_its_own_text(spark, monkeypatch, keep, limit):
    monkeypatch.setattr(simhash, "FILTER_BYTES", limit)
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    rows = [(1, a, "z"), (1, b, "y"), (2, a, "x"), (None, a, "w"), (None, c, "v"), (None, c, "u"), (3, None, "t"), (1, b, "s"), (4, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key` string").withColumns({n: F.lit(n) for n in ("row", "c", "id", "n")})
    got = keep(docs)
    assert got.columns == docs.columns and {(r["row"], r["c"], r["id"], r["n"]) for r in got.collect()} == {("row", "c", "id", "n")}
    kept = sorted(((r["doc_id"], r["text"], r["key"]) for r in got.collect()), key=repr)
    assert kept == sorted([(1, a, "z"), (1, b, "s"), (None, c, "u"), (3, None, "t")], key=repr)


def test_rows_without_id_link(spark):
    """A fingerprint that only a row without id has joins two others that are too far apart."""
    rng = np.random.default_rng(13)
    while True:
        words = [f"w{n}" for n in rng.integers(0, 10_000, 200)]
        texts = [" ".join(words[k : k + 190]) for k in (0, 4, 8)]
        fp = [simhash.fingerprint(t) for t in texts]
        near, other, ends = (fp[0] ^ fp[1]).bit_count(), (fp[1] ^ fp[2]).bit_count(), (fp[0] ^ fp[2]).bit_count()
        if max(near, other) < ends:
            break
    docs = spark.createDataFrame([(5, texts[0]), (None, texts[1]), (9, texts[2])], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_components(docs, bits=max(near, other)).collect()} == {5}
    assert {r["component_id"] for r in simhash.simhash_components(docs.where("doc_id > 0"), bits=max(near, other)).collect()} == {5, 9}


def test_pivots_lose_no_pair_and_big_groups_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 6)
    flips = [int(sum(1 << int(b) for b in rng.choice(63, 2, replace=False))) for _ in range(40)]
    prints = sorted({int(c) ^ f for c in centre for f in [0, *flips]})
    monkeypatch.setattr(simhash, "GROUP", 16)
    df = spark.createDataFrame([(p, n) for n, p in enumerate(prints)], "fp long, id long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, 3).collect()]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert lowest(found, range(len(prints))) == lowest(near, range(len(prints)))


def plain_shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_similar_components_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (6, 8, 14, 40, 90, 200, 200, 300, 300, 400)]
    changed = []
    for words in base:
        for edits in range(1, 7):  # scattered edits: similarities on both sides of 0.8, many bits apart
            w = list(words)
            for at in rng.integers(0, len(w), edits * max(1, len(w) // 120)):
                w[at] = f"new{rng.integers(1 << 30)}"
            changed.append(w)
    texts = [*edge.TEXTS, *(" ".join(w) for w in base + changed)]
    docs = edge.frame(spark, texts)
    own = {r["doc_id"]: plain_shingles(r["text"]) for r in docs.where("doc_id is not null").collect()}
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    links = [(a, b) for a in own for b in own if a < b and alike(own[a], own[b])]
    assert any((simhash.fingerprint(texts[a], 5) ^ simhash.fingerprint(texts[b], 5)).bit_count() > 3 for a, b in links)
    expected = lowest(links, own)
    for group in (simhash.GROUP, 4):
        monkeypatch.setattr(simhash, "GROUP", group)
        got = simhash.similar_components(docs).collect()
        assert len(got) == docs.count()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert sorted(r["doc_id"] for r in simhash.near_similar(docs).where("doc_id is not null").collect()) == sorted(set(expected.values()))
    assert simhash.similar_components(edge.empty(spark)).count() == 0


def test_exact_search_of_sets():
    rng = np.random.default_rng(17)
    base = [rng.integers(0, 1 << 40, 60) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(x, 56, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 9))])) for x in base for _ in range(15)] + [np.zeros(0, np.int64)] * 2
    a, b = simhash.alike(sets, 0.8)
    own = [set(x.tolist()) for x in sets]
    near = {(i, j) for i in range(len(own)) for j in range(len(own)) if i != j and (own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]))}
    assert set(zip(a.tolist(), b.tolist())) <= near and len(a) < len(sets)
    assert lowest(zip(a.tolist(), b.tolist()), range(len(sets))) == lowest(near, range(len(sets)))


def test_signatures_of_similar_sets_lie_within_the_radius():
    rng = np.random.default_rng(12)
    for n in (9, 18, 90, 450):
        for _ in range(200):
            h = rng.integers(0, 1 << 64, n + n // 9, dtype=np.uint64)
            x, y = h[:n], h[n // 9 :]  # similarity 0.8
            a, b = (simhash.signature(np.sort(z)) for z in (x, y))
            away = [(p ^ q).bit_count() for p, q in zip(a, b)]
            assert away[0] <= simhash.radius(0.8) and sum(away) <= simhash.radius(0.8, 256)


def test_pipeline_stage_drops_similar_texts(spark, sf_dir):
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    near = list(words)
    for at in (50, 130, 210, 290, 370):
        near[at] = f"new{at}"
    assert (simhash.fingerprint(" ".join(words), 5) ^ simhash.fingerprint(" ".join(near), 5)).bit_count() > 3
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "another text")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [1, 3]


def unit(rng, n, d=32):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("crowd, block", [(projections.CROWD, projections.BLOCK), (2, 16), (10**6, 24)])
def test_embeddings_against_all_pairs(spark, monkeypatch, crowd, block):
    rng = np.random.default_rng(4)
    x = unit(rng, 60)
    group = x[:1] + rng.normal(scale=0.02, size=(50, 32))  # a narrow group of near copies
    chain = np.stack([np.cos(t) * x[1] + np.sin(t) * x[2] for t in np.arange(0, 1.5, 0.05)])  # a long one, linked step by step
    x = np.concatenate([x, x[:30] + rng.normal(scale=0.03, size=(30, 32)), x[:5], group, chain])
    rows = [(n, v.tolist(), n % 2 if n < 90 else 0) for n, v in enumerate(x)]
    rows += [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] + [1.0] * 31, 0), (503, x[0].tolist(), None), (504, [], 1), (505, x[0].tolist()[:7], 0), (506, [None] + [1.0] * 31, 0), (0, x[0].tolist(), 0)]
    rows += [(None, x[0].tolist(), 0), (None, (x[50] + 0.01).tolist(), 0), (None, None, 0)]
    monkeypatch.setattr(projections, "CROWD", crowd)
    monkeypatch.setattr(projections, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(tuple(r) for r in projections.embedding_links(df, 0.93).fillna(-1).collect())
    assert len(got) == len(rows)
    good = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for k in good:
        v, w = (np.array(rows[k][1]) for _ in range(2))
        for j in good:
            w = np.array(rows[j][1])
            if j != k and rows[j][2] == rows[k][2] and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links.append((k, j))
    part = lowest(links, range(len(rows)))
    name = {}
    for k, (i, _, _) in enumerate(rows):
        name[part[k]] = min([n for n in (name.get(part[k]), i) if n is not None], default=None)
    expected = sorted((-1 if i is None else i, sum(a == k for a, _ in links), -1 if name[part[k]] is None else name[part[k]]) for k, (i, _, _) in enumerate(rows))
    assert got == expected
    assert projections.embedding_links(df.limit(0)).count() == 0


def test_recall_at_the_least_cosine_and_few_strangers():
    rng = np.random.default_rng(6)
    for vectors in (500, 50_000):
        lines, tables, least = projections.plan(0.93, 0.999, vectors)
        a, b = unit(rng, 4000, 64), unit(rng, 4000, 64)
        c = b - (a * b).sum(axis=1, keepdims=True) * a
        c = 0.93 * a + np.sqrt(1 - 0.93**2) * c / np.linalg.norm(c, axis=1, keepdims=True)
        (ca, pa_), (cc, pc), (cb, pb) = (projections.cells(v, 0.93, lines, tables) for v in (a, c, b))
        hits = ((ca == cc) & (np.abs(pa_ - pc) <= 1)).sum(axis=1)
        assert least >= 2 and (hits >= least).mean() > 0.995
        strangers = ((ca == cb) & (np.abs(pa_ - pb) <= 1)).mean() * vectors
        assert strangers <= 3 * projections.STRANGERS


def test_collisions_and_searches_against_all_pairs():
    rng = np.random.default_rng(15)
    cell, place, node = np.sort(rng.integers(0, 12, 300)), rng.random(300) * 9, rng.permutation(300)
    order = np.lexsort((place, cell))
    a, b = projections.collisions(cell[order], place[order], node[order])
    expected = {(min(node[i], node[j]), max(node[i], node[j])) for i in range(300) for j in range(i) if cell[i] == cell[j] and abs(place[i] - place[j]) <= 1}
    assert set(zip(a.tolist(), b.tolist())) == expected and len(a) == len(expected)
    x = unit(rng, 200, 4)
    p, q = projections.reached(x, 0.93)
    near = [(i, j) for i in range(200) for j in range(i) if x[i] @ x[j] >= 0.93]
    assert lowest(zip(p.tolist(), q.tolist()), range(200)) == lowest(near, range(200)) and all(x[i] @ x[j] >= 0.93 for i, j in zip(p, q))


def plain_repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(spark, monkeypatch, hot):
    rng = np.random.default_rng(7)
    pool = [" ".join(f"p{x}" for x in rng.integers(0, 40, 30)) for _ in range(8)]
    texts = [*edge.TEXTS]
    for n in range(40):
        parts = [pool[k] for k in rng.integers(0, 8, 2)]
        texts.append(f"start{n} {parts[0]} mid{n} {parts[1][: int(rng.integers(20, len(parts[1])))]} " + "aa " * int(rng.integers(0, 40)))
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = [(n, t) for n, t in enumerate(texts)]
    got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_repeats(rows, 13)


def test_substrings_of_odd_rows(spark):
    docs = edge.frame(spark, [*edge.TEXTS, edge.LONG])
    got = substrings.digests(docs).collect()
    assert len(got) == docs.count() and {r["n_removed"] for r in got if r["doc_id"] is None} == {0}
    assert substrings.digests(edge.empty(spark)).count() == 0
