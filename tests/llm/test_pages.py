"""HTML extraction (11), hard negatives (12) and the filter audit (13): against plain search, other page shapes, odd rows, skew."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import extraction, filters, negatives, queries

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna."


def plain_article(page):
    """The article of the driver's pages, whose one shape is known."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_tables(spark, sf_dir):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op11_html_extraction(spark, sf_dir).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        text = plain_article(page)
        assert got[page_id] == (url, text, len(text))


#: What a page is made of: main text as blocks, and other elements, in several ways of writing each.
CHROME = [
    '<nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav>',
    '<div class="main-menu"><a href="/a">Menu a</a> <a href="/b">Menu b</a></div>',
    "<header><p>Site header</p></header>",
    '<div id="site-header"><h1>Site header</h1></div>',
    f'<div role="alert" class="cookie-notice"><p>Notice {P}</p></div>',
    f'<div class="ad">Advert {P}</div>',
    f'<section class="adBox"><p>Advert {P}</p></section>',
    f"<aside><h2>Side</h2><p>Side {P}</p></aside>",
    f'<div id="sidebar"><p>Side {P}</p></div>',
    '<form action="/s"><p>Form</p><label>Name</label><input name="q"><button>Go</button></form>',
    f"<script>var t = '<p>Script {P}</p>';</script><style>p {{ margin: 0 }}</style><noscript><p>No script</p></noscript>",
    f'<div hidden><p>Hidden {P}</p></div><!-- <p>Remark</p> -->',
]
AFTER = [
    f'<section id="comments"><h2>Comments</h2><article class="comment"><p>Comment {P}</p></article><article class="comment"><p>{P}</p></article></section>',
    f'<ol class="comment-list"><li><p>Comment {P} {P}</p></li></ol>',
    "<footer>&copy; 2020 Someone</footer>",
    '<div class="footer"><p>About</p></div>',
    f'<div class="related"><article><h3><a href="/x">Other</a></h3><p>{P}</p></article></div>',
]
MAIN = [
    (["The title & more", P, "Short.", f"{P} {P}", "One", "Two", "Last words."], f"<h1>The title &amp; more</h1><p>{P}</p><p>Short.<p>{P}<br>\n  {P}</p><ul><li>One<li>Two</ul><p>Last <b>words</b>.</p>"),
    (["Über <alles> A", f"{P} link {P}", "naïve", P], f'<h2>Über&nbsp;&lt;alles&gt; &#x41;</h2><p>{P} <a href="/l">link</a>\n{P}</p><blockquote>naïve</blockquote><p><i>{P}</i></p>'),
]
WRAPS = [
    '<body class="has-sidebar">{before}<article>{main}</article>{after}</body>',
    "<body>{before}<main><div class='content'>{main}</div></main>{after}",
    '<div id="wrap">{before}<div class="post-entry"><div>{main}</div></div>{after}</div>',
    "<form action='/page'>{before}<article class='post'>{main}<footer>Tags</footer></article>{after}</form>",
    "<table><tr><td>{before}</td><td>{main}</td></tr><tr><td>{after}</td></tr></table>",
]


@pytest.mark.parametrize("wrap", WRAPS)
def test_other_shapes_of_pages(wrap):
    draw = random.Random(7)
    for (blocks, main), _ in itertools.product(MAIN, range(25)):
        before, after = ("".join(draw.sample(x, draw.randint(1, len(x)))) for x in (CHROME, AFTER))
        page = "<!DOCTYPE html><html><head><title>Title</title><meta charset=utf-8></head>" + wrap.format(before=before, main=main, after=after)
        assert extraction.main_text_of(page).split("\n") == blocks, page


def test_menus_and_rights_without_names_are_left_out():
    page = f"<div><a href=a>Home</a> | <a href=b>About</a></div><div><div>Head line</div><div>{P}</div><div>short line</div><div>{P} {P}</div></div><div>Copyright 2020</div>"
    assert extraction.main_text_of(page).split("\n") == ["Head line", P, "short line", f"{P} {P}"]


def test_smoothing_and_threshold():
    assert np.allclose(extraction.smoothed(np.full(9, 3.0)), 3)
    one = extraction.smoothed(np.eye(1, 9, 4)[0])
    assert one.argmax() == 4 and np.allclose(one, one[::-1])
    chars, tags = np.array([5, 5, 400, 30, 400, 5, 5.0]), np.array([3, 3, 1, 1, 1, 3, 3.0])
    assert extraction.content_lines(chars, np.zeros(7), tags, np.ones(7, bool)).tolist() == [False, True, True, True, True, True, False]


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "x", "<a " * 50_000, "<a " * 50_000 + ">", "<b>" * 30_000 + "<p>" + "</b>" * 30_000, "<!--" * 50_000 + ">", "<![" * 50_000 + ">", "<" * 100_000, "&#x" * 100_000, "<ul><li>" * 30_000, '<p a="' * 30_000 + ">", "</p>" * 50_000],
    ids=range(11),
)
def test_broken_pages_end_soon(page):
    extraction.main_text_of(page)


def test_odd_pages(spark):
    long = "word " * 300_000
    rows = [(1, None), (2, ""), (3, "<p>x</p>"), (3, "<p>x</p>"), (None, "plain text"), (4, "<script>only</script>"), (5, f"<article><p>{long}</p></article>"), (6, "<p>one\x00퟿ 漢字 ☕</p>")]
    pages = spark.createDataFrame([(i, "u", h, "old", 9, "z") for i, h in rows], "page_id long, url string, html string, text string, N_CHARS int, extra string")
    out = extraction.main_text(pages)
    assert out.columns == ["page_id", "url", "html", "extra", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert [(i, n) for i, _, n in got] == [(0, 10), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, len(long) - 1), (6, 10)]
    assert got[0][1] == "plain text" and got[6][1] == long.strip()
    assert extraction.main_text(pages.limit(0)).count() == 0


def plain_negatives(rows, m, every=50):
    """(anchor, positive, rank, negative, positive score, negative score) of every anchor by scoring all rows."""
    good = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, [int(np.floor(m.scale * x)) for x in v], l) for i, v, l in good]
    out = []
    for a, u, label in good:
        if a % every:
            continue
        scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(u, v)))), b, l == label) for b, v, l in good if b != a]
        for p, pid, _ in sorted(x for x in scored if x[2])[: m.positives]:
            fits = sorted((s, b) for s, b, same in scored if not same and m.low * -p <= 100 * -s <= m.high * -p)
            out += [(a, pid, rank, b, -p, -s) for rank, (s, b) in enumerate(fits[: m.negatives], 1)]
    return sorted(out)


def mined(spark, rows, m=negatives.Mining(), **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") if rows else spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, m).collect())


def test_hard_negatives_by_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(k, (centres[k % 6] + rng.normal(size=12) * 0.6).tolist(), int(rng.integers(0, 5))) for k in range(900)]
    rows += [(k, rows[5][1], 2) for k in range(900, 1200)]  # a third are copies, which tie
    monkeypatch.setattr(negatives, "SHARD_CELLS", 12 * 200)
    monkeypatch.setattr(negatives, "BLOCK_CELLS", 12 * 5)
    monkeypatch.setattr(negatives, "LEAF", 16)
    assert mined(spark, rows) == plain_negatives(rows, negatives.Mining())
    other = negatives.Mining(scale=16, positives=2, negatives=7, low=-100, high=60)
    assert mined(spark, rows, other) == plain_negatives(rows, other)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (50, [1.0, 0.25], 1), (50, [1.0, 0.25], 1), (1, [0.5, 0.5], 2), (2, [0.9], 2), (3, [], 2), (4, None, 2), (None, [1.0, 1.0], 2), (5, [1.0, nan], 2), (6, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [0.5, 0.5], None), (10, [0.0, 0.0], 3), (11, [-1.0, -1.0], 3), (1, [0.5, 0.5], 2)]
    expected = plain_negatives(rows, negatives.Mining())
    assert expected and mined(spark, rows) == expected
    huge = [(0, [1e20, 1.0], 1), (1, [1e3, 0.0], 1), (2, [6e2, 0.0], 2), (3, [1e30, 0.0], 2), (4, [7.0, 1e9], 2)]
    assert mined(spark, huge) == plain_negatives(huge, negatives.Mining())
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []


def test_boxes_bound_every_score():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(1000, 5)) * 100)
    at = negatives.tiled(v)
    assert sorted(at) == list(range(1000))
    tree = negatives.Tree(np.arange(1000), np.zeros(1000, int), v[at])
    anchor = np.floor(rng.normal(size=(3, 5)) * 100)
    low, high = tree.bounds(anchor)
    exact = anchor @ v[at].T
    assert (low[:, 0] <= exact.min(axis=1)).all() and (high[:, 0] >= exact.max(axis=1)).all()
    for node in range(tree.leaves, len(tree.first)):
        part = exact[:, tree.first[node] : tree.last[node]]
        assert (low[:, node] <= part.min(axis=1)).all() and (high[:, node] >= part.max(axis=1)).all()


def plain_audit(docs, labels):
    """All counts of the audit, filter by filter and order by order, over Python sets."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least: dict[str, int] = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails, parts = [], {}
    for k, (d, text, source) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        caps = len(re.findall("[A-Z]", text))
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * caps > 2 * len(text), re.search(r"[#$%&*|]", text) is not None, d is not None and d > least[text]]
        fails.append({x for x, t in zip("ABCDE", tests) if t})
        parts.setdefault(source or "", []).append(k)
    out = []
    for part, rows in parts.items():
        own, removed_of = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = set(rows)
            for step, x in enumerate(order, 1):
                failing = {k for k in rows if x in fails[k]}
                removed = failing & alive
                lost = [sum(docs[k][0] in s for k in removed) for s in (good, toxic)]
                own.append([part, "".join(order), step, len(alive - removed), len(removed), len(failing - alive), sum(fails[k] == {x} for k in rows), *lost, x])
                alive -= removed
                removed_of[x] += len(removed)
        out += [(*r[:-1], removed_of[r[-1]]) for r in own]
    return sorted(out)


def test_audit_by_plain_sets(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta", "ga#mma", "DELTA", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}"]) for _ in range(rng.choice([3, 150, 250, 400]))) for _ in range(60)]
    docs = [(k, rng.choice([*texts, texts[0], None, "", " x\x0b\x1cy", "été " * 220]), rng.choice(["hot", "hot", "b", None, "c"])) for k in range(250)]
    docs += [(None, texts[0], "b"), (3, texts[1], "b"), (3, texts[1], "b"), (7, None, "lone")] + [(1000 + k, "the same text", "hot") for k in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for k in range(0, 400, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, rid int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = plain_audit(docs, labels)
    got = sorted(tuple(r) for r in filters.audit(*filters.text_relations(table, marks)).collect())
    assert got == expected
    monkeypatch.setattr(filters, "HOT_SHARE", 4)  # only the commonest texts are broadcast
    assert sorted(tuple(r) for r in filters.audit(*filters.text_relations(table, marks)).collect()) == expected


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", "a")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(*filters.text_relations(docs.limit(0), marks)).count() == 0
    assert sorted(tuple(r) for r in filters.audit(*filters.text_relations(docs, marks)).collect()) == plain_audit([(1, "text", "a")], [])


def test_copies_agree_with_digests(spark):
    rows = [(k, k % 7, hashlib.sha256(str(k % 11).encode()).digest()) for k in range(200)]
    got = {r["rid"] for r in filters.copies(spark.createDataFrame(rows, "rid long, doc_id long, digest binary")).collect()}
    least = {}
    for _, d, h in rows:
        least[h] = min(d, least.get(h, d))
    assert got == {k for k, d, h in rows if d > least[h]}
