"""Blocks by hand, gradients by differences, the labeller on pages it has not seen, and the query on a written folder."""

import random
import time

import duckdb
import numpy as np
import pytest

from cellweave.llm import entry, extraction
from cellweave.llm.extraction import Labeller, blocks_of, lessons, told, trained, vectors_of

SF = "/root/testdata/sf0.01/pages.parquet"


def texts(html):
    return [b.text for b in blocks_of(html)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a  b\n\tc<p>d<br>e</p>f", ["a b c", "d e", "f"]),
        ("<p>x&nbsp;y &#233;&eacute; &lt;b&gt; &am &amp</p>", ["x y éé <b> &am &"]),
        ("<P>one<B>two</B> <i>three</I><DIV>four</DIV>", ["onetwo three", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<script>var a='</p><p>';</script>a<style>p{}</style><!-- <p>no --><title>t</title>b", ["a b"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<!-- never closed <p>b</p>", ["ab"]),
        ('<div class="x > y">a</div><img alt=">">b', ["a", "b"]),
        ('<p title="never closed>a</p><p>b</p>', ["a", "b"]),
        ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]),
        ("<!DOCTYPE html><?xml x?><p>a</p></nonsense>b</p>c</div>", ["a", "b", "c"]),
        ("a<svg><path/></svg><noscript>no</noscript>b<iframe src=x></iframe>", ["a b"]),
        ("cut off <p>here <a href='x", ["cut off", "here"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_paths_and_links():
    b = blocks_of('<div id="mainBox"><nav class="top-menu"><ul><li><a href=x>go</a> on</ul></nav><article><p>text</p></article></div>')
    assert b[0].path[:5] == ["li", "ul", "nav", "top", "menu"] and b[0].link == 2
    assert "main" in b[0].path and "nav" not in b[1].path and "article" in b[1].path and b[1].link == 0
    assert [told(x) for x in b] == [False, True]


@pytest.mark.parametrize("unit", ["<a ", '<a ">"', "<!--", "<div>", "</div>", "<p", "<script>", "&amp;", '<a "', "<li>", "<", "<td><p>", "<b>x", "<textarea>"])
def test_time_is_proportional(unit):
    began = time.time()
    blocks_of(unit * (400_000 // len(unit)))
    assert time.time() - began < 6


def test_gradients():
    rnd = random.Random(1)
    pages, labels = lessons([], 3, 5)
    pages, y = [*pages, []], np.concatenate(labels)
    model = Labeller.fresh(3)
    model.weights = {k: a.astype(np.float64) for k, a in model.weights.items()}
    v = vectors_of(pages)
    _, grads = model.gradients(v, y)
    for k, a in model.weights.items():
        at = tuple(rnd.randrange(n) for n in a.shape) if k not in ("paths", "words") else (int((v.path if k == "paths" else v.word)[0]), 3)
        kept, ends = a[at], []
        for step in (1e-4, -1e-4):
            a[at] = kept + step
            p = model.probabilities(v).astype(np.float64)
            ends.append(-np.log(np.where(y == 1, p, 1 - p)).mean())
        a[at] = kept
        assert abs((ends[0] - ends[1]) / 2e-4 - grads[k][at]) < 2e-2 * max(abs(grads[k][at]), 0.02), k


@pytest.fixture(scope="module")
def htmls():
    return [h for (h,) in duckdb.connect().execute(f"SELECT html FROM '{SF}' ORDER BY page_id").fetchall()]


@pytest.fixture(scope="module")
def model(htmls):
    return trained(htmls[:150], 800)


def test_pages_it_has_not_seen(htmls, model):
    pages = [blocks_of(h) for h in htmls[150:]]
    p = model.probabilities(vectors_of(pages))
    gold = np.array([bool(told(b)) for x in pages for b in x])
    assert ((p >= 0.5) == gold).mean() > 0.999


def test_layouts_it_has_not_seen(htmls, model):
    pages, labels = lessons(htmls[150:], 300, 123)
    pages, gold = pages[-300:], np.concatenate(labels[-300:])
    found = model.probabilities(vectors_of(pages)) >= 0.5
    assert found[gold == 1].mean() > 0.97 and found[gold == 0].mean() < 0.03


def test_a_page_by_hand(model):
    text = ["A day by the sea", "The morning was cold, and the boats stayed in the harbour until the fog had gone.", "Later the market opened. People came from the villages, bought fish and bread, and talked about the storm."]
    page = f"""<html><head><title>T</title><script>x()</script></head><body><header id="masthead"><a href=/>The daily news</a></header>
    <div class="menu"><ul><li><a href=1>Home</a><li><a href=2>Sports</a></ul></div><div id="cookie-banner">We use cookies to improve your experience <button>Accept all</button></div>
    <div class="content"><h1>{text[0]}</h1><p>{text[1]}</p><div class="ad">Buy now</div><p>{text[2]}</p></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href=9>Storm hits the coast</a></li></ul></div><form class="search"><label>Search</label></form>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>ann says:</p><p>I liked this very much.</p><p>Reply</p></div></div><div class="site-footer">© 2024 All rights reserved</div></body></html>"""
    blocks = blocks_of(page)
    p = model.probabilities(vectors_of([blocks]))
    assert [b.text for b, x in zip(blocks, p, strict=True) if x >= 0.5] == text


def test_query(spark, htmls, tmp_path):
    rows = [(i, f"u{i}", h) for i, h in enumerate(htmls[:60])] + [(3, "u3", htmls[3]), (None, None, htmls[4]), (70, "u", None), (71, "u", ""), (72, "u", "<p> </p>"), (73, "u", htmls[0][:-400] + "<p>" + "long text, " * 30_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, blocks int")
    d.write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.QUERIES["op12_block_labeller"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    want = lambda h: "\n".join(b.text for b in blocks_of(h or "") if told(b))
    mine = sorted(((r.page_id, r.url, r.text) for r in got if r.page_id != 73), key=repr)
    assert mine == sorted(((i, u, want(h)) for i, u, h in rows if i != 73), key=repr)
    assert next(r for r in got if r.page_id == 73).n_chars > 300_000
    assert entry.QUERIES["op12_block_labeller"](spark, str(tmp_path)).collect() == got
    none = d.limit(0)
    assert extraction.extracted(none).count() == 0


def test_columns_and_blocks(spark, htmls, model):
    d = spark.createDataFrame([(1, "u", htmls[0]), (2, "v", None)], "page_id bigint, url string, html string")
    got = {r.page_id: r.blocks for r in extraction.labelled(d, model).collect()}
    assert [b.text for b in got[1]] == texts(htmls[0]) and got[2] == []
    assert all(0 <= b.p <= 1 and b.path for b in got[1])
