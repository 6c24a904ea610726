from __future__ import annotations

import html
import re

import numpy as np

from gritstone.llm import html_blocks as H

SCHEMA = "text int, page_id bigint, url string, html string"


def article_of(page):
    """What the given pages' one template holds between <article> and its end or the footer."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x)).split()) for x in parts) if t)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert sum(got[r.page_id].text == article_of(r.html) for r in rows) >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_unmarked_page(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120).collect()]
    model = H.train(pages)
    page = '<body><div class="menu"><a href="/">Home</a></div><div class="content"><h1>Of the ering</h1><p>Thing re and onle, that with the.</p><p>Er edhe &lt;x&gt; &amp; so.</p></div><div class="footer">&copy; me</div></body>'
    blocks = H.blocks_of(page)
    p = H.label(model, [blocks])[0]
    assert [t for (_, t, _), q in zip(blocks, p) if q >= 0.5] == ["Of the ering", "Thing re and onle, that with the.", "Er edhe <x> & so."]


def test_silent_elements_at_any_depth():
    texts = lambda page: [t for _, t, _ in H.blocks_of(page)]
    inner = "<g>" * 6 + "<title>no</title><text>no</text>" + "</g>" * 6
    assert texts(f"<article><p>one <svg>{inner}</svg> two</p></article>") == ["one two"]
    assert texts("<p>a<template><div><ul><li><p>no<li>no</ul></div></template>b</p><p>c") == ["ab", "c"]
    assert texts("<div><noscript><div><div><div><div>no</div></div></div></div></noscript>yes</div>") == ["yes"]
    assert texts("<section><object><b><i><u>no</section><p>yes") == ["yes"]


def test_deep_nesting(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120).collect()]
    model = H.train(pages)
    deep = lambda tag, inner, n: f"<{tag}>" + "<div>" * n + inner + "</div>" * n + f"</{tag.split()[0]}>"
    for n in (0, 12, 60):
        page = "<body>" + deep("nav", '<a href="/">Home</a>', n) + deep("article", "<h1>Of the ering</h1><p>Thing re and onle, that with the.</p><p>Er edhe heed of the rouha.</p>", n) + deep("footer", "<p>Reouh and the erth of me.</p>", n) + "</body>"
        blocks = H.blocks_of(page)
        kept = [t for (_, t, _), q in zip(blocks, H.label(model, [blocks])[0]) if q >= 0.5]
        assert kept == ["Of the ering", "Thing re and onle, that with the.", "Er edhe heed of the rouha."]
    one, other = (H.vectors([([(tag, ()), *[("div", ())] * 20], "text", 0)]) for tag in ("nav", "article"))
    assert (one != other).any()


def test_page_of_thousands_of_blocks(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120).collect()]
    model = H.train(pages)
    said = [f"Thing re and onle, that with the {k}." for k in range(3000)]
    page = '<body><nav><ul>' + '<li><a href="/x">Er</a></li>' * 1500 + "</ul></nav><article><h1>Of the ering</h1>" + "".join(f"<p>{t}</p>" for t in said) + "</article><footer>" + '<p><a href="/">Er edhe</a></p>' * 1500 + "&copy; me</footer></body>"
    short = H.blocks_of(pages[0])
    blocks = H.blocks_of(page)
    p, q = H.label(model, [blocks, short])
    assert [t for (_, t, _), x in zip(blocks, p) if x >= 0.5] == ["Of the ering", *said]
    x = H.vectors(blocks)[None]
    assert np.abs(model.forward(x, np.ones(x.shape[:2], np.float32), learning=False)[0][0] - p).max() < 1e-4
    assert np.abs(H.label(model, [short])[0] - q).max() < 1e-4


def test_gradients_are_right():
    r = np.random.default_rng(1)
    model = H.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask, y = r.normal(size=(2, 4, H.INPUT)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        p, _ = model.forward(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grad = model.gradients(x, mask, y)
    for key, at in (("xf", (3, 5)), ("hf", (2, 9)), ("hb", (1, 20)), ("cb", (4,)), ("o", (3,)), ("xb", (7, 30))):
        model.w[key][at] += 1e-3
        up = loss()
        model.w[key][at] -= 2e-3
        down = loss()
        model.w[key][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[key][at]) < 2e-3 * max(1e-2, abs(grad[key][at])) + 2e-5


def test_odd_pages(spark):
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "<article>" + "<p>one two three.</p>" * 3000 + "</article>"
    rows = [(1, 1, None, None), (1, 2, "u", ""), (1, None, "u", "<p>x"), (1, 3, "u", long), (1, 3, "u", long), (1, 4, "u", "<<a & b"), (1, 5, "u", "<nav>m</nav><article><p>good text here.</p></article>")]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]


def test_pages_that_mark_no_article():
    from gritstone.llm.html_blocks import blocks_of, label, train

    page = lambda k: f'<body><div class="nav"><a href="/">Home</a> <a href="/x">News</a></div><div><h1>Title {k}</h1><p>A first sentence of the page {k}, which says something.</p><p>And a second one that goes on.</p></div><footer>(c) me</footer></body>'
    model = train([page(k) for k in range(20)])
    blocks = blocks_of(page(99))
    kept = [text for (_, text, _), p in zip(blocks, label(model, [blocks])[0], strict=True) if p >= 0.5]
    assert kept == ["Title 99", "A first sentence of the page 99, which says something.", "And a second one that goes on."]
    lone = blocks_of("<p>only this</p>")
    assert label(train(["<p>one</p>", "<p>two</p>"]), [lone])[0].tolist()[0] >= 0.5
