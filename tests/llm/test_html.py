from __future__ import annotations

import time

import numpy as np

from choicekit.llm import html


def texts(page):
    return [t for _, t, _ in html.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;<b>c</b>\n d<p>e<br>f") == ["a & b c d", "e f"]
    assert texts("<script>var x='</p>'; a<b</script>x<style>y</style><!-- n <p>o</p> -->z<noscript>q</noscript>") == ["x", "z"]
    assert texts('<div title="a > b">x</div><ul><li>1<li>2</ul>t<td>u') == ["x", "1", "2", "t", "u"]
    assert texts("a < b and c<d") == ["a < b and c<d"] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<svg><text>no</text></svg>yes<textarea>no</textarea><title>no</title>") == ["yes"]
    (path, _, linked), = html.blocks('<div class="postBody x-2"><p id=Intro>see <a href=/>this</a>')
    assert path == ("div post body x 2", "p intro") and linked == 4
    assert texts("<b" * 2000 + "<p>x") and texts('<p a="' * 500 + "x")
    assert texts("x<script>never closed <p>y") == ["x"] and texts("&lt;p&gt;no tag") == ["<p>no tag"]


def test_omitted_tags_and_comments():
    assert texts("<html><head><title>x</title><body><article><p>Text.") == ["Text."]
    assert texts("<head><meta charset=x><p>Text.</head>more") == ["Text.", "more"] and texts("<head><title>t</title>loose") == ["loose"]
    assert texts("<head><link><script>s</script><style>t</style></head><p>a") == ["a"]
    assert texts("<p>a<![CDATA[ no ]]>b") == ["ab"] and texts("<p>a<![CDATA[abcdef") == ["a"] and texts("<!-->a<!--->b<?php c ?>d") == ["abd"]
    assert texts("<p title='a>b'>c</p><p title=\"x>d</p>e") == ["c", "d", "e"] and texts("<p it's>a</p><p>b's") == ["a", "b's"]
    assert texts("<ul><li>1<ul><li>2</ul><li>3</ul><table><tr><td>4<tr><td>5") == ["1", "2", "3", "4", "5"]


def test_time_is_linear():
    for piece in ("<b x='", '<a ">" ', "<a x=\">", "<!", "<![CDATA[", "<", "</", "&#", "<a =' ", "<p ='>\"", "<!-- -"):
        began = time.perf_counter()
        html.blocks(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 20, piece
    for page in ("<div>" * 80_000 + "</section>" * 60_000, "<div>x" * 100_000, "<ul><li>x" * 60_000):
        began = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - began < 60, page[:20]


def test_gradient():
    net = html.BiLstm(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.normal(size=(2, 4, len(net.w["xf"]))), rng.integers(0, 2, (2, 4)).astype(float), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    _, g = net.gradient(x, mask, y)
    for k in net.w:
        at = tuple(int(rng.integers(s)) for s in net.w[k].shape)
        keep, losses = net.w[k][at], []
        for e in (1e-3, -1e-3):
            net.w[k][at] = keep + e
            losses.append(net.gradient(x, mask, y)[0])
        net.w[k][at] = keep
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 1e-4 + 1e-2 * abs(g[k][at]), k


def test_held_out_accuracy():
    held = html.page_sample(300, 12345)
    own = [html.blocks(h) for h, _ in held]
    labels = html.labeller().label(own)
    right = [np.mean(np.array([t in main for _, t, _ in b]) == y) for (_, main), b, y in zip(held, own, labels) if b]
    assert np.mean(right) > 0.98


def test_extract(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title of it</h1><p>First &eacute; text.<p>Second\n\ttext.</article><footer>&copy; x</footer>'
    df = spark.createDataFrame([(1, "u", page, 9), (1, "u", page, 9), (2, None, None, 9), (3, "v", "", 9), (4, "w", "<body>" + f"<article>{'<p>Some more words here.</p>' * 3000}</article>", 9)], "page_id long, url string, html string, text int")
    rows = html.extract(df, batch_chars=100).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 5 and by[1].text == "Title of it\nFirst é text.\nSecond text." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[2].url is None and by[4].text.count("\n") == 2999
    assert html.extract(df.limit(0)).collect() == []
