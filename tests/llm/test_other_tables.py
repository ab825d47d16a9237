"""Operators on embeddings, pages and conversations."""

import random
from collections import Counter

import numpy as np
import pytest

from entwine.llm import chat, embedding_dedup, html_main
from entwine.llm.common import connected_components


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):
        out.append((100 + i, (base[i % 5] + 0.1 * rng.standard_normal(16)).tolist()))
    out += [(300, (3 * base[7]).tolist()), (301, base[8].tolist()), (302, base[8].tolist()), (302, base[8].tolist())]
    out += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None]), (404, [float("inf"), 1.0]), (405, []), (None, base[9].tolist()), (406, base[3][:8].tolist()), (407, [1e200] * 16), (408, [1e-200] * 16)]
    return out


def truth(data):
    units = []
    for i, v in data:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / max(map(abs, v)) if ok else None)
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    n, parent = Counter(), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(data):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, n[i], least.get(find(i))) for i, (k, _) in enumerate(data))


@pytest.mark.parametrize("block", [2048, 3])
def test_embeddings_equal_all_pairs(spark, block):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors()], "vec_id long, embedding array<double>, label int, k1 string")
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == truth(vectors())
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hashing_plan_keeps_its_recall():
    for n in (100, 10**6, 10**9):
        h = embedding_dedup.plan(n, 0.9, 0.999)
        p = embedding_dedup.collision((0.2) ** 0.5, h.width) ** h.k
        assert 1 - (1 - p) ** h.tables >= 0.999


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1100)] + [(5000, 5000)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="page-nav">
<header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>One   two<br>three<p>Fish&nbsp;&lt;chips&gt; &am &copy<div class="share">Share</div>
<div class="box">Sign our guest book today</div><ul><li>a<li>b</ul><form>f</form><aside>s</aside><p hidden>h</p><section class="comments"><p>c</p></section></article>
<div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_pages(spark):
    pages = [(i, f"https://www.a.org/{i}", PAGE.replace("One", f"One{i}").replace("<li>a", f"<li>a{i}")) for i in range(10)] + [(20, "http://b.org/1", PAGE), (21, None, None), (22, "x", ""), (23, "http://c.org", "just text <b>bold</b><p>para"), (20, "http://b.org/1", PAGE)]
    df = spark.createDataFrame([(*p, 1, "h") for p in pages], "page_id long, url string, html string, n_chars int, templates string")
    got = html_main.extract(df).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Head & more\n\nOne3 two three\n\nFish <chips> &am ©\n\na3\n\nb"  # the guest book recurs on the host
    assert text[20] == "Head & more\n\nOne two three\n\nFish <chips> &am ©\n\nSign our guest book today\n\na\n\nb"
    assert text[21] == "" and text[22] == "" and text[23] == "just text bold\n\npara"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_main.extract(df.where("false")).count() == 0


def test_bodies_that_recur_stay(spark):
    page = "<body><div><p>" + "A long story told on every page. " * 5 + "</p></div><div>menu</div></body>"
    df = spark.createDataFrame([(i, "http://a.b/x", page) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_main.extract(df).collect()} == {("A long story told on every page. " * 5).strip()}


def test_articles_among_other_elements():
    read = lambda h: html_main.blocks(html_main.content(html_main.parse(h)), frozenset())
    wrapped = '<div class="page-header social-share"><article class="post"><header><h1>T</h1><p>by A</p></header><p>x</p><footer>f</footer></article></div>'
    assert read(wrapped + '<section class="comments"><article class="comment"><p>c</p></article></section>') == ["T", "by A", "x"]
    assert read('<article><h1>T</h1><p>x</p><section class="comments"><article class="comment"><p>c</p></article></section></article><article class="card"><p>other</p></article>') == ["T", "x"]
    assert read('<body><header><h1>Logo</h1></header><div id="content" class="has-sidebar"><h1>T</h1><p>x</p></div><div class="sidebar">s</div></body>') == ["T", "x"]
    assert read('<div role="main"><p>x</p></div><div role="navigation">n</div>') == ["x"]


def test_unclosed_and_deep_markup():
    assert html_main.blocks(html_main.content(html_main.parse("<p>a<script>x" )), frozenset()) == ["a"]
    assert html_main.blocks(html_main.content(html_main.parse("<div>" * 5000 + "x")), frozenset()) == ["x"]
    assert html_main.blocks(html_main.content(html_main.parse('<p title="a>b">c</p><p>d < e')), frozenset()) == ["c", "d < e"]


def test_only_maximal_conversations_are_rendered(spark):
    turns = []

    def log(conv, *texts):
        turns.extend((conv, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts))

    log(1, "a")
    log(2, "a", "b")
    log(3, "a", "b", "c")
    log(4, "a", "b", "c")
    log(5, "a", "x")
    log(6, "a", None)
    log(7, *[f"t{i}" for i in range(1300)])
    log(8, *[f"t{i}" for i in range(1299)])
    turns += [(3, 0, "user", "a", "x"), (9, None, None, None, "x"), (None, 0, "user", "lost", "x"), (10, 5, "user", "gap", "x"), (10, 9, "assistant", "late", "x"), (11, 0, "user", "gap", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert sorted(got) == [3, 5, 6, 7, 9, 10]
    assert got[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n" and got[3].copies == 2 and got[3].n_turns == 3
    assert got[7].rendered == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\nt{i}<|im_end|>\n" for i in range(1300))
    assert got[9].rendered == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_chats(df.where("false")).count() == 0


def test_pairs_found_at_the_threshold_reach_the_recall(spark):
    """More projections than such a small table asks for: links found of those that all pairs have, for every 100th vector."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for i in range(1500, 3000):  # cosines from 0.9 on
        other = rng.standard_normal(32)
        other -= (other @ base[i - 1500]) * base[i - 1500]
        c = rng.uniform(0.9, 0.93)
        base[i] = c * base[i - 1500] + (1 - c * c) ** 0.5 * other / np.linalg.norm(other)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    hashing = embedding_dedup.plan(3000, 0.9, 0.97, bucket=8)
    assert hashing.k > 4
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, hashing=hashing).collect()}
    want = (base @ base.T >= 0.9).sum(axis=1) - 1
    queries = range(0, 3000, 100)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got[i] for i in queries) >= 0.9 * sum(want[i] for i in queries) and sum(got.values()) >= 0.97 * want.sum()


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((20000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embedding_dedup.sketch(x).view(np.uint64), embedding_dedup.sketch(0.9 * x + (1 - 0.81) ** 0.5 * y).view(np.uint64)
    assert np.bitwise_count(a ^ b).sum(axis=1).max() <= embedding_dedup.most_signs(0.9)
    assert (np.bitwise_count(a[1:] ^ b[:-1]).sum(axis=1) <= embedding_dedup.most_signs(0.9)).mean() < 1e-4
