"""Site templates: what recurs goes, by recurrence alone, and the counts equal plain ones."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from entwine.llm import html_main

PAGES = "page_id long, url string, html string"


def site(n, seed=3):
    """Pages of two hosts with two sections; boxes without a name around and in the body and the article."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host, section = ("big.org", "fr" if i % 4 == 0 else "de") if i % 3 else ("small.org", "x")
        story = "".join(f"<p>Tale {i} of {rng.randrange(10**6)} goes on and on.</p>" for _ in range(rng.randrange(2, 6)))
        top = "<div><a>Start</a><a>Shop</a></div>"
        inner = f"<div><p>Written for {section} readers of {host} by all of us.</p></div>"
        line = "<p>All the stories of this place are free to read.</p>" if host == "big.org" else ""
        odd = "<p>A line that some articles share with others.</p>" if i % 7 == 0 else ""
        if i % 5 == 0:
            html = f"<body>{top}<div>{story}{line}</div>{inner}<div>Legal and more for {host}</div></body>"
        else:
            html = f"<body>{top}<article><h1>Tale {i}</h1>{story}{odd}{inner}{line}</article><div>Legal and more for {host}</div></body>"
        out.append((i, f"http://{host}/{section}/{i}.html", html))
    return out + [(n, "http://big.org/fr/0.html", out[4][2]), (n, "http://big.org/fr/0.html", out[4][2])]


def test_unnamed_boilerplate_goes_by_recurrence_alone(spark):
    pages = site(120)
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(pages, PAGES)).collect()}
    for i, url, html in pages[:120]:
        text = got[i].text
        assert "Start" not in text and "Legal" not in text and "Written for" not in text and "free to read" not in text, (i, text)
        assert text.count(f"Tale {i} of") == html.count(f"Tale {i} of")
        assert ("some articles share" in text) == ("some articles share" in html)  # a line of articles, no template
        assert got[i].n_removed >= 2


def test_counts_equal_plain_ones(spark):
    pages = site(90, 5)
    plain, whole = defaultdict(set), defaultdict(set)
    copies, host_of = Counter(), {}
    rows = [html_main.page_hashes(html, url) for _, url, html in pages]
    for host, section, alike, hs in rows:
        whole[host].add((section, alike))
        copies[host] += 1
        for h in {h for h, _ in hs}:
            host_of[h] = host
            plain[h].add((section, alike))
            copies[h] += 1
    want = {host: [0] for host, at in whole.items() if len(at) >= 20}
    for h, at in plain.items():
        host = host_of[h]
        if copies[h] < 2:
            continue
        n, pages_of = len(at), Counter(s for s, _ in whole[host])
        regular = max([n if n > 0.3 * len(whole[host]) else 0] + [k for s, k in Counter(s for s, _ in at).items() if k >= 3 and k > 0.3 * pages_of[s]])
        usual = copies[h] >= 3 and copies[h] > 0.3 * copies[host]
        kinds = [(1, n >= 3), (2, regular >= 3 or n >= 20), (3, regular >= 20), (4, regular >= 20), (5, n >= 2), (6, usual)]
        if any(ok for _, ok in kinds):
            want[h] = sorted(k for k, ok in kinds if ok)
    seen = spark.createDataFrame([(*r[:3], [{"h": h, "kind": k} for h, k in r[3]]) for r in rows], "host long, section long, alike long, hashes array<struct<h:bigint,kind:int>>")
    assert {r.h: sorted(r.kinds) for r in html_main.template_counts(seen, 3, 0.3, 20, 20).collect()} == want


def test_names_only_ask_for_less_recurrence(spark):
    article = "<article><h1>T{i}</h1><p>Story {i} alone.</p>{box}</article>"
    box = '<div class="notice">Notice of {n} in the legal text.</div>'
    many = [(i, f"http://a.org/{i}", article.format(i=i, box=box.format(n=i if i > 1 else "two"))) for i in range(40)]
    few = [(100 + i, f"http://b.org/{i}", article.format(i=i, box='<div class="newsletter">Letter</div>')) for i in range(2)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(many + few, PAGES)).collect()}
    assert "Notice" not in got[0] and "Notice" not in got[1] and all(f"Notice of {i} " in got[i] for i in range(2, 40))
    assert "Letter" not in got[100]


def test_awkward_pages(spark):
    odd = [(1, None, None, 7, "a"), (1, None, None, 7, "a"), (None, "http://h.org/x", "<p>x", 1, "b"), (2, "no url", "", 0, ""), (3, "http://h.org", "<div>" * 3000 + "deep", 1, "c"), (4, "http://h.org/퟿", "<p>" + "long " * 50_000, 1, "d")]
    df = spark.createDataFrame(odd, PAGES + ", h long, kinds string").withColumns({"k1": F.lit("x"), "packed": F.lit(1), "_host": F.lit("y")})
    got = html_main.extract(df).collect()
    assert Counter((r.page_id, len(r.text)) for r in got) == Counter({(1, 0): 2, (None, 1): 1, (2, 0): 1, (3, 4): 1, (4, 249_999): 1})
    assert html_main.extract(df.where("false")).collect() == []
