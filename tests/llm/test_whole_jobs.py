"""Findings of the review: what the operators once left out."""

import random

from entwine.llm import html_main, quality

ROWS = "doc_id long, text string, lang string, source string"


def test_word_length_rejects_long_and_single_letter_words(spark):
    rng = random.Random(7)
    word = lambda low, high: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
    text = lambda low, high: " ".join(word(low, high) for _ in range(200))
    data = [(i, text(3, 7), "en", "a") for i in range(120)]
    data += [(200, text(30, 50), "en", "a"), (201, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789äöü", k=60)), "en", "a")]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(data, ROWS)).collect()}
    assert got[200].failed == ["word_length"] and got[201].failed == ["word_length"]
    assert all(got[i].kept for i in range(120))


def main_texts(spark, htmls):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_main.extract(df).collect()}


def test_boxes_on_a_tenth_of_a_large_host_are_templates(spark):
    story = lambda i: f"<p>Story {i} tells at some length of matters that no other page has.</p>" * 4
    box = "<div>Read our terms of use</div>"
    got = main_texts(spark, [f"<article><h1>T{i}</h1>{story(i)}{box if i < 25 else ''}<p>See {'<a>France</a>' if i < 60 else 'France'} too, {i}.</p></article>" for i in range(250)])
    assert not any("terms of use" in t for t in got.values())
    assert all(f"Story {i} tells" in t and f"See France too, {i}." in t for i, t in got.items())


def test_copies_of_a_page_do_not_make_templates_of_a_large_host(spark):
    page = "<article><h1>T</h1><p>" + "A long story. " * 20 + "</p><div>its own box</div></article>"
    other = [f"<article><h1>T{i}</h1><p>Story {i}.</p></article>" for i in range(100)]
    got = main_texts(spark, [f"<nav>{i}</nav>{page}" for i in range(25)] + other)
    assert "its own box" in got[0]


def test_recurring_paragraphs_and_large_boxes_are_templates(spark):
    advert = "<p>Subscribe to our weekly letter for more of this.</p>"
    box = "<div>" + "This box explains who we are and what we do. " * 3 + "</div>"
    story = lambda i, n: f"<p>Story {i} tells at some length of matters.</p>" * n
    got = main_texts(spark, [f"<article><h1>T{i}</h1>{story(i, 1 if i % 4 else 40)}{advert}{box}<p>Short.</p></article>" for i in range(24)])
    assert not any("weekly letter" in t or "who we are" in t for t in got.values())
    assert all(f"Story {i} tells" in t and "Short." in t for i, t in got.items())


def test_titles_are_no_furniture():
    read = lambda h: html_main.blocks(html_main.content(html_main.parse(h)), frozenset())
    kept = '<section id="related-work"><h2 id="discussion">A</h2><p>b</p></section><h2 id="social-impact">C</h2><section id="search-methods">d</section>'
    kept += '<h2 class="header">E</h2><p id="discussion">f</p><div class="notice">g</div><p class="tags">h</p>'
    assert read(f"<article><h1>T</h1>{kept}</article>") == ["T", "A", "b", "C", "d", "E", "f", "g", "h"]
    gone = '<div class="related"><a>x</a> <a>y</a></div><div class="related-posts">z</div><div class="share-buttons">s</div><div id="cookie-notice">c</div><div class="a newsletter">n</div>'
    assert read(f"<article><h1>T</h1>{gone}<p>end</p></article>") == ["T", "end"]
