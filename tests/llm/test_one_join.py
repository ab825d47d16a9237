"""Disk grows with the pages: html is dealt alike at any size."""

from entwine.llm import html_main

from .test_templates import PAGES, site


def test_few_pages_are_joined_as_many_are(spark):
    df = html_main.extract(spark.createDataFrame(site(40), PAGES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert df.count() == 42


def test_html_travels_compressed_and_comes_back_whole(spark):
    texts = [None, "", "x", "<p>Ünïcode \U0001f600</p>" * 5000]
    pages = spark.createDataFrame([(n, n, None, x) for n, x in enumerate(texts)], "k long, page_id long, url string, html string")
    rows = {r.page_id: r for r in html_main.zipped(pages).collect()}
    assert [html_main.unzipped(rows[n].zipped, rows[n].size) for n in range(4)] == [x or "" for x in texts]
    assert len(rows[3].zipped) < len(texts[3]) / 100
    plan = html_main.extract(spark.createDataFrame(site(40), PAGES))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("SortMergeJoin")[0].split("\n") if "html" in x]
