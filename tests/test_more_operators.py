"""Selection, references, sitemaps, robots, tables, semantic chunks."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, pages, references, selection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_query_kinds(spark):
    assert one(spark, selection.query_kind(F.lit("Article 12 of the code"))) == "keyword" and one(spark, selection.query_kind(F.lit("how do I appeal"))) == "semantic"
    assert one(spark, selection.expanded(F.lit("my car"), {"car": ["vehicle", "auto"], "house": ["home"]})) == "my car vehicle auto"


def test_merging(spark):
    a, b = (spark.createDataFrame(r, "id int, score double") for r in ([(1, 0.5), (2, 0.9)], [(1, 0.6), (3, 0.4)]))
    got = selection.merged({"a": a, "b": b}, {"b": 1.5}, 5, repealed=spark.createDataFrame([(2,), (2,)], "id int")).collect()
    assert [(r.id, r.source, round(r.score, 3)) for r in got] == [(1, "b", 0.9), (3, "b", 0.6), (2, "a", 0.1)]
    events = spark.createDataFrame([(1, "modified"), (1, "modified"), (2, "repealed")], "id int, kind string")
    assert {(r.id, r.modified) for r in selection.in_force(a, events).collect()} == {(1, True)}


def test_gate_and_boost(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "bad thing"), (1, 2, 0.8, "good thing"), (2, 1, 0.5, "bad"), (2, 3, 0.4, "bad")], "query_id int, id int, score double, text string")
    assert {(r.query_id, r.id) for r in selection.relevant(rows, ["good"], ["bad"], 0.9).collect()} == {(1, 2), (2, 1)}
    assert selection.relevant(rows, ["good"], ["bad"], 0.5).count() == 4
    edges = spark.createDataFrame([(2, 1, 0.8), (1, 3, 0.2)], "source int, target int, strength double")
    assert {(r.query_id, r.id): round(r.score, 3) for r in selection.graph_boosted(rows, edges).collect()}[(1, 2)] == pytest.approx(0.8 * 1.24)
    told = rows.selectExpr("*", "query_id AS source", "id = 2 AS contradicted")
    assert selection.spread_out(told, 5, {"source": 1}).count() == 2


def test_cache(spark):
    asked = spark.createDataFrame([(1, "q", "s", [1.0, 0.0]), (2, "r", "s", [0.99, 0.1]), (3, "x", "s", [0.0, 1.0]), (4, "q", "t", [1.0, 0.0])], "id int, text string, scope string, v array<double>")
    cache = spark.createDataFrame([("k", "q", "s", [1.0, 0.0], 1)], "key string, text string, scope string, v array<double>, at int")
    assert {r.id: (r.key, r.how) for r in selection.cached_answers(asked, cache, 0.9).collect()} == {1: ("k", "exact"), 2: ("k", "near"), 3: (None, "none"), 4: (None, "none")}


def test_gated_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (4, 2, 0.9)], "a int, b int, similarity double")
    facts = spark.createDataFrame([(1, "x", "en", ["p", "q"]), (2, "x", "en", ["p"]), (3, "x", "en", ["z"]), (4, "x", "en", None)], "id int, category string, language string, tags array<string>")
    assert {(r.a, r.b) for r in selection.gated_pairs(pairs, facts).collect()} == {(1, 2), (4, 2)}


def test_references(spark):
    df = spark.createDataFrame([(1, "See article 12 and Article 12, law 2005-95. This act repeals Law no 1999/12. It amends loi n° 93-1.")], "doc_id int, text string")
    assert {(r.kind, r.number, r.n) for r in references.cited(df).collect()} == {("article", "12", 2), ("law", "2005-95", 1), ("law", "1999/12", 1), ("law", "93-1", 1)}
    assert {(r.number, r.effect) for r in references.changed_laws(df).collect()} == {("1999/12", "repealed"), ("93-1", "amended")}
    assert one(spark, references.articles_numbered(F.lit("Article premier et article second"))) == "Article 1 et article 2"
    assert one(spark, references.without_boilerplate(F.lit("a\n- 12 -\nPage 3 of 9\nb ...... 4\n=====\nc"))) == "a\n\n\nb  \n\nc"
    assert one(spark, references.valid_date(F.lit("31/12/1999"))) and not one(spark, references.valid_date(F.lit("1999-02-31")))
    assert one(spark, references.valid_number(F.lit("2005-95"), "law")) and not one(spark, references.valid_number(F.lit("x"), "law"))


def test_timeline(spark):
    edges = spark.createDataFrame([(1, 2, "cites", True), (3, 2, "cites", True), (3, 1, "overrules", True), (4, 2, "cites", False)], "source int, target int, kind string, validated boolean")
    assert [tuple(r) for r in references.precedents(edges, 2).collect()] == [(2, 2, False), (1, 0, True)]
    days = spark.createDataFrame([(1, "d1"), (2, "d0"), (3, "d2")], "node int, day string")
    assert {(r.node, r.event, r.cited_by) for r in references.timeline(days, edges).collect()} == {(1, "standard", 0), (2, "standard", 3), (3, "overruling", 0)}


def test_sitemaps_and_robots(spark):
    xml = "<urlset><url><loc> http://a.org/x?a=1&amp;b=2 </loc><lastmod>2024-01-01</lastmod></url></urlset><sitemapindex><sitemap><loc><![CDATA[http://a.org/s.xml]]></loc></sitemap></sitemapindex>"
    got = pages.sitemap_urls(spark.createDataFrame([("p", xml)], "path string, xml string")).collect()
    assert {(r.kind, r.url, r.changed) for r in got} == {("page", "http://a.org/x?a=1&b=2", "2024-01-01"), ("sitemap", "http://a.org/s.xml", None)}
    robots = "User-agent: *\nDisallow: /p\nAllow: /p/open # yes\n\nUser-agent: mybot\nDisallow: /own\n"
    files = spark.createDataFrame([("a.org", robots)], "host string, text string")
    urls = spark.createDataFrame([("http://a.org/p/x",), ("http://a.org/p/open/y",), ("http://a.org/own",), ("http://b.org/p",)], "url string")
    ask = lambda agent: {r.url.split("/", 3)[3] + r.url[7]: r.allowed for r in pages.allowed(urls, pages.robots_rules(files, agent)).collect()}
    assert ask("otherbot") == {"p/xa": False, "p/open/ya": True, "owna": True, "pb": True}
    assert ask("MyBot/1.0")["owna"] is False and ask("MyBot/1.0")["p/xa"] is True


def test_page_parts(spark):
    html = "<h1>A <b>b</b></h1><table><tr><th>x</th><th>y|z</th></tr><tr><td>1</td></tr></table>"
    assert one(spark, pages.headings(F.lit(html))) == ["A b"]
    assert one(spark, pages.markdown_tables(F.lit(html))) == ["[TABLE]\n| x | y\\|z |\n| --- | --- |\n| 1 |  |\n[/TABLE]"]
    assert one(spark, pages.url_category(F.lit("http://a.org/News/12"))) == "news"
    df = spark.createDataFrame([(1, "http://a.org/my-docs/12/page_one.html")], "page_id int, url string")
    assert pages.breadcrumbs(df).first().crumbs == ["my docs", "page one"]
    docs = spark.createDataFrame([(1, "court and court and tax"), (2, "nothing")], "doc_id int, text string")
    got = pages.keyword_domains(docs, {"law": {"court": 2.0}, "money": {"tax": 1.0}}).collect()
    assert [(r.doc_id, r.domain, round(r.share, 2), r.dense) for r in got] == [(1, "law", 0.8, True)]


def test_semantic_groups(spark):
    rows = [(1, i, v, 5) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])]
    got = chunking.semantic_groups(spark.createDataFrame(rows, "doc_id int, n int, v array<double>, n_words int")).orderBy("n").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 1]
    assert chunking.long_parts("x" * 2000 + "\nArticle 1\n" + "y" * 3000, 100, 1500)[0] == "x" * 1500
