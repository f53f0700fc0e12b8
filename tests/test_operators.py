"""Operators on literals and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import finance, text, vectors
from tessera.operators import chunking, evaluation, graph, pages, retrieval, similar
from tessera.sources import tables


def one(spark, column, **values):
    df = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_arabic_normal(spark):
    assert one(spark, text.arabic_normal("t"), t="أَحْمَد  إلى ٢٠٢٤") == "احمد الي 2024"
    assert one(spark, text.normal_space("t"), t="a​ b\t\n“c” – d") == 'a b "c" - d'


@pytest.mark.parametrize(("t", "want"), [("", "fr"), ("123", "fr"), ("bonjour", "fr"), ("مرحبا", "ar"), ("abcde مرحبا", "mixed")])
def test_script_language(spark, t, want):
    assert one(spark, text.script_language("t"), t=t) == want


def test_strict_language(spark):
    assert one(spark, text.script_language_strict("t"), t="short") is None
    assert one(spark, text.script_language_strict("t"), t="a" * 60) == "fr"
    assert one(spark, text.script_language_strict("t"), t="a" * 30 + "م" * 30) == "mixed"


@pytest.mark.parametrize(("raw", "want"), [("+216 20 123 456", "+21620123456"), ("0021620123456", "+21620123456"), ("21620123456", "+21620123456"), ("20-123-456", "+21620123456"), ("12", "12"), ("10123456", "10123456"), ("020123456", "020123456"), ("+33 1 23 45", "+3312345"), ("216 71 123 456", "+21671123456"), (None, None)])
def test_phone(spark, raw, want):
    assert one(spark, text.phone_e164(F.lit(raw).cast("string"))) == want


def test_masks_and_urls(spark):
    assert one(spark, text.mask_email(F.lit("jane@x.org"))) == "j***@x.org"
    assert one(spark, text.mask_token(F.lit("abcdefghijkl"))) == "abcd***ijkl" and one(spark, text.mask_token(F.lit("short"))) == "***"
    assert one(spark, text.normal_url(F.lit("HTTP://Ex.org/A/?utm_source=x&b=1&ref=2#top"))) == "http://ex.org/A/?b=1"
    assert one(spark, text.in_scope(F.lit("http://a.org/docs/x"), "a.org", "/docs/")) and not one(spark, text.in_scope(F.lit("http://a.org/docs2"), "a.org", "/docs"))


def test_links(spark):
    html = '<a href="/x?utm_source=1">a</a><a href="mailto:q@x.org">m</a><a href="y.pdf">b</a><a class=k href=\'http://o.org/\'>c</a><a href="#f">d</a>'
    df = spark.createDataFrame([(1, "http://a.org/p/q", html)], "page_id long, url string, html string")
    assert {(r.target, r.internal) for r in pages.links_of(df).collect()} == {("http://a.org/x", True), ("http://a.org/p/y.pdf", True), ("http://o.org", False)}
    assert [r.kind for r in pages.linked_files(df).collect()] == ["pdf"]


def test_gates(spark):
    assert one(spark, pages.ban_signal(F.lit(429), F.lit(""))) == "blocked" and one(spark, pages.ban_signal(F.lit(200), F.lit("Solve this CAPTCHA"))) == "captcha"
    assert one(spark, pages.change_share(F.lit("a\nb"), F.lit("b\nc"))) == pytest.approx(2 / 3) and one(spark, pages.change_share(F.lit(""), F.lit(None))) == 0
    assert one(spark, graph.backoff_seconds(F.lit(3))) == 8 and one(spark, graph.backoff_seconds(F.lit(30))) == 60
    assert one(spark, pages.crawl_stage(F.lit(500), F.lit(0.9), F.lit(3), F.lit(1), F.lit(False))) == "chunked"


def test_finance(spark):
    assert one(spark, finance.interest(F.lit(1000.0), F.lit(14.5), F.lit(365))) == 145.0 and one(spark, finance.interest(F.lit(-1.0), F.lit(1.0), F.lit(1))) == 0
    assert one(spark, finance.child_support(F.lit(1000.0), F.lit(2))) == 125.0 and one(spark, finance.child_support(F.lit(1000.0), F.lit(0))) is None
    assert one(spark, finance.years_by_calendar(F.lit("2000-01-01").cast("date"), F.lit("2010-07-01").cast("date"))) == 10.5
    assert one(spark, finance.risk_score([(F.lit(None).cast("double"), 0.5), (F.lit(0.4), 0.2)])) == pytest.approx(0.4)


def test_deadlines(spark):
    days = finance.calendar(spark, "2024-01-01", "2024-12-31", ["05-01"], ("08-01", "08-31"))
    rows = spark.createDataFrame([("2024-04-29",), ("2024-07-31",), ("2024-05-03",)], "d string").withColumn("d", F.to_date("d"))
    got = {str(r.d): str(r.deadline) for r in finance.business_deadline(rows, days, "d", 2).collect()}
    assert got == {"2024-04-29": "2024-05-02", "2024-07-31": "2024-09-03", "2024-05-03": "2024-05-07"}
    clear = {str(r.d): str(r.deadline) for r in finance.business_deadline(rows, days, "d", 2, clear=True).collect()}
    assert clear["2024-05-03"] == "2024-05-08"
    assert {str(r.d): str(r.deadline) for r in finance.calendar_deadline(rows, days, "d", 2).collect()}["2024-04-29"] == "2024-05-02"


def test_chunks(spark):
    assert chunking.by_sentences("One two. Three four! Five", 4) == ["One two. Three four!", "Five"]
    assert chunking.by_paragraphs("a b\n\nc d e f g", 3) == ["a b", "c d e", "f g"]
    assert chunking.by_headings("intro\nArticle 1 x\nbody\nArticle 2\nmore", 50) == ["intro", "Article 1 x\nbody", "Article 2\nmore"]
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.chunk, r.content) for r in chunking.word_windows(df, 3, 1).collect()] == [(0, "a b c"), (1, "c d e"), (2, "e")]
    assert chunking.packed_chunks(df, "sentences", 2).count() == 3
    told = spark.createDataFrame([(1, "\f".join(f"{i} " * 12 for i in range(5)))], "doc_id long, text string")
    assert chunking.page_groups(told).count() == 2
    with pytest.raises(ValueError):
        chunking.word_windows(df, 3, 3)


def test_measures(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert one(spark, evaluation.recall_at(a(1, 2, 3), a(2, 9, 2), 2)) == pytest.approx(2 / 3)
    assert one(spark, evaluation.recall_at(a(), a(), 5)) == 1 and one(spark, evaluation.precision_at(a(), a(1), 5)) == 0
    assert one(spark, evaluation.reciprocal_rank(a(5, 6, 7), a(7, 6))) == 0.5 and one(spark, evaluation.reciprocal_rank(a(5), a(7))) == 0
    assert one(spark, evaluation.share_found(F.array(F.lit("X y"), F.lit("no")), F.lit("an x Y"))) == 0.5


def test_retrieval_parts(spark):
    assert one(spark, retrieval.quality_boost(F.lit(None).cast("int"))) == 1.0 and one(spark, retrieval.quality_boost(F.lit(10))) == 0.6
    assert one(spark, retrieval.recency_boost(F.lit(2026))) == pytest.approx(1.15) and one(spark, retrieval.effective_similarity(F.lit(None).cast("double"), F.lit(0.04))) == 0.4
    assert one(spark, retrieval.citation_support(F.lit("law 12 of 1990"), F.lit("The Law 12 of 1990 says"))) == 1.0
    assert one(spark, retrieval.citation_support(F.lit("in 1990 something odd happened there"), F.lit("only 1990 here, and much else again"))) == 0.6
    rows = spark.createDataFrame([(1, 1, 0.9, 60), (1, 2, 0.8, 50), (1, 3, 0.7, 40)], "query_id long, id long, score double, tokens long")
    assert retrieval.packed_context(rows, 100).first().ids == [1, 3]


def test_pagerank(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "c")]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), most=200, tolerance=1e-9).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    links = sorted(set(edges))
    for _ in range(300):
        out = {n: sum(s == n for s, _ in links) for n in rank}
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[s] / out[s] for s, d in links if d == n) for n in rank}
    assert all(math.isclose(got[n], rank[n], rel_tol=1e-5) for n in rank)


def test_clusters_and_pairs(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    points = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 4]] if i < 24 else [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    points.append((99, points[0][1]))
    df = spark.createDataFrame(points, "vec_id long, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    pairs = similar.similar_pairs(df, 0.9)
    want = {(i, j) for i, a in points for j, b in points if i < j < 99 and cos(a, b) >= 0.9}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r["class"] for r in similar.vector_classes(df).filter("id = 99").collect()} == {0}
    clusters = {r.node: r.cluster for r in graph.density_clusters(df.selectExpr("vec_id AS node"), pairs.select("a", "b")).collect()}
    assert all(clusters[i] == i % 4 for i in range(24)) and all(clusters[i] == -1 for i in range(24, 30))


def test_tree_and_crawl(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "code string, parent string, label string")
    assert {(r.code, r.depth, r.path) for r in graph.tree_paths(nodes).collect()} == {("a", 0, "A"), ("b", 1, "A > B"), ("c", 2, "A > B > C")}
    links = spark.createDataFrame([("s", "t"), ("t", "s"), ("t", "u"), ("u", "v")], "source string, target string")
    assert {(r.url, r.depth) for r in graph.crawl_order(spark, links, ["s"], 2).collect()} == {("s", 0), ("t", 1), ("u", 2)}


def test_vectors_and_sources(spark, tmp_path):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    (tmp_path / "a.csv").write_text('x,y\n1,"a, ""b"""\n2,c\n')
    assert [tuple(r) for r in tables.csv_file(spark, str(tmp_path / "a.csv"), "x int, y string").collect()] == [(1, 'a, "b"'), (2, "c")]
    (tmp_path / "b.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert tables.json_file(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 x")
    assert tables.files(spark, str(tmp_path), "*.pdf").first()["kind"] == "pdf"
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "z", 1), (2, "y", 0), (3, "c", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in tables.upsert(base, new, ["k"], "n").collect()} == {(1, "z"), (2, "b"), (3, "c")}
    assert {(r.k, r.v) for r in tables.updated(base, new.filter("k = 2"), "k", ["v"]).collect()} == {(1, "a"), (2, "y")}
    tables.export(base, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


ARABIC = "م"


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("short", 0.0),
        (None, 0.0),
        ("a plain sentence that says something useful " * 4, 0.0),
        ("x" * 100 + " Imprimerie Officielle de la République Tunisienne", 0.5),
        ("ab " * 60, 0.35),
        ("ab " * 60 + "abc " * 50, 0.2),
        ("ab " * 40 + "abc", 0.0),  # not over 50 tokens
        ("word " * 52 + "12 " * 10, 0.15),
        ("word " * 60 + "1234 " * 20, 0.0),
        (f"{ARABIC} {ARABIC} {ARABIC}x " * 21, 0.65),
        ("word " * 40 + "= " * 4, 0.1),
        ("word " * 20 + "=" * 4, 0.2),
        (f"{ARABIC} A {ARABIC}" * 16 + "x" * 40, 0.25),
    ],
)
def test_corruption(spark, t, want):
    from pyspark.sql import functions as F

    assert one(spark, text.corruption_score(F.lit(t).cast("string"))) == want


def test_gate_rules_chunks_links(spark):
    from pyspark.sql import functions as F

    from tessera.operators import chunking, pages, retrieval

    gate = lambda words, found, lang, vectors: one(spark, F.round(retrieval.quality_gate(F.lit(words), F.lit(found), F.lit(lang), F.lit(vectors)), 6))
    assert [gate(9, 9, "ar", True), gate(9, 9, "ar", False), gate(9, 9, "fr", True), gate(9, 9, "fr", False)] == [0.20, 0.22, 0.25, 0.30]
    assert gate(3, 2, "fr", True) == round(0.25 * 0.85 * 0.9, 6) and gate(3, 2, "ar", True) == 0.153
    page = spark.createDataFrame([("http://a.org/x/1", "T", None, ["x"])], "url string, title string, headings string, crumbs array<string>")
    rules = [
        {"name": "r", "category": "c", "conditions": [("url_contains", "a.org", False), ("url_contains", "b.org", True)], "boost": 0.2},
        {"name": "none", "category": "c", "conditions": []},
        {"name": "no", "category": "c", "conditions": [("url_contains", "a.org", True), ("breadcrumb_exact", "x", False)]},
    ]
    assert [(r.rule, r.confidence) for r in pages.apply_rules(page, rules).collect()] == [("r", 0.7)]
    rows = [(1, 0, "word " * 40), (1, 1, "word " * 39), (1, 2, "| --- |\n|  |"), (1, 3, "tail"), (2, 0, "|---|"), (3, 0, "x | الفصل 12 | [codes]\n---\nالفصل 12"), (3, 1, "end")]
    kept = chunking.kept_chunks(spark.createDataFrame(rows, "doc_id long, chunk int, content string")).collect()
    assert sorted((r.doc_id, r.chunk, r.content[:4]) for r in kept) == [(1, 0, "word"), (1, 1, "tail"), (3, 0, "end")]
    url = "http://a.org/p/q/r.html?z=1"
    want = {"../x": "http://a.org/p/x", "./y": "http://a.org/p/q/y", "?k=2": "http://a.org/p/q/r.html?k=2", "/a/../b": "http://a.org/b", "s?a=1&amp;b=2": "http://a.org/p/q/s?a=1&b=2", "//o.org/x": "http://o.org/x", "..": "http://a.org/p/", "../../../up": "http://a.org/up", "https://q/../x": "https://q/../x"}
    for link, target in want.items():
        assert one(spark, pages.absolute(F.lit(link), F.lit(url))) == target, link
    assert one(spark, pages.absolute(F.lit("x"), F.lit("http://a.org"))) == "http://a.org/x"
