"""Chunks by kind, compression, thresholds, changes, JSON predicates, files and calculators, by values worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import finance
from tessera.operators import filters, pages, routing
from tessera.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


def test_settings(spark):
    got = [(one(spark, routing.chunk_size(F.lit(c).cast("string"))), one(spark, routing.chunk_overlap(F.lit(c).cast("string")))) for c in ("Codes", "jort", "nothing", None)]
    assert got == [(600, 100), (500, 80), (1200, 50), (1200, 50)]


def test_tables_stand_alone():
    before, after = words(10, "before"), words(11, "after")
    got = routing.route(f"{before}\n[TABLE]\n| a | b | " + "c | " * 9 + "x" * 3000 + f"[/TABLE]\n{after} [TABLE] | | [/TABLE]", "adaptive", 100, 10)
    assert [k for k, _, _ in got] == ["text", "table", "text"]
    assert got[0][2] == before and len(got[1][2]) == 2000 and got[2][2] == after
    # Parts of a text with tables that have under ten words or five letters go.
    assert routing.route(f"before\n[TABLE]| a | b |[/TABLE]\n{'1 ' * 20}", "adaptive", 100, 10) == []
    assert routing.route("", "article", 10, 2) == routing.route(" \n", "page", 10, 2) == []


def test_paragraphs_overlap_and_follow_articles():
    text = f"Article 1\n{words(50, 'a')}\n\n{words(60, 'b')}\n\nArticle 2 bis\n{words(50, 'c')}"
    got = routing.route(text, "adaptive", 100, 5)
    assert [n for _, n, _ in got] == ["1", "2 bis", "2 bis"]  # a chunk bears the last heading seen when it ends
    assert got[1][2].startswith("a45 a46 a47 a48 a49\n\nb0") and got[2][2].startswith("b55 b56 b57 b58 b59\n\nArticle 2 bis")
    assert routing.route("short text", "adaptive", 100, 5) == [("text", None, "short text")]


def test_small_chunks_go_unless_last():
    long = ". ".join(words(30, f"s{i}x") for i in range(4)) + "."
    got = routing.route(f"{words(10, 'a')}\n\n{long}\n\n{words(5, 'z')}", "adaptive", 60, 0)
    assert [len(c.split()) for _, _, c in got] == [60, 60, 5]


def test_articles():
    first = f"Article 1\n{words(8, 'a')}"
    text = f"preamble\n{first}\nart. 2 bis {words(130)}"
    got = routing.route(text, "article", 100, 10)
    assert [n for _, n, _ in got] == ["1", "2 bis"] or [n for _, n, _ in got] == ["1", "2 bis", "2 bis"]
    assert got[0][2] == first and got[1][2].startswith("[Article 2 bis (partie 1/")
    arabic = routing.route(f"الفصل 5 :\n{'نص ' * 9}\nالفصل الأول :\n{'آخر ' * 9}", "article", 100, 10)
    assert routing.route("Article 1\nshort\nArticle 2\nshort too", "article", 100, 10) == []
    assert [n for _, n, _ in arabic] == ["5", "الأول"]
    assert routing.route("no headings here", "article", 100, 10) == [("text", None, "no headings here")]


def test_pages():
    text = "cover" + "".join(f"--- Page {i} ---\n{words(12 if i != 2 else 3)}\n" for i in range(1, 6))
    got = routing.route(text, "page", 1000, 0)
    assert [c.count("--- Page") for _, _, c in got] == [3, 1] and "--- Page 2" not in got[0][2] and "cover" not in got[0][2]


def test_routed_chunks(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "some text", "codes", "page"), (2, "some text", "codes", None)], "doc_id int, text string, category string, strategy string")
    assert [(r.doc_id, r.chunk, r.kind, r.n_words, r.content) for r in routing.routed_chunks(docs).collect()] == [(2, 0, "text", 2, "some text")] * 2
    assert routing.routed_chunks(docs.limit(0)).count() == 0


def test_compression(spark):
    assert routing.sentence_score("the contract [Source-1] binds", "contract law") == pytest.approx(0.5)  # a term and a citation
    assert routing.compressed("short", "x") == "short"
    text = "Nothing of note here at all. The contract binds both parties. " + "filler words that say little. " * 20 + "See the ruling [Source-3] now."
    assert routing.compressed(text, "contract", most=20) == "The contract binds both parties. See the ruling [Source-3] now.."
    docs = spark.createDataFrame([(1, None), (2, "abc")], "doc_id int, text string")
    assert {(r.doc_id, r.n_before, r.content) for r in routing.compressed_texts(docs, "q").collect()} == {(1, 0, ""), (2, 3, "abc")}


def test_thresholds(spark):
    bar = lambda c, d, **k: one(spark, pages.threshold(F.lit(c).cast("string"), F.lit(d).cast("string"), **k))
    assert bar("legislation", "penal") == 0.73 and bar("legislation", "nowhere") == 0.75 and bar(None, None) == 0.70 and bar("doctrine", None, quality=True) == 70


@pytest.mark.parametrize(("old", "new", "kind"), [(None, "a", "new"), ("a\nb", "b\n a", "none"), ("a", "a\nloi ABROGÉE", "repeal"), ("abrogé", "abrogé\nb", "major"), ("\n".join(map(str, range(40))), "\n".join(map(str, range(41))), "minor"), ("a", "ملغى", "repeal")])
def test_change_kinds(spark, old, new, kind):
    assert one(spark, pages.change_kind(F.lit(old).cast("string"), F.lit(new))) == kind


def test_json_predicates(spark):
    rows = spark.createDataFrame([(1, '["a","b"]', '[{"type":"pdf","done":false}]'), (2, "[]", "[]"), (3, None, None), (4, '["b"]', '[{"type":"pdf","done":true},{"type":"png"}]')], "id int, j string, o string")
    assert [r.id for r in rows.filter(filters.holds_all("j", ["b"])).collect()] == [1, 4]
    assert [r.id for r in rows.filter(filters.holds_all("j", ["a", "b"])).collect()] == [1]
    open_ = filters.any_object("o", "type string, done boolean", lambda f: f["type"].isin("pdf", "docx") & ~F.coalesce(f["done"], F.lit(False)))
    assert [r.x for r in rows.orderBy("id").select(open_.alias("x")).collect()] == [True, False, False, False]


def test_amounts(spark):
    years, income = F.lit(10.5), F.lit(2000.0)
    assert one(spark, finance.compensation(years, income)) == 42000.0 and one(spark, finance.compensation(F.lit(0.0), income)) == 0.0
    assert tuple(one(spark, finance.support_band(F.lit(2000.0), F.lit(3)))) == (166.67, 500.0, 133.33, 200.0)
    assert tuple(one(spark, finance.support_band(F.lit(2000.0), F.lit(0)))) == (0.0, 0.0, 0.0, 0.0)
    owed = finance.interest(F.lit(10000.0), F.lit(14.5), F.lit(365))
    assert one(spark, owed) == 1450.0 and one(spark, finance.amount_due(F.lit(10000.0), owed)) == 11490.0
    assert one(spark, finance.statutory_interest(F.lit(1000.0), F.lit(None).cast("double"), F.lit(-365))) == -145.0


def test_answer_risk(spark):
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    told = lambda **signs: tuple(one(spark, finance.answer_risk(signs)))
    assert told(low_similarity=yes, single_source=yes, sensitive_topic=no, source_conflict=unknown) == (0.5, "medium")
    assert told(**dict.fromkeys(finance.SIGNS, yes)) == (1.0, "high") and told(single_source=yes) == (0.2, "low")


def test_files(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three &amp; four</w:t></w:r></w:p></w:body></w:document>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", body)
    for name, content in {"a.docx": made.getvalue(), "b.zip": b"PK\x03\x04broken", "c.txt": "é text".encode(), "d.bin": b"%PDF-1.7"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in tables.parsed_files(tables.files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("zip", "One\ttwo\nThree & four"), "b.zip": ("zip", None), "c.txt": ("text", "é text"), "d.bin": ("pdf", None)}


def test_deleted(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert {r.id for r in tables.deleted(rows, spark.createDataFrame([(1,), (1,), (None,)], "id int"), "id").collect()} == {2, None}
