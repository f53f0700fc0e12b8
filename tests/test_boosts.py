"""The product of boosts: each factor by literals, all of them against plain arithmetic."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_planted import same  # noqa: E402

from tessera.functions import text  # noqa: E402
from tessera.operators import boosts, retrieval, selection  # noqa: E402
from tessera.operators.boosts import Question  # noqa: E402

NAMES = [x.split()[0] for x in boosts.COLUMNS.split(", ")]


def boosts_of(spark, asked, *given):
    rows = [tuple({"similarity": 0.5, "type": "doctrine", **g}.get(n) for n in NAMES) for g in given]
    got = boosts.boosted_sources(spark.createDataFrame(rows, boosts.COLUMNS).coalesce(1), asked or Question()).collect()
    assert all(r.score == pytest.approx(0.5 * r.boost) for r in got)
    return [r.boost for r in got]


CASES = [
    (dict(), None, 1.0),
    (dict(type="code"), None, 1.3), (dict(type="unheard"), None, 0.85), (dict(type=None), None, 0.85),
    (dict(category="codes"), None, 1.08 * 1.02 * 1.10), (dict(category="constitution"), None, 1.08 * 1.08 * 1.10), (dict(category="jort"), None, 1.08 * 1.01 * 1.10),
    (dict(category="guides"), None, 0.97), (dict(category="jurisprudence", year=2026), None, 1.04 * 1.15), (dict(category="doctrine", year=2020), None, 0.97),
    (dict(category="codes", year=1955), None, 1.08 * 1.02 * 1.10), (dict(category="codes", year=1991), None, 1.08 * 1.02 * 1.10 * 1.075), (dict(category="codes", year=9999), None, 1.08 * 1.02 * 1.10),
    (dict(norm_level=" Constitution "), None, 1.08 * 1.35), (dict(norm_level="unheard"), None, 1.0),
    (dict(document_type="Arrêt de cassation"), None, 1.04), (dict(document_type="décret"), None, 1.08 * 1.01), (dict(doc_type="PROC"), None, 0.95),
    (dict(ocr_low=True, quality=10), None, 0.85 * 0.60), (dict(origin="cassation_tn", quality=80), None, 1.12 * 1.10),
    (dict(branch="fiscal"), Question(forbidden=["fiscal"]), 0.4), (dict(branch="fiscal"), Question(forbidden=["fiscal"], confidence=0.6), 1.0), (dict(branch="autre"), Question(forbidden=["autre"]), 1.0),
    (dict(branch="civil"), Question(allowed=["civil"]), 1.2), (dict(), Question(allowed=["civil"], forbidden=["fiscal"]), 1.0),
    (dict(doc_type="JURIS"), Question(stance="defense"), 1.04 * 1.3), (dict(category="lois"), Question(stance="attack"), 1.3), (dict(doc_type="JURIS"), Question(stance="neutral"), 1.04),
    (dict(category="procedures"), Question("Quel délai de recours"), 0.95 * 1.20), (dict(category="procedures"), Question("Quoi"), 0.95),
    (dict(category="codes", name="Le COC"), None, 1.08 * 1.02 * 1.10 * 1.25), (dict(name="Le COC"), None, 1.0),
    (dict(text="voir ARTICLE 217 ici"), Question("que dit l'Art. 217"), 1.8), (dict(text="الفصل 1"), Question("الفصل الأول"), 1.8), (dict(text="article 21"), Question("article 217"), 1.0),
    (dict(name="Code pénal annoté"), Question("une peine Pénale", domains=[(["pénal"], ["Code pénal"], 1.5)]), 1.5), (dict(name="Code pénal"), Question("un divorce", domains=[(["pénal"], ["Code pénal"], 1.5)]), 1.0),
    (dict(type="code", category="codes", name="COC", text="article 5", quality=90), Question("article 5"), 2.0),
]


def test_every_factor(spark):
    questions = {repr(asked): asked for _, asked, _ in CASES}
    for key, asked in questions.items():
        some = [(given, expected) for given, other, expected in CASES if repr(other) == key]
        assert boosts_of(spark, asked, *(g for g, _ in some)) == pytest.approx([e for _, e in some]), some


def test_cap_is_on_the_boost(spark):
    assert boosts_of(spark, Question("article 5"), dict(text="article 5", norm_level="constitution")) == [2.0]


def test_unknown_sources(spark):
    rows = spark.createDataFrame([tuple([None] * len(NAMES))] * 2, boosts.COLUMNS)
    assert [(r.boost, r.score) for r in boosts.boosted_sources(rows, Question("article 3", stance="attack", allowed=["x"], forbidden=["y"])).collect()] == [(0.85, None)] * 2
    assert boosts.boosted_sources(rows.filter(F.lit(False)), Question()).count() == 0


def column(spark, made, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
    return [r.y for r in df.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]


def test_article_bonus(spark):
    asked = F.lit("Que disent l'article 42 bis et الفصل ٢٥٨ ?")
    assert column(spark, lambda x: retrieval.article_bonus(asked, x), "Art. 42 Bis", "art 42", "فصل 258 et ARTICLE 42 bis", "الفصل ٢٥٨", "", None) == [1.25, 1.0, 1.35, 1.25, 1.0, 1.0]
    assert column(spark, lambda x: retrieval.article_bonus(F.lit("nothing"), x), "article 1") == [1.0]


def test_cap_of_factors(spark):
    assert spark.range(1).select(retrieval.boosted(F.lit(0.4), F.lit(3.0), F.lit(1.5)).alias("x")).first().x == pytest.approx(0.8)


def test_masks(spark):
    assert column(spark, text.mask_phone, "+33612345678", "1234567", "12345678", "", None) == ["+336***5678", "***", "1234***5678", "***", "***"]
    assert column(spark, text.mask_hash, "$2a$10$abcdefghxyz", "x" * 14, "x" * 15, "", None) == ["$2a$10$abcde***", "***", "x" * 12 + "***", "***", "***"]


def test_kinds_of_questions(spark):
    keyword = ["article 123", "see Art. 45", "code civil", "le Code pénal", "loi n° 2023", "décret n° 1234", "123", " 7 ", "tribunal commercial", "arrêt 12345", "arrêt n° 5", "x1فصل 123"]
    semantic = ["particle 12", "decode civil", "loi n° 20", "12345", "how do I appeal", "الفصل 12", "", "law 5"]
    assert column(spark, selection.query_kind, *keyword) == ["keyword"] * len(keyword)
    assert column(spark, selection.query_kind, *semantic) == ["semantic"] * len(semantic)


def test_queries_on_planted_rows(spark, tmp_path):
    terms = "the and of is to in that with for on"
    rows = [(i, f"The COC {i}\n{terms} {'pad ' * (i % 7)}{told}", f"src{i % 6}", ("en", "es", "fr")[i % 3]) for i, told in enumerate(["article 5", "!!", "1999", "الفصل ٥ and Article 5", "ARTICLE 12", "+33 6 12 34 56 78", "art. 5, الفصل 12", "2020", "", "+1 22"] * 3)]
    labels = [(i, i % 2, 0) for i in range(0, 30, 4)]
    tables = {"documents": (rows, "doc_id long, text string, source string, lang string"), "labels": (labels, "doc_id long, quality int, toxic int")}
    talk = [(1, i, "user", x) for i, x in enumerate(["article 5", "la loi", "code civil", "x1فصل 123", "الفصل 12", "décret n° 1234", "", None, "42"])]
    tables["conversations"] = (talk, "conv_id long, turn int, role string, text string")
    assert same(spark, tmp_path, "boosted_sources", tables) == 30
    assert same(spark, tmp_path, "article_reranked_search", tables) == 30
    assert same(spark, tmp_path, "masked_values", tables) == 30
    assert same(spark, tmp_path, "question_kinds", tables) == len(talk)
