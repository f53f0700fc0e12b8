"""Ordinals, references, statements of repeal and status of legal texts: literals, and queries against their SQL on planted rows."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_planted import same  # noqa: E402

from tessera.operators import legal  # noqa: E402


def each(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", function(F.col("text")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_ordinals(spark):
    given = {
        "Article premier, PREMIÈRE; Chapitre deuxième": "Article 1, 1; Chapitre 2",
        "dix-septième, vingt et  unième, vingt-deuxième, soixante-neuvième": "17, 21, 22, 69",
        "secondement, premièrement, trentième2, x_second": "secondement, premièrement, trentième2, x_second",
        "second second\nsecond": "2 2\n2",
        "الفصل الأول الباب ثاني": "الفصل 1 الباب 2",
        "الفصل الثاني عشر، الفصل الثالث عشر، الفصل الحادي والعشرون، خامس وعشرون": "الفصل 12، الفصل 13، الفصل 21، 25",
        "الأولى": "الأولى",
        "a\x01b\x02a second \x02b\x01": "a\x01b\x02a 2 \x02b\x01",
        "": "",
        None: None,
    }
    assert each(spark, legal.ordinals_as_digits, given) == list(given.values())


def test_trie_takes_the_longest():
    import re

    known = legal.ordinals()
    pattern = re.compile(legal.trie(known))
    assert all(pattern.fullmatch(word) for word in known) and 100 < len(known) < 200
    assert pattern.match("الثاني عشر").group() == "الثاني عشر" and pattern.match("seconde").group() == "seconde"
    assert (known["quarante et unième"], known["الثلاثون"], known["تاسع عشر"], known["التاسع والثلاثون"]) == (41, 30, 19, 39)


def test_articles_and_gazette(spark):
    given = {"ART. 52 bis, art 7 - 9; smart 5": "Article 52 bis, Article 7 - 9; smart 5", "فصل 52 مكرر و الفصل 3": "الفصل 52 مكرر و الفصل 3", "Article 52-1": "Article 52-1", None: None}
    assert each(spark, legal.article_numbers, given) == list(given.values())
    printed = "Journal Officiel de la République Tunisienne n 5\nkept\n- 12 -\nx..... 42\nPage 3 sur 9\n=====\ny\n\n\n\n\nz\n"
    assert each(spark, legal.without_gazette, [printed, "a\nصفحة 4 من\nb", "", None]) == ["kept\nx\ny\n\n\nz", "a\n\nb", "", None]


TEXTS = [
    "La Loi n°2016-36 et L.2017-58 régissent...",
    "Circulaire n°216 du 5 novembre 1973",
    "القانون عدد 58 لسنة 2017 والقانون رقم 36 لسنة 2016",
    "Article 207 du Code Pénal et Article 30 du CSP",
    "Texte juridique sans références spécifiques",
    "Cette loi a été abrogée par la Loi n°2016-36",
    "Le décret a été remplacé par le Décret n°2020-30",
    "القانون ألغي بموجب القانون عدد 58",
    "Loi en vigueur sans mention d'abrogation",
    "La Loi n°1968-07 a été abrogée par la Loi n°2016-36. Selon la loi n° 1968-07, tout est dit.",
    "cette loi est abrogée par la loi n° 2016-36 du 5/3/2016, et modifiée par la loi n° 2018-1 du 01-12-2018",
    "abrogé depuis le 31-12-1999", "modifiée par la loi n° 2018-1 du 1/2/2018", "complétée par", "suspendue temporairement jusqu'au soir", "معلق إلى حين",
    "تم تنقيح بمقتضى القانون عدد 12", "ينقح هذا القانون", "ألغي ابتداء من تاريخ", "les dispositions de l'article 9 sont abrogées",
    "Le Décret n°1999-12 n’est plus en vigueur; la LOI\xa0n°2001-9, caduque depuis lors; Loi n°1968-07, " + "x" * 60 + " abrogé par rien",
    "الفصل 3 مكرر من القانون عدد 9. الفصل 4 ثالثا", "Art. 5 premier\nPage 2 sur 3\nsecond second فصل 7", "abrogée selon a, abrogé par b. Loi 2001-1 Loi 2001-1", "", None, "",
]


def test_literals(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    refs = {(r.doc_id, r.kind, r.language, r.reference) for r in legal.legal_references(docs).collect()}
    assert {(0, "loi", "fr", "Loi n°2016-36"), (0, "loi", "fr", "L.2017-58"), (1, "circulaire", "fr", "Circulaire n°216"), (3, "article", "fr", "Article 30"), (21, "article", "ar", "الفصل 4 ثالثا")} <= refs
    assert sum(r[0] == 2 and r[2] == "ar" for r in refs) == 2 and not any(r[0] == 4 for r in refs)
    assert (3, "article", "fr", "Article 207") not in refs and (21, "article", "ar", "الفصل 3 مكرر") not in refs
    keys = {r.key for r in legal.legal_references(spark.createDataFrame([(1, "Code\n Pénal; LOI\xa0n°2001-9")], "doc_id int, text string")).collect()}
    assert keys == {"code pnal", "loi n20019"}
    says = {(r.doc_id, r.by) for r in legal.repeal_statements(docs).collect()}
    assert {(5, "la Loi n°2016-36"), (6, "le Décret n°2020-30"), (7, "القانون"), (20, None)} <= says and not any(i in (4, 8) for i, _ in says)
    found = each(spark, legal.legal_status, TEXTS)
    assert (found[10].status, found[10].by, found[10].day, found[12].status, found[12].day) == ("abrogated", "2016-36", "2016-03-05", "modified", "2018-02-01")
    assert [found[i].status for i in (11, 13, 14, 15, 16, 17, 18, 19, 4, 24, 25)] == ["abrogated", "modified", "suspended", "suspended", "modified", "modified", "abrogated", "abrogated", "active", "active", "unknown"]


def test_repealed(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {(r.doc_id, r.reference, r.scope, r.severity) for r in legal.repealed_references(legal.legal_references(docs), legal.repeals_told(docs)).collect()}
    assert {(9, "Loi n°1968-07", "total", "high"), (20, "Loi n°1968-07", "total", "high"), (20, "Décret n°1999-12", "implicit", "low")} <= got
    assert not any(reference == "Loi n°2016-36" for _, reference, *_ in got)


def test_queries(spark, tmp_path):
    tables = {"documents": (list(enumerate(TEXTS)), "doc_id long, text string")}
    assert same(spark, tmp_path, "legal_statuses", tables) == len(TEXTS)
    assert same(spark, tmp_path, "normalized_provisions", tables) == len(TEXTS)
    assert same(spark, tmp_path, "legal_references", tables) > 15
    assert same(spark, tmp_path, "repeal_statements", tables) > 8
    assert same(spark, tmp_path, "repealed_references", tables) == 4


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert legal.repealed_references(legal.legal_references(docs), legal.repeals_told(docs)).count() == 0
