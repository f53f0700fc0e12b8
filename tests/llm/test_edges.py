"""Queries on empty tables, null ids and texts, and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("n", "part", "hash", "key", "at", "media", "samples", "score", "mask", "length", "place", "item_id", "quality", "toxic")


def tables(spark, path, docs):
    some = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in CLASHING})
    some.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, *_ in docs if i is not None], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a question of nine words that nobody would ask\nand its answer")] if docs else [], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


ROWS = [(1, "Some text of a document.", "en", "s", 24), (2, None, None, None, None), (None, "Some text of a document.", "en", "s", 24), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
NAMES = ["op2_decontam", "op3_lines", "op6_tiff", "op8_pii", "op9_quality", "op12_language"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert queries()[name](spark, tables(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op2_decontam", "op9_quality")])
def test_odd_rows_and_clashing_columns(spark, tmp_path, name):
    got = queries()[name](spark, tables(spark, tmp_path, ROWS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 2), (False, 2), (False, 2), (True, 0)]


@pytest.mark.parametrize("name", ["op2_decontam", "op9_quality"])
def test_odd_rows_do_not_fail(spark, tmp_path, name):
    assert queries()[name](spark, tables(spark, tmp_path, ROWS)).count() <= len(ROWS)
