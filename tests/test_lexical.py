"""The persistent index against ranking from the texts, and containment against Python's."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import containment, lexical
from tessera.operators.containment import containing, window_hashes
from tessera.operators.lexical import forget_documents, index_documents, indexed_matches, indexed_search, merge_segments, opened
from tessera.operators.retrieval import bm25

TERMS = ["alpha", "beta", "état", "7"]


def made(rng, ids):
    return [(i, rng.choice([None, "", "!!"]) if rng.random() < 0.1 else " ".join(rng.choice(["alpha", "Beta", "gamma,delta", "état", "7", "x"]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "fr"])) for i in ids]


SCHEMA = "doc_id long, text string, lang string"


def same(spark, path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r["doc_id"]: r["score"] for r in bm25(docs, TERMS).collect()}
    assert {r["doc_id"]: r["score"] for r in indexed_search(spark, path, TERMS).collect()} == want
    top = [tuple(r) for r in indexed_search(spark, path, TERMS, 5).collect()]
    assert top == [tuple(r) for r in bm25(docs, TERMS, 5).collect()]
    english = {r[0] for r in rows if r[2] == "en"}
    assert {r["doc_id"]: r["score"] for r in indexed_search(spark, path, TERMS, where=F.col("lang") == "en").collect()} == {k: v for k, v in want.items() if k in english}


def test_segments(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "index")
    assert indexed_search(spark, path, TERMS).count() == 0
    first, second = made(rng, range(60)), made(rng, range(40, 90))
    index_documents(spark.createDataFrame(first, SCHEMA), path, ["lang"], buckets=7)
    same(spark, path, first)
    index_documents(spark.createDataFrame(second, SCHEMA), path, ["lang"])
    now = [r for r in first if r[0] < 40] + second
    same(spark, path, now)
    assert forget_documents(spark.createDataFrame([(5,), (50,), (5000,)], "doc_id long"), path) == 2
    now = [r for r in now if r[0] not in (5, 50)]
    same(spark, path, now)
    index_documents(spark.createDataFrame([(5, "alpha alpha", "en")], SCHEMA), path, ["lang"])
    now.append((5, "alpha alpha", "en"))
    same(spark, path, now)
    assert len(opened(spark, path).segments) == 4
    merge_segments(spark, path)
    assert len(opened(spark, path).segments) == 1 and merge_segments(spark, path) is None
    same(spark, path, now)
    index_documents(spark.createDataFrame([(7, None, "en")], SCHEMA), path, ["lang"])
    same(spark, path, [r for r in now if r[0] != 7] + [(7, None, "en")])
    docs = [r for r in now if r[0] != 7]
    words = {r[0]: set((r[1] or "").lower().replace(",", " ").split()) for r in docs}
    assert {r[0] for r in indexed_matches(spark, path, ["alpha", "beta"]).collect()} == {i for i, w in words.items() if {"alpha", "beta"} <= w}
    assert {r[0] for r in indexed_matches(spark, path, ["alpha", "beta"], every=False).collect()} == {i for i, w in words.items() if {"alpha", "beta"} & w}


def test_only_asked_buckets_are_read(spark, tmp_path, capsys):
    path = str(tmp_path / "index")
    index_documents(spark.createDataFrame([(i, f"word{i} alpha", "en") for i in range(50)], SCHEMA), path)
    indexed_search(spark, path, ["alpha"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters", 1)[1] and "term" in plan.split("PushedFilters", 1)[1]


def test_unfinished_segments_are_not_seen(spark, tmp_path, monkeypatch):
    rng, path = random.Random(2), str(tmp_path / "index")
    rows = made(rng, range(20))
    index_documents(spark.createDataFrame(rows, SCHEMA), path, ["lang"])
    with monkeypatch.context() as m:
        m.setattr(lexical, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            index_documents(spark.createDataFrame(made(rng, range(10, 30)), SCHEMA), path, ["lang"])
    same(spark, path, rows)
    for bad in ([(1, "a", "en"), (1, "b", "en")], [(None, "a", "en"), (3, "b", "en")]):
        with pytest.raises(ValueError):
            index_documents(spark.createDataFrame(bad, SCHEMA), path, ["lang"])
    index_documents(spark.createDataFrame([], SCHEMA), path, ["lang"])
    same(spark, path, rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_windows_of_equal_bytes_hash_alike(data):
    array = np.frombuffer(data, np.uint8)
    for k, hashes in window_hashes(array, {0, 1, 3, 5}):
        of = {}
        assert len(hashes) == max(0, len(data) - 2**k + 1)
        for i, x in enumerate(hashes.tolist()):
            assert of.setdefault(data[i : i + 2**k], x) == x
        assert len(set(of.values())) == len(of)


def test_containing(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", 64)
    rng = random.Random(3)
    bits = ["state-of-the-art", "Law No. 2004-12", "loi n° 98", "line\nfeed", "a", "é", "12", " ", "the ", "\U0001f600", "x" * 300]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(60)] + [(100, None), (101, "")]
    needles = [(f"n{i}", "".join(rng.choice(bits) for _ in range(rng.choice([1, 1, 2, 3])))) for i in range(80)] + [("none", None), ("empty", ""), ("same", "a"), ("long", "x" * 600 + "a"), ("absent", "zzzz")]
    got = containing(spark.createDataFrame(needles, "needle_id string, needle string"), spark.createDataFrame(texts, "text_id long, text string"))
    want = {(n, t) for n, needle in needles for t, text in texts if needle and text is not None and needle in text}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300
    none = spark.createDataFrame([], "needle_id string, needle string")
    assert containing(none, spark.createDataFrame(texts, "text_id long, text string")).count() == 0


def test_false_hits_of_many_needles_are_rare():
    """With one bit a needle, 6 of 1,000 windows that no needle has went on as rows here, and their share grew with the needles."""
    rng = np.random.default_rng(4)
    needles = pa.RecordBatch.from_pydict({"hash": rng.integers(-(1 << 63), 1 << 63, 200_000)})
    known = np.zeros(1 << containment.FILTER_BITS, np.uint8)
    for marks in containment._marks(iter([needles])):
        known[(marks["part"].to_numpy().astype(np.int64) << 15) + marks["bit"].to_numpy()] = 1
    known = np.packbits(known, bitorder="little")
    strange = pa.RecordBatch.from_pydict({"text_id": [1], "text": ["".join(map(chr, rng.integers(33, 127, 300_000)))]})
    assert sum(b.num_rows for b in containment._hits(iter([strange]), known, {4, 5})) < 60


def test_windows_of_many_texts_share_a_batch():
    texts = [None, "", "short"] + [f"{i} is a text with a state-of-the-art word" for i in range(3000)]
    known = np.full(1 << containment.FILTER_BITS - 3, 255, np.uint8)
    found = list(containment._hits(iter([pa.RecordBatch.from_pydict({"text_id": list(range(3003)), "text": texts}).slice(1)]), known, {3}))
    assert len(found) < 10
    want = {(i, t[j : j + 8]) for i, t in enumerate(texts) if t for j in range(len(t) - 7)}
    assert len(want) == sum(b.num_rows for b in found) and {i for i, _ in want} == {i for b in found for i in b["text_id"].to_pylist()}


def test_postings_of_a_batch_are_a_row_for_each_term(spark, tmp_path, monkeypatch):
    """Before, a row for each word of each document: 50 of alpha."""
    path = str(tmp_path / "index")
    index_documents(spark.createDataFrame([(i, f"word{i} alpha Alpha", "en") for i in range(50)], SCHEMA).coalesce(1), path, ["lang"])
    rows = spark.read.parquet(f"{path}/postings").filter("term = 'alpha'").collect()
    assert [len(r["docs"]) for r in rows] == [50] and {(d["n"], d["tf"]) for d in rows[0]["docs"]} == {(3, 2)}
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 2)
    words = [["b", "a", "b"], None, [], ["c", "d", "e", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(words, pa.list_(pa.string()))], ["doc_id", "w"])
    found = [(r["term"], d["doc_id"], d["tf"]) for b in lexical._packed(iter([batch])) for r in b.to_pylist() for d in r["docs"]]
    want = [("", i, 0) for i in (1, 2, 3, 4)] + [("a", 1, 1), ("b", 1, 2)] + [(w, 4, 1) for w in "acde"]
    assert sorted(found) == sorted(want)
