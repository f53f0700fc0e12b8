"""The audit against plain counts and a simulation of every order."""

import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import filter_audit
from tessera.llm.filter_audit import counts_of, distinct, failures, interactions, long_text, op11_filters

SCHEMA = "doc_id long, text string, lang string"


def plain(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aAbé  字\t\n\x0b\x1c #|\U0001f600\x00", max_size=60), max_size=8))
def test_counts(texts):
    assert counts_of(pa.array(texts, pa.string())).tolist() == [list(plain(t)) for t in texts]


def test_slices_of_arrays():
    texts = ["a b", "c", "", "d d D#", "é"]
    assert counts_of(pa.array(texts).slice(1, 3)).tolist() == [list(plain(t)) for t in texts[1:4]]


def test_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 50)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "C#", "é" * 40, "x" * 200, " "]) for _ in range(rng.randrange(200))) for _ in range(20)] + ["y" * 999, ""]
    assert counts_of(pa.array(texts, pa.string())).tolist() == [list(plain(t)) for t in texts]
    assert long_text(np.zeros(0, np.uint8)) == (0, 0, 0, 0, 0)


def test_collisions_are_counted_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "hashes", lambda data, low, high: np.zeros(len(low), np.uint64))
    data = np.frombuffer(b"aa bb aa c aa bb", np.uint8)
    low = np.asarray([0, 3, 6, 9, 11, 14])
    assert distinct(data, low, np.asarray([2, 5, 8, 10, 13, 16]), np.asarray([0, 0, 0, 0, 1, 1]), 2).tolist() == [3, 2]


def expected(rows, labels):
    fails = []
    for doc_id, text, lang in rows:
        words, different, capitals, signs, points = plain(text or "")
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows)
        failed = {f for f, x in zip("ABCDE", (words < 200, 100 * different < 50 * words, 100 * capitals > 3 * points, signs > 0, copy), strict=True) if x}
        fails.append((lang or "", failed, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None), any(i == doc_id and t == 1 for i, _, t in labels if i is not None)))
    found, shapley = [], {}
    for part in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in fails if x[0] == part) - len(removed)
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                found.append([part, "".join(order), step, len(left), len(removed), redundant, sum(x[1] == {f} for x in fails if x[0] == part), sum(x[2] for x in removed), sum(x[3] for x in removed)])
    return sorted(tuple(r) + (shapley[r[0], r[1][r[2] - 1]],) for r in found)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(rng.choice([5, 5000]))}" for _ in range(rng.choice([10, 199, 200, 260]))]
        text = " ".join(words) + rng.choice(["", "", "#", " " + "Q" * rng.choice([3, 60])])
        for k in range(rng.choice([1, 1, 3])):
            rows.append((i * 5 + k if rng.random() < 0.9 else None, text, rng.choice(["en", "de", None, ""])))
    rows += [(900, None, "en"), (901, "", "en"), (900, "", "de"), rows[0], rows[0], (rows[0][0], "other", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 950, 2)] + [(0, 1, 1), (None, 1, 1)]
    return rows, labels


def test_every_order(spark, planted):
    rows, labels = planted
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("part", "mask", "n", "good", "count")})
    got = interactions(failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(map(tuple, got.collect())) == expected(rows, labels)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(failures(spark.createDataFrame([], SCHEMA), labels)).count() == 0
    assert interactions(failures(spark.createDataFrame([(None, None, None)], SCHEMA), labels)).filter("step = 1 AND filter_order = 'ABCDE'").collect() == [("", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)]


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, op11_filters(spark, "/root/testdata/sf0.001").collect())) == expected(docs, labels)
