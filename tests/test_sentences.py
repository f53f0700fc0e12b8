"""Sentences as the plain pattern finds them, in time that grows with the text alone."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.operators import chunking

PLAIN = re.compile(r"[^.!?؟۔]+[.!?؟۔]+(?:\s+|$)|[^.!?؟۔]+$", re.S)


def test_same_sentences(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.?! \n3") for _ in range(rng.randrange(40))) for _ in range(2000)]
    want = [[s for m in PLAIN.finditer(t) if (s := m[0].strip())] for t in texts]
    assert [chunking.sentences(t) for t in texts] == want
    got: dict[int, list[str]] = {}
    for r in chunking.letter_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert [got.get(i, []) for i in range(len(texts))] == want


def test_ends_within_words(spark):
    text = ("word " * 10_000 + "3.14 ") * 3
    began = time.time()
    assert chunking.sentences(text) == [text.rsplit(".", 1)[1].strip()]
    assert chunking.letter_vectors(spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 1
    assert time.time() - began < 20
