"""Importance resampling: model, cut, held-out accuracy, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality as Q

WORDS = [a + b for a in ("tion", "er", "an", "the", "on", "re", "st", "ing") for b in ("a", "ed", "ly", "ou", "sh", "al", "ic")]


def made(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = rng.choices(WORDS, k=rng.randint(30, 200))
        docs.append((i, " ".join(words) if good else " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in words)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = made()
    kept = {r.doc_id for r in Q.resample(*frames(spark, docs, labels)).collect()}
    assert kept == {i for i, _ in docs if i % 4}


def test_given_size_and_seed(spark):
    docs, labels = made(200)
    df = frames(spark, docs, labels)
    one = {r.doc_id for r in Q.resample(*df, k=60).collect()}
    two = {r.doc_id for r in Q.resample(*df, k=60, seed=9).collect()}
    assert len(one) == len(two) == 60 and one != two and all(i % 4 for i in one | two)


def test_defined_cases(spark):
    docs, labels = made(80)
    docs += [(1000, None), (1001, ""), (None, "tiona ered"), (1002, "x " * 50_000), (5, docs[5][1])]
    labels += [(None, 1, 0), (2000, 1, None), (5, None, None)]
    a, b = frames(spark, docs, labels)
    got = [r.doc_id for r in Q.resample(a.selectExpr("*", "1 AS good", "2 AS key"), b).collect()]
    assert {1000, 1001} <= set(got) and got.count(5) == 2
    assert Q.resample(a, b.limit(0)).count() == len(docs)
    assert Q.resample(a.limit(0), b).count() == 0


def test_cut(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 5, 5, 5, 9, 2e6, -7]], "key double")
    assert [Q.cut_of(df, k) for k in (1, 2, 3, 5, 6)] == [2e6, 9, 5, 5, 1]
    assert Q.cut_of(df, 0) == np.inf and Q.cut_of(df, 7) == -np.inf


def test_gumbel_draws_in_proportion(spark):
    from pyspark.sql import functions as F

    n = 20_000
    first = spark.range(n).select((F.lit(1.0) + Q.gumbel(F.col("id"), 1) > Q.gumbel(F.col("id"), 2)).alias("x")).filter("x").count()
    assert first / n == pytest.approx(np.e / (1 + np.e), abs=0.02)


def test_buckets():
    at, of = Q.buckets(pa.array(["a b", None, "b", "", "a b!!"]))
    assert of.tolist().count(0) == 3 and of.tolist().count(2) == 1 and of.tolist().count(4) == 5
    assert sorted(at[of == 0].tolist())[0] in at[of == 4].tolist()
    assert Q.best_bar(np.asarray([5.0, 6.0]), np.asarray([1.0, 2.0])) == 3.5


def test_toxic_documents_of_good_quality_go(spark):
    rng = random.Random(6)
    insults = ["idiotex", "moronex", "scumex"]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(WORDS, k=rng.randint(30, 1500))
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words) - 20)
            for k in (0, 7, 15):
                words[at + k] = rng.choice(insults)
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    # Labels of bad quality, too.
    docs += [(1000 + i, " ".join(w + "$$$" for w in rng.choices(WORDS, k=60))) for i in range(80)]
    labels += [(1000 + i, 0, 0) for i in range(40)]
    df = frames(spark, docs, labels)
    kept = {r.doc_id for r in Q.resample(*df).collect()}
    clean = {i for i in range(400) if i % 5}
    assert len(clean & kept) > 0.97 * len(clean) and len(kept - clean) <= 4
    assert {r.doc_id for r in Q.sampled_documents(*df).collect()} == kept
    assert not {i for i in range(0, 400, 5)} & {r.doc_id for r in Q.resample(*df, k=100).collect()}


def test_worst_window():
    ratios = np.zeros(1 << 20)
    at, _ = Q.buckets(pa.array(["bad"]), 1 << 20)
    ratios[at] = 2.0
    texts = ["x " * 99 + "bad bad", "bad " + "x " * 30 + "bad", "bad " + "x " * 31 + "bad", "", None, "bad"]
    assert Q.worst(pa.array(texts), ratios, 32).tolist() == [4.0, 4.0, 2.0, 0.0, 0.0, 2.0]


def test_query_is_gumbel_top_k(spark):
    """The sample is what sorting all sums gives, and the noise decides some of it."""
    docs, labels = made(300, seed=3)
    a, b = frames(spark, docs, labels)
    sampler, scored = Q.fitted(a, labels=b, k=120, temperature=40.0)
    rows = scored.withColumn("noise", Q.gumbel(scored.doc_id, Q.SEED)).collect()
    order = sorted(rows, key=lambda r: -(r.log_weight / 40.0 + r.noise))
    got = {r.doc_id for r in sampler.sample(scored).collect()}
    assert got == {r.doc_id for r in order[:120]}
    plain = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:120]}
    assert 5 < len(got - plain) < 100
    w = np.exp(np.asarray([r.log_weight for r in rows]) / 40.0)
    assert Q.effective_size(scored, 40.0) == pytest.approx(w.sum() ** 2 / (w * w).sum())


def test_temperature_leaves_good_rows_alone(spark):
    docs, labels = made(600, seed=5)
    sampler, scored = Q.fitted(*frames(spark, docs, labels))
    assert sampler.temperature > 1
    assert {r.doc_id for r in sampler.sample(scored).collect()} == {i for i, _ in docs if i % 4}


def test_clashing_columns(spark):
    docs, labels = made(80)
    a, b = frames(spark, docs, labels)
    clash = a.selectExpr("1 AS key", "doc_id", "'n' AS n_grams", "text", "0.5 AS log_weight", "true AS toxicity", "7 AS more_0")
    got = Q.sampled_documents(clash, b)
    assert got.columns == clash.columns
    assert {tuple(r)[0:1] + tuple(r)[2:3] + tuple(r)[6:] for r in got.collect()} == {(1, "n", 7)}
