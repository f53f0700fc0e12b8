"""The pipeline against its stages' own results on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = "\n".join(say(15) for _ in range(12))
    item = f"{say(20)}? {say(12)}."
    docs = [(i, say(rng.randint(60, 150))) for i in range(120)]
    docs += [(200 + i, " ".join(w + "$$$" for w in say(90).split())) for i in range(40)]
    near = say(120)
    docs += [(300, near), (301, near + " more"), (302, f"{say(40)} {item} {say(40)}"), (303, f"{say(40)}\n{passage}\n{say(30)}"), (304, f"{say(50)}\n{passage}\n{say(20)}"), (305, passage)]
    labels = [(i, 1, 0) for i in range(0, 100, 2)] + [(200 + i, 0, 0) for i in range(0, 40, 2)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, corpus), name)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in rows.values())
        ids.append(set(rows))
    assert ids[0] == {*range(120), *range(300, 306)}
    assert ids[0] - ids[1] <= {305} and ids[1] - ids[2] == {301} and ids[2] - ids[3] == {302}
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in packed} == ids[3] and all(r.offset + r.length <= 2048 for r in packed)


def test_nulls_repeats_and_clashing_names(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    plain = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (None, "no id here", "en", "s", 10), (902, "x " * 40_000, "en", "s", 80_000)], plain.schema)
    more = {"key": "1", "n_removed": "2", "text_hash": "3", "part": "4", "component_id": "5", "n_removed_0": "6", "label": "null", "bits": "7"}
    docs = plain.unionByName(odd).unionByName(plain.filter("doc_id < 3")).selectExpr("*", *[f"{v} AS {k}" for k, v in more.items()]).selectExpr("key", "doc_id", "text", "lang", "source", "n_chars", *[k for k in more if k != "key"])
    docs.write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    now = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, at), name)
        assert now.columns == docs.columns
        rows = now.collect()
        assert {(r.key, r.n_removed, r.text_hash, r.part, r.component_id, r.n_removed_0) for r in rows} == {(1, 2, 3, 4, 5, 6)}
        ids = [r.doc_id for r in rows]
        assert {900, 901} <= set(ids) and ids.count(None) == 2 and all(ids.count(i) == 2 for i in range(3))
    packed = [r.doc_id for r in corpus_pipeline.run(spark, at).collect()]
    assert sorted(set(packed), key=str) == sorted(set(ids), key=str) and packed.count(1) >= 2


def test_empty_tables(spark, corpus, tmp_path_factory):
    for kept in ("documents", "labels", "benchmark", ""):
        at = str(tmp_path_factory.mktemp("empty"))
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{corpus}/{t}.parquet")
            (df if t != kept and kept else df.limit(0)).write.parquet(f"{at}/{t}.parquet")
        n = corpus_pipeline.run(spark, at).count()
        assert (n == 0) == (kept in ("documents", ""))
