"""Line dedup against a brute-force version."""

import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def spark_hash(values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(docs):
    """docs: {doc_id: text}. The lines that each keeps."""
    spans, owners = [], {}
    for i, text in docs.items():
        lines = text.split("\n")
        h = [0 if not x.strip(" ") else spark_hash([x]) for x in lines]
        seen = set()
        for level in range(L.LEVELS):
            cuts = [k for k in range(1, len(h)) if spark_hash([(L.SEED + level,), *h[k : k + L.LINES]]) % L.DIVISOR == 0]
            at = [0, *cuts, len(h)]
            seen |= {(a, b) for a, b in zip(at, at[1:], strict=False) if b - a >= 2 and sum(bool(x.strip(" ")) for x in lines[a:b]) >= 2}
        for a, b in seen:
            chunk = tuple(x if x.strip(" ") else "" for x in lines[a:b])
            spans.append((i, a, b, chunk))
            owners[chunk] = min(owners.get(chunk, (i, a)), (i, a))
    gone = {(i, k) for i, a, b, chunk in spans if owners[chunk] != (i, a) for k in range(a, b)}
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs.items()}


def test_brute_force(spark):
    import random

    rng = random.Random(3)
    passages = [[f"line {p} {k}" for k in range(rng.randint(2, 7))] for p in range(6)]
    docs = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own {i} {rng.random()}"] + [""] * rng.randint(0, 2)
        docs[i] = "\n".join(lines)
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in L.remove_repeats(df).collect()}
    want = brute(docs)
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n for _, n in got.values()) == sum(len(docs[i].split("\n")) - len(want[i].split("\n")) for i in docs if want[i]) + sum(len(docs[i].split("\n")) for i in docs if docs[i] and not want[i])


def test_copies_lose_their_lines_and_the_first_stays(spark):
    text = "\n".join(f"this is line number {k} of a text" for k in range(40))
    df = spark.createDataFrame([(5, text), (2, text), (9, "before\n" + text + "\nafter")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.remove_repeats(df).collect()}
    assert got[2].text == text and got[2].n_removed == 0
    assert len(got[5].text) < 0.2 * len(text) and "after" in got[9].text and len(got[9].text) < 0.3 * len(text)


def test_defined_cases(spark):
    long = "\n".join("same" for _ in range(3000))
    rows = [(None, "a\nb\nc\nd"), (1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (6, long), (7, "  \n \n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("x")).withColumn("h", F.lit(1))
    got = L.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "n_removed", "text_hash", "h"]
    found = sorted((r.doc_id or -1, r.text) for r in got.collect() if r.doc_id != 1)
    assert found == sorted((i or -1, t) for i, t in rows if i != 1)
    assert [r.text for r in got.filter("doc_id = 1").collect()] == [None]
    assert L.remove_repeats(df.limit(0)).count() == 0


def test_clashes_block_removal(spark, monkeypatch):
    text = "\n".join(f"row {k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    every = spark.createDataFrame([(spark_hash([f"row {k}"]),) for k in range(30)], "hash long")
    monkeypatch.setattr(L, "clashes", lambda docs: every)
    assert {r.text for r in L.remove_repeats(df).collect()} == {text}


def test_native(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.remove_repeats(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", ["", "a", "a\nb\nc"])
def test_starts(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(L.line_hashes(F.col("text")).alias("h")).select("h", L.starts(F.col("h"), 0).alias("at"))
    row = df.first()
    assert row["at"][0] == 0 and row["at"][-1] == len(row["h"])


def every_run(docs):
    """docs: {doc_id: text}. What each keeps when all recurring runs of any length go, from the text line they begin with to the one they end with."""
    runs, owners = [], {}
    for i, text in docs.items():
        lines = [x if x.strip(" ") else "" for x in text.split("\n")]
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                if lines[a] and lines[b - 1]:
                    run = tuple(lines[a:b])
                    runs.append((i, a, b, run))
                    owners.setdefault(run, (i, a))
    gone = {(i, k) for i, a, b, run in runs if owners[run][0] != i or owners[run][1] + b - a <= a for k in range(a, b)}
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs.items()}


def test_every_run_against_brute_force(spark):
    import random

    rng = random.Random(4)
    passages = [[rng.choice(["", " ", f"line {p} {k}"]) if 0 < k < n - 1 else f"line {p} {k}" for k in range(n)] for p in range(8) for n in [rng.randint(2, 7)]]
    docs = {-3: "same\n" * 5 + "a\nb\na\nb", -2: "x\n\ny\n", -1: "z\nx\n \ny"}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own {i} {rng.random()}"] * rng.randint(1, 3) + [""] * rng.randint(0, 2)
        docs[i] = "\n".join(lines)
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.remove_repeats(df, levels=None).collect()}
    want = every_run(docs)
    assert got == want and want[-3] == "same\nsame\n" + "a\nb" and want[-1] == "z"


@pytest.mark.parametrize("n", [2, 3, 4])
def test_query_finds_short_passages_whole(spark, tmp_path, n):
    rows = [(10 * p + d, "\n".join([f"before {p} {d}", *[f"passage {p} line {k}" for k in range(n)], f"after {p} {d}"])) for p in range(40) for d in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op3_lines(spark, str(tmp_path)).collect()}
    assert all(got[10 * p].n_removed == 0 and got[10 * p + 1].text == f"before {p} 1\nafter {p} 1" and got[10 * p + 1].n_removed == n for p in range(40))


def test_stage_drops_documents_of_which_blank_lines_are_left(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a\nb", 3), (2, "\na\nb\n \n", 7), (3, "\n", 1)], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.lines(spark, df, "").collect()) == [1, 3]
