"""The manifest against a plain computation."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.merkle import manifest, op13_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes):
    """Root and, for each node, its steps of (before, after)."""
    steps, group = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, upper = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in group[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            upper.append([i for g in group[a : a + 16] for i in g])
        nodes, group = up, upper
    return nodes[0], steps


def expected(rows, tampered):
    parts = {}
    for row in rows:
        parts.setdefault(row[3], []).append(row)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        of = sorted(parts[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((of, *tree([leaf(r) for r in of])))
    root, above = tree([t[1] for t in trees]) if trees else (None, [])
    found = []
    for (of, subroot, steps), more in zip(trees, above, strict=True):
        for row, way in zip(of, steps, strict=True):
            bent = row[0] is not None and tampered(row[0])
            f = leaf(row, bent)
            for low, high in way + more:
                f = h(low, f, high)
            found.append((row[0], leaf(row), subroot, root, h(*(x for s in way + more for x in s)), f, f == root))
    return found


def crc(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def check(spark, rows):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA), F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, crc), key=repr)
    return got


def test_small_trees(spark):
    rows = [(i, None if i % 7 == 0 else f"Text {i} é", None if i % 3 == 0 else "en", s, i if i % 2 else None) for s, k in ((None, 1), ("", 2), ("a", 16), ("é", 17), ("b", 33), ("=", 300)) for i in range(k)]
    got = check(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_ids_repeated_and_null(spark):
    rows = [(None, "X", "en", "a", 1), (None, "X", "en", "a", 1), (None, None, None, None, None), (1, "Q", "en", "a", 1), (1, "P", "en", "a", 1), (1, "P", "en", "a", 1)]
    check(spark, rows * 6)


@pytest.mark.parametrize("n", [4096, 4097, 70000])
def test_buckets(spark, n):
    rng = random.Random(n)
    rows = [(i, f"T{rng.random()}", "en", "hot" if i % 9 else "cold", 1) for i in range(n * 9 // 8)]
    rng.shuffle(rows)
    check(spark, rows)


def test_many_sources(spark):
    check(spark, [(i, "Aa", "en", f"s{i % 700}", 1) for i in range(1500)])


def test_empty_and_clashing(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "T", "en", "a", 1)], SCHEMA).withColumns({c: F.lit("x") for c in ("part", "leaf", "at", "n", "bucket", "root", "salt")})
    assert manifest(docs).select("verified").collect() == [(True,)]


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    assert sorted(map(tuple, op13_merkle(spark, "/root/testdata/sf0.001").collect())) == sorted(expected(rows, crc))
