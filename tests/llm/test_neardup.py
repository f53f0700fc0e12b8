import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from tessera.llm import neardup


def plain_set(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])


def brute(rows, words, percent):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, plain_set(t, words))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_shingles_against_sets():
    texts = ["", None, " a  b ", "A b\ta B c", "x", "É é", "a b c d e f a b c d e", "one\x0btwo\x0cthree", "nb\xa0sp x"]
    for words in (1, 2, 5):
        x, ends = neardup.shingles(pa.array(texts), words)
        sizes = np.diff(ends, prepend=0).tolist()
        assert sizes == [len(plain_set(t, words)) for t in texts]


def test_signature_estimates():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 63, 200_000, np.uint64))
    a, b = np.sort(x[:90_000]), np.sort(x[10_000:100_000])
    s = neardup.signatures(np.concatenate([a, b]), np.array([len(a), len(a) + len(b)]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


def test_least_matches_keeps_true_links():
    least = neardup.least_matches(0.8)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * neardup.HASHES


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def made(rng):
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.randrange(1, 12)):
            rows.append(edited(base, rng, rng.randrange(0, 12)))
    # A chain: each close to the next, the ends far apart.
    chain = [f"c{i}" for i in range(120)]
    for i in range(0, 60, 6):
        rows.append(" ".join(chain[i : i + 60]))
    # One large group, spread around the threshold.
    base = [f"h{rng.randrange(5000)}" for _ in range(100)]
    rows += [edited(base, rng, rng.randrange(3, 9)) for _ in range(150)]
    rows += ["", None, "   ", "one", "one", "ONE", "two words", "x x x x", *["same text here"] * 5]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


def compare(spark, rows, words):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = neardup.near_duplicates(docs, words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_against_brute_force(spark):
    rng = random.Random(11)
    compare(spark, made(rng), 2)


def test_five_words_and_repeats(spark):
    rows = made(random.Random(12))
    compare(spark, rows + rows[:7], 5)


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted(neardup.near_duplicates(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(4, 4, True), (None, None, True), (None, None, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_given_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op10_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 2, 80)


def around(rng, n):
    """Texts of one base whose similarities lie around and below the threshold, and two bridges."""
    base = [f"h{k}" for k in range(120)]
    rows = [edited(base, rng, rng.randrange(4, 16)) for _ in range(n)]
    return [(5 * i, t) for i, t in enumerate(rows)]


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Groups cut into many blocks give what all pairs give."""
    monkeypatch.setattr(neardup, "LARGE", 8)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    compare(spark, around(random.Random(3), 90) + [(10_000 + i, t) for i, t in made(random.Random(4))], 2)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3_000)
    compare(spark, around(random.Random(5), 40), 2)


def test_rows_grow_with_blocks_not_pairs(spark, monkeypatch):
    """A group that mostly does not link: the rows that tasks get stay near the number of texts."""
    sent = []
    whole = neardup.dealt
    monkeypatch.setattr(neardup, "dealt", lambda groups: sent.append(whole(groups)) or sent[-1])
    rows = around(random.Random(6), 400)
    compare(spark, rows, 2)
    assert sum(x.count() for x in sent) < 400 * 60  # of 79,800 pairs, most of which share a band


def test_each_pair_of_blocks_meets_once(spark):
    rows = [(1, d, 0, d % 3 == 0, 4, 3) for d in range(200)]
    met = neardup.dealt(spark.createDataFrame(rows, "leader long, doc_id long, label long, outer boolean, p int, q int")).collect()
    tasks = {}
    for r in met:
        tasks.setdefault((r.i, r.j), []).append(r)
    seen = {}
    for (_, j), rs in tasks.items():
        for a in rs:
            for b in rs:
                if a.first and (not b.first or (j == 0 and a.doc_id < b.doc_id)):
                    key = (min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id))
                    seen[key] = seen.get(key, 0) + 1
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if a % 3 == 0 or b % 3 == 0}
    assert set(seen) == want and set(seen.values()) == {1}
