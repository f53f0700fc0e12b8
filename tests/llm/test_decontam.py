"""Decontamination: retrieval against brute force BM25, verification, defined cases."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import decontam as D


def brute(items, passage, bar):
    """Items whose normalized BM25 against the passage's distinct words reaches the bar."""
    words = [t.split() for t in items]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))

    def score(ws, query):
        tf = Counter(ws)
        return sum(math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(ws) / mean)) for w, n in tf.items() if w in query)

    return {i: score(ws, set(passage)) / score(ws, set(ws)) for i, ws in enumerate(words) if score(ws, set(passage)) / score(ws, set(ws)) >= bar}


def test_bounds_lose_nothing():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(80)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(70)]
    index = D.build(list(enumerate(items)))
    assert int(index.blocks.max()) == 4
    for bar in (0.3, 0.6):
        queries = [rng.choices(vocabulary, k=60) if rng.random() < 0.5 else rng.choice(items).split() for _ in range(80)]
        of, code = [], []
        for q, words in enumerate(queries):
            at = np.flatnonzero(np.isin(index.terms, D.word_hashes(pa.array([" ".join(words)]))[0]))
            of += [q] * len(at)
            code += at.tolist()
        p, i, s = D.retrieve(index, np.asarray(of), np.asarray(code), len(queries), bar)
        got = {(a, int(index.items[b])): c for a, b, c in zip(p.tolist(), i.tolist(), s.tolist(), strict=True)}
        want = {(q, k): v for q, words in enumerate(queries) for k, v in brute(items, words, bar).items()}
        assert got.keys() == want.keys() and len(want) > 40
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, f"{say(20)}? {say(15)}.\n{say(7)}.") for k in range(50)] + [(50, say(4)), (51, ""), (52, None), (None, say(30)), (53, f"{say(150)}. {say(90)}.")]
    question, answer = D.parts(items[7][1])
    docs = [(k, say(300)) for k in range(40)]
    docs += [(100, f"{say(500)} {items[3][1].upper()} {say(40)}"), (101, items[4][1]), (101, items[4][1]), (102, f"{say(90)} {question} {say(200)}"), (103, f"{say(9)} {answer}"), (104, ""), (105, None), (None, items[5][1]), (106, f"{say(70)} {items[-1][1]}"), (107, items[6][1].replace(" ", ", "))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 50} == {(100, 3), (101, 4), (106, 53), (107, 6)}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    few = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard=9)
    assert {(r.doc_id, r.item_id) for r in few.collect() if r.item_id != 50} == {(100, 3), (101, 4), (106, 53), (107, 6)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs, items).count() == 1


def test_parts():
    assert D.parts("Who is it? It is me.") == ("Who is it?", " It is me.")
    assert D.parts("one two three four five six") == ("one two three four", "five six")
    assert D.parts("one") == ("one", "") and D.parts("...") == ("...", "") and D.parts("") == ("", "")


def test_long_items(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, f"{say(20)}? {say(7)}.") for k in range(20)] + [(100 + n, f"{say(n - 10)}? {say(10)}.") for n in (400, 1500)]
    texts = dict(items)
    docs = [(1, f"{say(333)} {texts[500]} {say(210)}"), (2, f"{say(100)} {texts[1600]} {say(50)}"), (3, " ".join(texts[500].split()[:200])), (4, say(900)), (5, texts[500])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 500), (2, 1600), (5, 500)}


def fixture():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(700)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    sizes = (5, 9, 30, 63, 64, 66, 70, 100, 129, 240, 300, 330, 400, 800, 2000)
    items = [(n, f"{say(n - n // 4)}? {say(n // 4)}.") for n in sizes] + [(5000 + k, f"{say(12)}. {say(8)}.") for k in range(60)]
    docs, want = [], set()
    for k, (n, text) in enumerate(items[: len(sizes)]):
        for place in range(5):
            docs.append((100 * k + place, f"{say(rng.randrange(0, 150))} {text} {say(rng.randrange(0, 200))}"))
            want.add((100 * k + place, n))
    for k in range(40):
        words = rng.choice(items)[1].split()
        lost = rng.randrange(len(words))
        docs.append((9000 + k, " ".join([say(rng.randrange(80)), *words[:lost], *words[lost + len(words) // 8 :], say(30)])))
    return docs, items, want


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_planted_items_of_all_lengths_and_any_shards(spark):
    docs, items, want = fixture()
    whole = {tuple(r) for r in D.contaminated(*frames(spark, docs, items)).collect()}
    assert want <= {(r[0], r[1]) for r in whole}
    assert {tuple(r) for r in D.contaminated(*frames(spark, docs, items), shard=7).collect()} == whole


def test_whole_query_against_brute_force(spark):
    docs, items, _ = fixture()
    plain = lambda t: [w for w in ("".join(c for c in x if c.isalnum()) for x in t.lower().split()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    cut = []
    for item, text in items:
        words = plain(text)
        at = [a for a in range(0, len(words), D.PART)]
        if len(at) > 1 and len(words) - at[-1] < D.TAIL:
            at.pop()
        cut += [(item, text, words, a, b) for a, b in zip(at, [*at[1:], len(words)], strict=True)]
    n, mean = len(cut), sum(b - a for *_, a, b in cut) / len(cut)
    df = Counter(w for _, _, words, a, b in cut for w in set(words[a:b]))
    want = set()
    for doc, text in docs:
        h = plain(text)
        for k in range(-(-len(h) // D.HALF)):
            passage = set(h[k * D.HALF : (k + 2) * D.HALF])
            for item, whole, words, a, b in cut:
                tf = Counter(words[a:b])
                weigh = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * (b - a) / mean)) for w, c in tf.items()}
                if sum(v for w, v in weigh.items() if w in passage) < D.BAR * sum(weigh.values()) - 1e-9:
                    continue
                before, after = a, len(words) - b
                slack = (before + after) // 4
                window = h[max(0, (k - 1) * D.HALF - (before + slack if before else 0)) : (k + 3) * D.HALF + (after + slack if after else 0)]
                shares = []
                for part in map(plain, D.parts(whole)):
                    m = min(D.SHINGLE, len(part))
                    mine = grams(part, m)
                    shares.append(len(mine & grams(window, m)) / len(mine) if mine else 1.0)
                if min(shares) >= D.OVERLAP:
                    want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(*frames(spark, docs, items)).collect()}
    assert got == want and len(want) > 75
