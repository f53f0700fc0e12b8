"""Models against plain Kneser-Ney, decisions on planted and given texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.language import Model, fitted, hashed, held_out, identified, learned, op12_language, runs_of

SCHEMA = "doc_id long, text string, lang string"


def told(text):
    """Symbols as the docstring has them, for letters below 2^16."""
    found = []
    for c in text:
        s = c.lower()[0] if c.isalpha() else " "
        if s != " " or not found or found[-1] != " ":
            found.append(s)
    return "\x01\x01\x01" + "".join(found)


def plain(texts):
    """A function from a run of four to its probability."""
    counts = {4: Counter()}
    for text in texts:
        s = told(text)
        counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for m in (3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = {}
    for m, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[m] = max(0.1, min(0.9, n1 / (n1 + 2 * n2))) if n1 else 0.5

    def p(run, even, m=4):
        if not m:
            return even
        run = run[-m:]
        after = [v for g, v in counts[m].items() if g[:-1] == run[:-1]]
        lower = p(run, even, m - 1)
        if not after:
            return lower
        own = counts[m].get(run, 0)
        return (max(own - discount[m], 0) if own else 0) / sum(after) + discount[m] * len(after) / sum(after) * lower

    return p


TEXTS = {"x": ["The cat sat on the mat.", "a cat, a hat; THE bat", "Ünder öl", "the the the 12 the"], "y": ["der Hund und die Katze", "und der Hut", "ç'est la vie", "dünn"]}


def test_hash_is_sparks(spark):
    keys = np.asarray([0, 1, -1, 2**62 + 12345, -(2**63), 77], np.int64)
    got = [r[0] for r in spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "i int, k long").orderBy("i").select(F.xxhash64("k")).collect()]
    assert hashed(keys.view(np.uint64)).view(np.int64).tolist() == got


def test_probabilities(spark):
    rows = spark.createDataFrame([(t, lang) for lang, texts in TEXTS.items() for t in texts], "text string, lang string")
    model = learned(rows)
    assert model.langs == ["x", "y"]
    text = "The hat und der Kat, zzz 9 ö"
    runs = np.concatenate(list(runs_of(text)))
    got = model.entropies(runs)
    s = told(text)
    for column, lang in enumerate(model.langs):
        p = plain(TEXTS[lang])
        want = [-math.log(p(s[i - 3 : i + 1], model.even)) for i in range(3, len(s))]
        assert got[:, column] == pytest.approx(want, rel=1e-5)
    # The shares of all symbols after a known context sum to one, less what unknown symbols may take.
    context = np.uint64(int.from_bytes("".join(reversed("the")).encode("utf-16-le"), "little") << 16)
    every = np.asarray(sorted({int(r) & 0xFFFF for t in TEXTS.values() for x in t for part in runs_of(x) for r in part}), np.uint64)
    assert 0.9 < np.exp(-model.entropies(context + every)).sum(0)[0] <= 1.0001


def test_blocks_change_nothing(monkeypatch):
    text = "Ab  c—d éÉ \U0001d400\U0001d401 ..  x" * 9
    whole = np.concatenate(list(runs_of(text)))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.array_equal(np.concatenate(list(runs_of(text))), whole)
    owners = np.concatenate([o for _, o in language.blocks([text, "", "q", text])])
    assert np.bincount(owners, minlength=4).tolist() == [len(whole), 0, 1, len(whole)]


def made(rng, lang, n):
    words = {"x": ["the", "cat", "and", "with", "thing"], "y": ["der", "und", "nicht", "über", "schön"], "z": ["что", "это", "как", "или", "был"]}[lang]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("cells", [language.CELLS, 120])
def test_decisions(spark, cells):
    rng = random.Random(5)
    rows = [(i, made(rng, lang, rng.randrange(1, 40)), lang if rng.random() < 0.95 else None) for i in range(600) for lang in [rng.choice("xyz")]]
    truth = {i: lang for i, _, lang in rows}
    odd = [(1000, None, "x"), (1001, "", "y"), (1002, "12 ... \U0001f600", None), (None, "der und", "y"), (1003, "und " * 300_000, None), (1004, "qqqq wwww", None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit(1) for c in ("run", "n", "hash", "score")})
    model = fitted(docs, held_out(), cells)
    assert model.langs == ["x", "y", "z"] and (model.shift > 0) == (cells < 1000)
    assert all(len(h) * 3 <= cells or not model.shift for h, _ in model.arrays.values())
    got = {r["doc_id"]: r for r in identified(docs, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, lang in truth.items() if lang]
    assert np.mean(right) > (0.99 if cells > 1000 else 0.7)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(got[i]["score"] == 0 and not got[i]["rejected"] for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    if cells > 1000:
        assert got[1003]["lang_pred"] == got[None]["lang_pred"] == "y"


def test_rejection(spark):
    rng = random.Random(6)
    rows = [(i, made(rng, "xyz"[i % 3], 30), "xyz"[i % 3]) for i in range(16000)]
    model = fitted(spark.createDataFrame(rows, SCHEMA), F.lit(False))
    assert all(math.isfinite(b) for b in model.bars)
    got = identified(spark.createDataFrame([(1, "zqk wvx jjp " * 12, None), (2, made(rng, "x", 30), None)], SCHEMA), model).collect()
    assert {r["doc_id"]: r["rejected"] for r in got} == {1: True, 2: False}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    model = fitted(docs, held_out())
    assert not model.langs and identified(docs, model).select("lang_pred", "score").collect() == [("und", 0.0)]
    assert identified(docs.limit(0), Model([])).count() == 0


def test_given_table(spark):
    got = op12_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got.count() == docs.count() and got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(docs, "doc_id").filter("held_out")
    assert both.filter("lang = lang_pred").count() / both.count() > 0.98


def test_same_hashes_at_every_size(spark, monkeypatch):
    """How hashes are cut depends on the bound and the languages alone, not on how many runs there are."""
    monkeypatch.setattr(language, "CELLS", 1 << 10)
    rng = random.Random(8)
    few = learned(spark.createDataFrame([(made(rng, x, 3), x) for x in "xy"], "text string, lang string"), 1 << 10)
    many = learned(spark.createDataFrame([("".join(chr(97 + rng.randrange(26)) for _ in range(3000)), x) for x in "xy"], "text string, lang string"), 1 << 10)
    assert (few.bits, few.shift) == (many.bits, many.shift) == (9, 0)
    assert all(int(h.max()) < 1 << 9 for m in (few, many) for h, _ in m.arrays.values())
