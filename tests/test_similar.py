"""Products of blocks: no pair is missed, whatever the sizes of blocks and tiles, and a first hit is the first in time."""

import numpy as np
import pytest

from tessera.operators import selection, similar


def plain(x, y):
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


@pytest.mark.parametrize("block", [similar.BLOCK, 17])
def test_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "TILE", (5, 7))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 8))
    rows = [(i, [float(x) for x in base[i % 9] + rng.normal(size=8) * 0.4]) for i in range(120)]
    rows += [(200 + i, [1.0, float(i)]) for i in range(5)] + [(300, None), (301, []), (302, [1.0, None]), (303, [0.0] * 8)]
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.8).collect()}
    whole = [(i, np.asarray(v)) for i, v in rows if v and None not in v and any(v)]
    want = {(i, j): s for i, x in whole for j, y in whole if i < j and len(x) == len(y) and (s := round(plain(x, y), 6)) >= 0.8}
    assert len(want) > 300 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_no_bands_are_sent(spark):
    """What is shuffled is a vector for each block of rows, not one for each band of signs."""
    assert not hasattr(similar, "banded_by_size")
    assert similar.blocks_for(spark, 10_000_000) == -(-10_000_000 // similar.BLOCK) and similar.blocks_for(spark, 500) == 1


@pytest.mark.parametrize("block", [similar.BLOCK, 11])
def test_first_in_time(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "TILE", (3, 4))
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 6))
    made = lambda i: [float(x) for x in base[i % 4] + rng.normal(size=6) * 0.5]
    asked = [(i, f"q{i}", "st"[i % 2], "d", made(i)) for i in range(60)]
    cache = [(f"k{i:03}", f"c{i}", "st"[i % 3 % 2], "d", made(i), int(rng.integers(30))) for i in range(90)]
    got = {r.id: (r.key, r.how) for r in selection.cached_answers(spark.createDataFrame(asked, "id int, text string, scope string, domain string, v array<double>"), spark.createDataFrame(cache, "key string, text string, scope string, domain string, v array<double>, at int"), 0.9, 0.8).collect()}
    for i, _, scope, _, v in asked:
        hits = lambda bar, fit: min(((at, k) for k, _, s, _, w, at in cache if fit(s) and plain(np.asarray(v), np.asarray(w)) >= bar), default=None)
        near, part = hits(0.9, lambda s: s == scope), hits(0.8, lambda s: True)
        assert got[i] == ((near[1], "near") if near else (part[1], "partial") if part else (None, "none"))
