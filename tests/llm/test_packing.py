import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


TEXTS = ["", None, "Hello World", "it's DON'T x'll 's", "É é ǅ Σας ΟΔΟΣ ﬁ İi", "a b c　d", "\x01 a \x01b\x01", "<|endoftext|> x<|startoftext|>y", "日本語 123 45!!", "tab\tnew\nline\r\n\x0bv", "w " * 5000, "Hello World", "I\u0307 A\u0301. É.,x K.\u0301!", "<|ENDOFTEXT|>", "a.b,c;;d's. 'S.X DON'T."]


def test_words_equal_whole_texts(plain):
    import pyarrow as pa

    words = packing.Words(packing.vocabulary())
    for _ in range(2):
        ids, ends = words.encode(pa.array(TEXTS))
        low = 0
        for text, end in zip(TEXTS, ends.tolist(), strict=True):
            assert ids[low:end].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0], text
            low = end


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_words_equal_any_text(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    global WORDS, PLAIN
    if "WORDS" not in globals():
        WORDS, PLAIN = packing.Words(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    ids, _ = WORDS.encode(pa.array([text]))
    assert ids.tolist() == [*PLAIN.encode(text, add_special_tokens=False).ids, 0]


def optimum(items: list[int], capacity: int) -> int:
    """Fewest bins, by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = np.bincount(items, minlength=21)
    left = counts.copy()
    fixed = packing.reduced(left, 20)
    rest = [n for n in range(21) for _ in range(left[n])]
    assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(items, 20)
    assert all(sum(a * k for a, k in p) <= 20 for p, _ in fixed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit_as_piece_by_piece(items):
    bins: list[int] = []
    for x in sorted(items, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(50 - x)
    got = packing.best_fit(np.bincount(items, minlength=51), 50)
    assert sum(n for _, n in got) == len(bins)
    used = np.zeros(51, int)
    for p, n in got:
        for a, k in p:
            used[a] += k * n
    assert used.tolist() == np.bincount(items, minlength=51).tolist()


def test_pack(spark, plain):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 3000, 200))] + [(None, "x"), (7, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int").repartition(5)
    got = packing.pack(docs).collect()
    want = []
    for i, t in rows:
        ids = np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append(str((i, k, at, len(part), zlib.crc32(part.tobytes()))))
    assert sorted(want) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_every_letter_before_every_sign(plain):
    import unicodedata

    import pyarrow as pa

    words = packing.Words(packing.vocabulary())
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "L"]
    cased = [c for c in letters if c.lower() != c or c.upper() != c or len(unicodedata.normalize("NFC", c).lower()) > 1]
    texts = [" ".join(f"{c}{sign}" for c in letters) for sign in ".!"] + [" ".join(f"x{c}{sign}. {c}" for c in cased) for sign in packing.SIGNS] + ["\u0e31\u0130."]
    ids, ends = words.encode(pa.array(texts))
    for text, low, end in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert ids[low:end].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize(
    "histogram",
    [{700: 10**9}, {1100: 10**9, 900: 10**9}, {1100: 5 * 10**8, 900: 4 * 10**8, 901: 3 * 10**8}, {1: 10**9}, {2048: 10**9, 1025: 10**9, 3: 5, 1023: 10**9 - 7}, {1024: 10**9 + 1, 5: 1}, {n: 10**6 + n for n in range(1, 2049)}, {600: 10**9, 700: 10**9, 800: 10**9 // 3, 649: 3, 1447: 10**8}],
    ids=range(8),
)
def test_solved_by_lengths_not_by_pieces(histogram):
    import time

    counts = np.zeros(2049, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    began = time.process_time()
    found = packing.solve(counts)
    assert time.process_time() - began < (1 if len(histogram) < 6 else 5)
    used = np.zeros(2049, np.int64)
    for pattern, n in found:
        assert sum(a * k for a, k in pattern) <= 2048
        for a, k in pattern:
            used[a] += k * n
    assert used.tolist() == counts.tolist() and len(found) <= 8 * len(histogram)
