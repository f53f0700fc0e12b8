"""How quality filters overlap: what each removes in every order of application.

Five conditions are told of each text, straight from Arrow's buffers: NumPy tables give
each byte its classes, and differences of prefix sums at the texts' borders count words,
capitals, signs and code points. Distinct words come from word hashes, sorted within
their document; equal neighbours are compared byte by byte, and a text in which they
differ is counted word by word. A fifth condition holds where a text is identical (by
SHA-256) to that of a smaller id.

What a document fails is a mask of five bits, so documents reduce to counts by mask,
part and labels, at most 128 rows a part; every order's figures are sums over these.

A null text is empty (it fails the first condition). A null lang is part ''. Null ids are
neither smaller nor greater than others: such rows are never copies, make none, and have
no labels. Rows that repeat a text and an id are no copies of one another. A document
with several labels has each that one of them gives. An empty table has no parts. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table

FILTERS = "ABCDE"
COPY = 16
MIN_WORDS = 200
#: Bytes of a word; capitals; signs that fail a text; first bytes of code points.
BYTES = np.arange(256)
WORD = ~np.isin(BYTES, [0x20, *range(0x09, 0x0E)])
CAPITAL = (BYTES >= ord("A")) & (BYTES <= ord("Z"))
SIGN = np.isin(BYTES, list(b"#$%&*|"))
POINT = (BYTES & 0xC0) != 0x80
#: A word's hash is the sum of a number for each byte times a power of BASE by its place, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NUMBERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Texts of more bytes are counted in pieces of about this size.
PIECE = 4_000_000


def before(flags: np.ndarray) -> np.ndarray:
    """Prefix sums: how many are set before each place."""
    return np.concatenate([[0], np.cumsum(flags)])


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each word; none crosses a border."""
    inside = WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = borders[(borders > 0) & (borders < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


@functools.lru_cache(4)
def powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base)
    found[0] = 1
    return np.multiply.accumulate(found)


def hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = 1 << len(data).bit_length()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(NUMBERS[data] * powers(BASE, n)[: len(data)], out=sums[1:])
    found = (sums[high] - sums[low]) * powers(INVERSE, n)[low]
    found ^= found >> np.uint64(29)
    return found * BASE


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a are those from b, pair by pair."""
    if not len(n):
        return np.zeros(0, bool)
    starts = np.cumsum(n) - n
    along = np.arange(int(n.sum())) - np.repeat(starts, n)
    differ = data[np.repeat(a, n) + along] != data[np.repeat(b, n) + along]
    return np.add.reduceat(differ, starts) == 0


def distinct(data: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of n texts; of: each word's text."""
    if not len(low):
        return np.zeros(n, np.int64)
    # The text above, the hash's upper bits below: words of a text are neighbours, equal ones too.
    shift = np.uint64(64 - max(1, int(n).bit_length()))
    key = (of.astype(np.uint64) << shift) | (hashes(data, low, high) >> (np.uint64(64) - shift))
    order = np.argsort(key)
    key, length = key[order], (high - low)[order]
    equal = np.flatnonzero(key[1:] == key[:-1])
    alike = length[equal] == length[equal + 1]
    alike[alike] = same_bytes(data, low[order[equal[alike]]], low[order[equal[alike] + 1]], length[equal[alike]])
    counts = np.bincount(of, minlength=n) - np.bincount(of[order[equal]], minlength=n)
    for text in np.unique(of[order[equal[~alike]]]).tolist():  # a collision of hashes
        mine = np.flatnonzero(of == text)
        counts[text] = len({data[a:b].tobytes() for a, b in zip(low[mine].tolist(), high[mine].tolist(), strict=True)})
    return counts


def long_text(data: np.ndarray) -> tuple[int, int, int, int, int]:
    """Counts of one text of any length, piece by piece; pieces end with a word. Memory grows with its distinct words only."""
    words = capitals = signs = points = 0
    known: set[bytes] = set()
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and WORD[data[end - 1]] and WORD[data[end]]:
            step = WORD[data[end : end + PIECE]]
            end += int(np.argmin(step)) if not step.all() else len(step)
        piece = data[at:end]
        low, high = words_of(piece, np.zeros(0, np.int64))
        words += len(low)
        capitals, signs, points = capitals + int(CAPITAL[piece].sum()), signs + int(SIGN[piece].sum()), points + int(POINT[piece].sum())
        _, first = np.unique(hashes(piece, low, high), return_index=True) if len(low) else (None, np.zeros(0, np.int64))
        if len(first) and distinct(piece, low, high, np.zeros(len(low), np.int64), 1)[0] == len(first):
            known.update(piece[low[i] : high[i]].tobytes() for i in first)
        else:
            known.update(piece[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True))
        at = end
    return words, len(known), capitals, signs, points


def counts_of(texts: pa.Array) -> np.ndarray:
    """A row for each text: words, distinct words, capitals, signs, code points."""
    texts = texts.cast(pa.large_binary())
    _, offsets, buffer = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[borders[0] : borders[-1]] if buffer is not None else np.zeros(0, np.uint8)
    borders = borders - borders[0]
    if len(data) > 2 * PIECE:
        return np.asarray([long_text(data[a:b]) if b - a > PIECE else counts_of(texts.slice(i, 1))[0] for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True))], np.int64)
    low, high = words_of(data, borders)
    of = np.searchsorted(borders, low, "right") - 1
    n = len(texts)
    sums = [np.diff(before(flags[data])[borders]) for flags in (CAPITAL, SIGN, POINT)]
    return np.stack([np.bincount(of, minlength=n), distinct(data, low, high, of, n), *sums], 1)


def masks_of(counts: np.ndarray) -> np.ndarray:
    """Bits of the first four conditions that fail."""
    words, different, capitals, signs, points = counts.T
    return ((words < MIN_WORDS) | (100 * different < 50 * words) << 1 | (100 * capitals > 3 * points) << 2 | (signs > 0) << 3).astype(np.int32)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").fill_null("")
        # Views of the bytes: no text becomes a Python string.
        digests = [hashlib.sha256(x.as_buffer()).digest() for x in texts.cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("part").cast(pa.string()), pa.array(masks_of(counts_of(texts)), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"]
        )


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail which conditions (bit 0 is A), with and without labels."""
    rows = picked(docs, doc_id=id_col, text=text_col, part=part_col).withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    told = staged(rows.mapInArrow(_scan, "doc_id long, part string, mask int, digest binary"), "masks")
    # Equal rows are one from here on, so none of the keys below is hot because of them.
    known = staged(told.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "mask", "digest").count(), "known")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    labelled = known.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # Keyed by id and text: a text that many ids share is spread.
    own = firsts.withColumn("own", F.lit(COPY))
    marked = labelled.join(own, ["doc_id", "digest"], "left").select("part", (F.col("mask") + COPY - F.coalesce("own", F.lit(0))).alias("mask"), "good", "toxic", "count")
    nameless = told.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("count"))
    return marked.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("count").alias("n"))


def interactions(found: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step of it."""
    steps = [
        (order, i + 1, 1 << FILTERS.index(order[i]), sum(1 << FILTERS.index(x) for x in order[:i]))
        for order in map("".join, permutations(FILTERS))
        for i in range(len(FILTERS))
    ]
    told = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b},"earlier":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<filter_order:string,step:int,bit:int,earlier:int>>")
    masks = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    each = masks.select("*", F.inline(told))
    mask, bit, earlier = F.col("mask"), F.col("bit"), F.col("earlier")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    here = fails & ~gone

    def total(test, value="n"):
        return F.sum(F.when(test, F.col(value)).otherwise(0))

    # Of the 120 orders, a document that fails k filters is removed by each in 120 / k.
    share = F.when(fails, F.expr("n * (120 div bit_count(mask))")).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
