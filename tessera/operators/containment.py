"""Which short texts stand in which long ones: a join by containment without comparing all pairs.

Each needle is known by one window of its bytes, 2^k long for the greatest such that fits (at most MOST); of its windows
the one that the fewest needles have. Texts are hashed once, a block of a batch's bytes after the other: hashes of all
windows of those lengths come from doubling (a window's hash is made of its halves'), and only windows whose hash is in
a filter of fixed size, 4 MB whatever the number of needles, go on as rows. These meet the needles by hash; whole needles are then looked
for in the texts that are left, so every pair is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import saved

#: Greatest window, as a power of two.
MOST = 8
#: The filter: 2^10 rows of 2^15 bits.
FILTER_BITS = 25
#: Bits of it that stand for a needle: by the first alone, false hits would grow with needles times texts.
PROBES = 3
PROBE = np.array([1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes of a batch's texts hashed at once, so few that their hashes stay in a core's cache; rows that go on at once.
BLOCK, BATCH = 1 << 15, 1 << 17
START = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(data: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each k of sizes the hashes of all windows of 2^k bytes, by where they begin."""
    found, size = START[data], 1
    for k in range(max(sizes, default=-1) + 1):
        if k:
            if len(found) <= size:
                return
            right = found[size:] >> np.uint64(31)
            right ^= found[size:]
            right *= RIGHT
            found = found[:-size] * LEFT
            found += right
            size *= 2
        if k in sizes:
            yield k, found ^ found >> np.uint64(29)


def _row_windows(column: pa.Array, sizes: set[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of a column's bytes and each k of sizes: k, where the block begins, the hashes of windows from there on, where each row begins and the last ends."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, starts, content = column.buffers()
    begins = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content or b"", np.uint8)[begins[0] : begins[-1]]
    least = 1 << max(sizes, default=0)
    for low in range(0, len(data), BLOCK):
        for k, hashes in window_hashes(data[low : low + BLOCK + least - 1], sizes):
            yield k, low, hashes[:BLOCK], begins - begins[0]


def _distinct(k: int, hashes: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of windows that end within the row where they begin, each once."""
    rows = np.searchsorted(begins, at, "right") - 1
    inside = at + (1 << k) <= begins[rows + 1]
    rows, hashes = rows[inside], hashes[inside]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _batches(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], ids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of k, rows and hashes with the rows' ids, many parts a batch."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        of, hashes = pa.array(np.concatenate([r for _, r, _ in held])), np.concatenate([h for *_, h in held])
        sizes = np.concatenate([np.full(len(r), k, np.int32) for k, r, _ in held])
        return pa.RecordBatch.from_arrays([ids.take(of), pa.array(sizes), pa.array(hashes.view(np.int64))], [name, "k", "hash"])

    for part in parts:
        if len(part[1]):
            held.append(part)
        if sum(len(r) for _, r, _ in held) >= BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _needle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        needles = batch.column("needle")
        of = np.array([min(MOST, n.bit_length() - 1) for n in pc.binary_length(needles).to_pylist()], np.int32)

        def own(needles: pa.Array = needles, of: np.ndarray = of) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for k, low, hashes, begins in _row_windows(needles, set(of.tolist())):
                at = np.arange(low, low + len(hashes))
                mine = of[np.searchsorted(begins, at, "right") - 1] == k
                yield k, *_distinct(k, hashes[mine], at[mine], begins)

        yield from _batches(own(), batch.column("needle_id"), "needle_id")


def probe(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th bit of the filter that stands for each hash."""
    return (hashes * PROBE[i] if i else hashes) >> np.uint64(64 - FILTER_BITS)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hash").to_numpy().view(np.uint64)
        bits = np.concatenate([probe(hashes, i) for i in range(PROBES)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((bits >> 15).astype(np.int32)), pa.array(bits & (1 << 15) - 1)], ["part", "bit"])


def _hits(batches: Iterator[pa.RecordBatch], known: np.ndarray, sizes: set[int]) -> Iterator[pa.RecordBatch]:
    def found(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, low, hashes, begins in _row_windows(texts, sizes):
            # Most windows meet a byte without a bit.
            at = np.flatnonzero(known.take((probe(hashes, 0) >> np.uint64(3)).view(np.int64)))
            hashes, at = hashes[at], at + low
            for i in range(PROBES):
                bit = probe(hashes, i)
                met = np.flatnonzero(known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                hashes, at = hashes[met], at[met]
            if len(at):
                yield k, *_distinct(k, hashes, at, begins)

    for batch in batches:
        yield from _batches(found(batch.column("text")), batch.column("text_id"), "text_id")


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle_id, text_id for each needle (needle_id, needle) that stands in a text (text_id, text), as `contains` has it.

    Both ids are of any type. Null and empty needles stand nowhere, null texts hold nothing. Rows that repeat a needle's or a text's id
    are told by that id. Compare in one case by passing both in it.
    """
    spark = texts.sparkSession
    kept = saved(needles.filter("needle <> ''").select("needle_id", "needle"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = saved(kept.repartition(parts).mapInArrow(_needle_windows, f"needle_id {kept.schema['needle_id'].dataType.simpleString()}, k int, hash long"))
    rare = windows.groupBy("k", "hash").agg(F.count("*").alias("held"))
    # One window a needle: the rarest among the needles, then the smallest hash.
    keys = saved(windows.join(rare, ["k", "hash"]).groupBy("needle_id").agg(F.min(F.struct("held", "hash", "k")).alias("w")).select("needle_id", "w.k", "w.hash"))
    sizes = {r["k"] for r in keys.select("k").distinct().collect()}
    marked = keys.select("hash").mapInArrow(_marks, "part int, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for r in marked:
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(-1))

    rows = texts.select("text_id", "text")
    met = rows.mapInArrow(lambda batches: _hits(batches, shared.value, sizes), f"text_id {rows.schema['text_id'].dataType.simpleString()}, k int, hash long")
    # Ids of texts and needles that share a window; texts and needles themselves come back for these pairs only.
    pairs = saved(met.join(keys, ["k", "hash"]).select("text_id", "needle_id").distinct())
    held = pairs.join(kept, "needle_id").join(rows, "text_id").filter(F.contains("text", "needle"))
    return held.select("needle_id", "text_id").distinct()
