"""MinHash near-duplicates with sequential Bayesian verification.

1. Sketch: each text becomes its set of distinct word shingles (hashed to 64 bits)
   and HASHES minimum hashes. Texts with equal sets (by SHA-256 of the whole set)
   form a class; from here on its smallest id stands for it, so exact copies never
   meet again.
2. Candidates: BANDS bands of ROWS hashes; two texts at similarity 0.8 share no
   band with probability 2e-5 (at 0.85: 7e-9), two at 0.3 share one with 0.004.
   Buckets of one text are dropped. A bucket's smallest id is its leader, and the
   texts of all buckets with one leader are a group: two texts that share a bucket
   share a group, and a cluster's many buckets have few leaders.
3. Large groups first meet their leader alone, whose links merge most of the group
   into one component.
4. What is left are pairs of one group in different components. A group's rows are
   dealt into blocks of bounded bytes; texts outside of the group's largest
   component meet all blocks, those inside meet only the former. Two blocks
   meet in one task; pairs are compared there and never become rows. So
   the work between blocks grows with the group times the texts outside of its
   largest component, and what a task holds does not grow.
5. Verification, of each pair whose sizes allow a link: signatures are compared a
   batch at a time; after each the posterior probability (uniform prior) that the
   similarity reaches the threshold is looked up, and below `miss` the pair is
   dropped. Survivors are confirmed on their full sets, unless links found before
   join them already; a task emits fewer links than it has rows.
6. Components of the confirmed links give one class id, the smallest id reachable.

Words are runs of other than ASCII white space, with A-Z in lower case. Fewer words
than a shingle takes are one shingle; a null or empty text has none and links
with nothing. Repeated rows of an id share its fate, and texts given under one id
count as one document. A null id is its own (null) component and is kept. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import filter_of, perhaps, picked, slices, staged, table

BANDS, ROWS = 59, 8
HASHES = BANDS * ROWS
BATCH = 20
MISS = 1e-9
#: Groups of more rows, or of more bytes than a block, meet their leader alone first.
LARGE = 128
#: A block of a group holds about so many bytes and rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1024
BLOCK = 1 << 15
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
_DRAWN = np.random.default_rng(20240601)
FACTORS = _DRAWN.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _DRAWN.integers(0, 1 << 63, HASHES, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after the other, each sorted, and where each ends."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[codes] if distinct else np.zeros(0, bool)
    h, of = hashes[codes[real]] if distinct else np.zeros(0, np.uint64), of[real]
    counts = np.bincount(of, minlength=len(texts))
    if not len(h):
        return h, np.zeros(len(texts), np.int64)
    x = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words if len(x) else 0):
        x = mixed(x * PRIME + h[j : j + len(x)])
    inside = of[: len(x)] == of[words - 1 :] if len(x) else np.zeros(0, bool)
    x, owner = x[inside], of[: len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        ends = np.cumsum(counts)
        few = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            there = counts[short] > j
            few[there] = mixed(few[there] * PRIME + h[ends[short[there]] - counts[short[there]] + j] + np.uint64(1))
        x, owner = np.concatenate([x, few]), np.concatenate([owner, short])
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[new], np.cumsum(np.bincount(owner[new], minlength=len(texts)))


def signatures(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minimum hashes of each set, in blocks, so that memory does not grow with a text's length."""
    starts = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > starts)
    out = np.full((len(ends), HASHES), np.iinfo(np.uint64).max)
    first = starts[full]
    for low in range(0, len(x), BLOCK):
        part = x[low : low + BLOCK]
        a, b = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, low + len(part))
        at = np.maximum(first[a:b] - low, 0)
        rows = full[a:b]
        t = np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, FACTORS[k], out=t)
            np.add(t, TERMS[k], out=t)
            out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(t, at))
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = mixed(x * PRIME + signature[:, k])
        out[:, b] = x
    return out.view(np.int64)


SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """A row per text; the signature keeps one byte of each minimum hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, ends = shingles(batch.column("text"), words)
            found = signatures(x, ends)
            starts = np.concatenate([[0], ends[:-1]])
            keys = [hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(ends) + 1, BANDS), pa.int32()), pa.array(bands_of(found).ravel()))
            small = (found >> np.uint64(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ends - starts), pa.array(keys, pa.binary()), bands, pa.array([s.tobytes() for s in small], pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "signature"])

    return docs.mapInArrow(rows, SKETCH)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """A row per text: its whole set and that set's key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, ends = shingles(batch.column("text"), words)
            starts = np.concatenate([[0], ends[:-1]])
            held = [x[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys = [hashlib.sha256(h).digest() for h in held]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "set_key", "held"])

    return docs.mapInArrow(rows, "doc_id long, set_key binary, held binary")


@functools.cache
def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each batch of hashes compared: the fewest matches at which the posterior probability
    of a similarity of at least the threshold is not below `miss`."""
    s = (np.arange(2_000) + 0.5) / 2_000
    match = s + (1 - s) / 256  # equal bytes of unequal hashes
    high = s >= threshold
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(match) + (n - m) * np.log1p(-match)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, high].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(posterior >= miss)))
    return np.asarray(out)


def common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges two sorted runs
    return int((both[1:] == both[:-1]).sum())


@dataclass
class Met:
    """Rows of one task: two blocks of a group, or one."""

    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray  # whether the row is of the first block
    sizes: np.ndarray
    signatures: np.ndarray
    sets: list[bytes]


def links_of(met: Met, inside: bool, least: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join labels: between the first block and the others, and, with `inside`, within the first."""
    label, place = met.labels.copy(), np.arange(len(met.ids))
    for i in np.flatnonzero(met.first).tolist():
        others = ~met.first | (place > i) if inside else ~met.first
        able = others & (label != label[i]) & (np.minimum(met.sizes, met.sizes[i]) * 100 >= np.maximum(met.sizes, met.sizes[i]) * percent)
        alive = np.flatnonzero(able)
        matches = np.zeros(len(alive), np.int64)
        for k, fewest in enumerate(least.tolist()):
            if not len(alive):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (met.signatures[alive, part] == met.signatures[i, part]).sum(axis=1)
            stays = matches >= fewest
            alive, matches = alive[stays], matches[stays]
        mine = np.frombuffer(met.sets[i], np.uint64) if len(alive) else None
        for j in alive.tolist():
            if label[j] == label[i]:
                continue
            other = np.frombuffer(met.sets[j], np.uint64)
            n = common(mine, other)
            if 100 * n >= percent * (len(mine) + len(other) - n):
                yield int(met.ids[i]), int(met.ids[j])
                label[label == label[j]] = label[i]


def starred(edges: DataFrame) -> DataFrame:
    """edges (u, v), v < u, after a large and a small star: each halves the distances to the smallest node or better.

    A node's neighbours are only ever reduced by min, never gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u")
    return staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")


def edges_of(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): the smallest node reachable."""
    edges = staged(edges_of(links), "links")
    before = None
    while True:
        edges = starred(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def blocks(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def dealt(groups: DataFrame) -> DataFrame:
    """Each row of groups (leader, doc_id, label, outer, p, q) once for each task (leader, i, j) that it goes to.

    The p blocks of outer rows meet the q blocks of the others (j < q) and one another (j >= q).
    """
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("outer"), F.col("p")).otherwise(F.col("q"))).cast("int")
    at = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.alias("first"))
    over = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    others = F.filter(F.transform(over("p"), lambda k: at(F.least("mine", k), F.col("q") + F.greatest("mine", k), F.col("mine") < k)), lambda x: x["i"] + F.col("q") != x["j"])
    outer = F.concat(F.transform(over("q"), lambda k: at(F.col("mine"), k, F.lit(True))), others)
    inner = F.transform(over("p"), lambda k: at(k, F.col("mine"), F.lit(False)))
    return groups.withColumn("mine", mine).select("leader", "doc_id", "label", F.explode(F.when(F.col("outer"), outer).otherwise(inner)).alias("t")).select("leader", "doc_id", "label", "t.*")


def verified(groups: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all pairs that meet (see dealt), save those that other links make needless."""
    least = least_matches(percent / 100)

    def found(rows: pa.Table, at: list[int]) -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        for low, high in zip(at[:-1], at[1:], strict=True):
            if high - low < 2:
                continue
            part = rows.slice(low, high - low)
            ids, labels, first, n = (part.column(c).to_numpy() for c in ("doc_id", "label", "first", "n_shingles"))
            signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
            links += links_of(Met(ids, labels, first, n, signatures, part.column("held").to_pylist()), part.column("j")[0].as_py() == 0, least, percent)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            have = pa.Table.from_batches([batch])
            have = have if rest is None else pa.concat_tables([rest, have])
            keys = np.stack([have.column(c).to_numpy() for c in key])
            at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            yield found(have, at)
            rest = have.slice(at[-1])  # of the last task more rows may follow
        if rest is not None:
            yield found(rest, [0, rest.num_rows])

    key = ("leader", "i", "j")
    told = dealt(groups).join(members, "doc_id").select(*key, "first", "doc_id", "label", "n_shingles", "signature", "held")
    return told.repartition(*key).sortWithinPartitions(*key).mapInArrow(rows, "a long, b long")


def linked(met: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside groups (leader, doc_id, n_shingles), enough of them to make the components whole."""
    size = F.col("n_shingles") * 8 + HASHES
    rows, total = F.count("*").alias("rows"), F.sum(size).alias("total")
    large = met.groupBy("leader").agg(rows, total).filter((F.col("rows") > LARGE) | (F.col("total") > BLOCK_BYTES))
    led = met.join(large, "leader").select("leader", "doc_id", F.col("doc_id").alias("label"), (F.col("doc_id") == F.col("leader")).alias("outer"), F.lit(1).alias("p"), blocks(F.col("rows"), F.col("total")).alias("q"))
    stars = staged(verified(led, members, percent), "stars")

    told = met.join(components(stars).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("leader", "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    parts = told.groupBy("leader", "label").agg(rows, total)
    top = F.max(F.struct("rows", "total", "label")).alias("top")
    open_ = parts.groupBy("leader").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), top).filter("rows > top.rows")
    p, q = blocks(F.col("rows") - F.col("top.rows"), F.col("total") - F.col("top.total")), blocks(F.col("top.rows"), F.col("top.total"))
    groups = told.join(open_.select("leader", F.col("top.label").alias("largest"), p.alias("p"), q.alias("q")), "leader")
    links = verified(groups.select("leader", "doc_id", "label", (F.col("label") != F.col("largest")).alias("outer"), "p", "q"), members, percent)
    return stars.unionByName(staged(links, "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row stands for its component), a row per input row."""
    chosen = picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = staged(sketches(chosen, words), "sketches")
    some = made.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    mine = staged(some.select("doc_id", "set_key").join(classes, "set_key").distinct(), "classes")
    firsts = mine.filter("doc_id = first").select("doc_id", "set_key")
    whole = some.join(firsts, ["doc_id", "set_key"], "left_semi")
    # Sets so small that one shingle more is too many link with equal sets only.
    spread = whole.filter(F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * percent).select("doc_id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("high")).filter("leader < high").select("bucket", "leader")
    met = staged(spread.join(shared, "bucket").select("leader", "doc_id").distinct(), "groups")
    # Few texts of a corpus share a bucket: a filter of bounded size spares the others the shuffles.
    ids = met.select("doc_id").distinct()
    bits = staged(filter_of(ids, "doc_id"), "filter")
    marks = perhaps(some, "doc_id", bits).join(ids, "doc_id", "left_semi").join(firsts, ["doc_id", "set_key"], "left_semi").select("doc_id", "set_key", "n_shingles", "signature").dropDuplicates(["doc_id", "set_key"])
    held = sets(perhaps(chosen, "doc_id", bits), words).dropDuplicates(["doc_id", "set_key"])
    members = staged(held.join(marks, ["doc_id", "set_key"]).drop("set_key"), "members")
    # An id has a row for each of its texts; the largest counts, as sizes only bound blocks.
    sized = staged(met.join(members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"), "sized")
    links = linked(sized, members, percent)
    # An id that was given with several texts is in several classes: its first ones join them.
    joined = components(links.unionByName(mine.filter("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    told = made.select("doc_id", "n_shingles").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return told.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
