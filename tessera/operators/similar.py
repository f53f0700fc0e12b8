"""Pairs of similar vectors: products of blocks of rows, then exact cosines of what reaches the bar.

Equal vectors form a class first, which the smallest id stands for, so copies never meet. Every two blocks are
multiplied in a task, so no pair is missed, and only pairs at the bar become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import saved

#: Rows of a block at most, about, and those under which no more blocks are made.
BLOCK, LEAST_BLOCK = 32_768, 1000
#: Rows of both sides that are multiplied at once, so that their products stay in a core's cache, and pairs whose cosines are taken at once.
TILE, PAIRS = (512, 2048), 1 << 17
#: More than the error of a cosine in float32.
SLACK = 1e-4


def vector_classes(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, class: the smallest id with an equal vector. Counted before the shuffle, so a hot vector is one row a task."""
    keyed = rows.select(F.col(id_col).alias("id"), F.sha2(F.array_join(F.transform(F.col(vector), lambda x: x.cast("string")), ","), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class")


def sure_vectors(rows: DataFrame) -> DataFrame:
    """rows (v, ...) without null or empty vectors and those with a null in them; numbers stay floats or become doubles."""
    kept = rows.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    return kept if dict(rows.dtypes)["v"] == "array<float>" else kept.withColumn("v", F.col("v").cast("array<double>"))


def blocks_for(spark: SparkSession, n: int) -> int:
    """Blocks of at most about BLOCK rows, more of smaller ones where that gives every task a pair of blocks."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(n / BLOCK), min(math.ceil(math.sqrt(2 * tasks)), n // LEAST_BLOCK))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def by_size(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the vectors of each size, these as rows, and their directions as float32."""
    sizes, found = pc.list_value_length(rows.column("v")).to_numpy(), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = rows.column("v").take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
        with np.errstate(all="ignore"):
            wide = x.astype(float)
            length = np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
            found[size] = at, x, np.where(length > 0, wide / length, 0).astype(np.float32)
    return found


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row, summed from the first place on as `functions.vectors.dot` does."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k].astype(float) * y[:, k]
    return total


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row, as `functions.vectors.cosine` gives it."""
    with np.errstate(all="ignore"):
        lengths = np.sqrt(dots(x, x)) * np.sqrt(dots(y, y))
        return np.where(lengths != 0, dots(x, y) / lengths, 0.0)


def products(left: np.ndarray, right: np.ndarray, least: float, alone: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tiles of all pairs that may reach the bar: where they begin in `left` and `right`, and which do; a float32 product is off by less than SLACK.

    Tiles go along the rows of `right` first. With `alone` both are the same rows, and tiles below the diagonal are left out."""
    bar = np.float32(least - SLACK)
    for at in range(0, len(left), TILE[0]):
        for to in range(at // TILE[1] * TILE[1] if alone else 0, len(right), TILE[1]):
            with np.errstate(all="ignore"):
                yield at, to, ~(left[at : at + TILE[0]] @ right[to : to + TILE[1]].T < bar)


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of rows (id, v): every pair with a cosine of at least about `least`, once, and its exact cosine.

    A task has two blocks of rows, so memory is bounded by BLOCK and a row is sent once for each block. All pairs are multiplied:
    arithmetic is quadratic, a few nanoseconds a pair.
    """
    spark = rows.sparkSession
    known = sure_vectors(rows.select("id", "v"))
    n = blocks_for(spark, known.count())
    dealt = known.withColumn("block", block_of(n)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # Pairs of blocks are numbered along the triangle, a task each.
    pair = (high * (high + 1) / 2 + low).cast("int")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        every = pa.Table.from_batches(held)
        block = every.column("block").to_numpy()
        first = every.filter(pa.array(block == block.min()))
        alone = block.min() == block.max()
        second = first if alone else every.filter(pa.array(block == block.max()))
        if not alone or every.column("other")[0].as_py() == block[0]:
            mine = by_size(first)
            for size, (there, y, right) in (mine if alone else by_size(second)).items():
                if size in mine:
                    here, x, left = mine[size]
                    for at, to, hit in products(left, right, least, alone):
                        i, j = np.divmod(np.flatnonzero(hit.ravel()), hit.shape[1])
                        i, j = i + at, j + to
                        if alone:
                            i, j = i[j > i], j[j > i]
                        for cut in range(0, len(i), PAIRS):
                            a, b = i[cut : cut + PAIRS], j[cut : cut + PAIRS]
                            ids = [t.column("id").combine_chunks().take(pa.array(p)) for t, p in ((first, here[a]), (second, there[b]))]
                            yield pa.RecordBatch.from_arrays([*ids, pa.array(cosines(x[a], y[b]))], ["a", "b", "similarity"])

    kind = dict(rows.dtypes)["id"]
    found = dealt.repartitionById(n * (n + 1) // 2, pair).mapInArrow(meet, f"a {kind}, b {kind}, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def first_near(wanted: DataFrame, held: DataFrame, least: float, key: str) -> DataFrame:
    """id, at, key: for each row of wanted (id, `key`, v) the first by (at, key) of held (id, `key`, v, first: at, key) with the same `key` and a cosine of at
    least `least`. Blocks of both sides meet in a task each, where a row of wanted keeps its first one only."""
    spark = wanted.sparkSession
    ways = held.schema["first"].dataType
    left = sure_vectors(wanted.select("id", F.col(key).alias("scope"), "v", F.lit(None).cast(ways).alias("first")))
    right = sure_vectors(held.select("id", F.col(key).alias("scope"), "v", "first"))
    n = [max(1, blocks_for(spark, x.count()) // 2) for x in (left, right)]
    other = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = left.withColumns({"asked": F.lit(True), "block": block_of(n[0])}).withColumn("other", other(n[1])).withColumn("pair", F.col("block") * n[1] + F.col("other"))
    given = right.withColumns({"asked": F.lit(False), "block": block_of(n[1])}).withColumn("other", other(n[0])).withColumn("pair", F.col("other") * n[1] + F.col("block"))
    both = dealt.select("pair", "asked", "scope", "v", "id", "first")
    both = both.unionByName(given.select("pair", "asked", "scope", "v", F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "first"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        every = pa.Table.from_batches(got)
        asked, given = (every.filter(pa.array(every.column("asked").to_numpy() == x)) for x in (True, False))
        order = pa.table({"at": pc.struct_field(given.column("first"), "at"), "key": pc.struct_field(given.column("first"), "key")})
        given = given.take(pc.sort_indices(order, [("at", "ascending"), ("key", "ascending")], null_placement="at_start"))
        for scope in pc.unique(asked.column("scope")).to_pylist():
            w, h = (t.filter(pc.equal(t.column("scope"), scope)) for t in (asked, given))
            mine = by_size(w)
            for size, (there, y, units) in by_size(h).items():
                if size not in mine:
                    continue
                here, x, directions = mine[size]
                waits = np.ones(len(x), bool)
                for at, to, hit in products(directions, units, least):
                    left = np.flatnonzero(hit.any(1) & waits[at : at + len(hit)])
                    while len(left):
                        best = hit[left].argmax(1)
                        sure = ~(cosines(x[left + at], y[best + to]) < least)
                        told = [w.column("id").combine_chunks().take(pa.array(here[left[sure] + at])), h.column("first").combine_chunks().take(pa.array(there[best[sure] + to]))]
                        yield pa.RecordBatch.from_arrays(told, ["id", "first"])
                        waits[left[sure] + at] = False
                        # What only the float32 product put at the bar gives way to the next.
                        left, best = left[~sure], best[~sure]
                        hit[left, best] = False
                        left = left[hit[left].any(1)]

    found = both.repartitionById(n[0] * n[1], "pair").mapInArrow(meet, f"id {dict(wanted.dtypes)['id']}, first {dict(held.dtypes)['first']}")
    return found.groupBy("id").agg(F.min("first").alias("first")).select("id", "first.at", "first.key")


def similar_pairs(rows: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """a, b, similarity (a < b) of the classes of equal vectors (by smallest id) with a cosine of at least `least`."""
    first = vector_classes(rows, id_col, vector).filter("id = class").select("id")
    some = saved(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).join(first, "id", "left_semi"))
    return saved(near_pairs(some, least).select("a", "b", F.round("similarity", 6).alias("similarity")).filter(F.col("similarity") >= least))


def band_name(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "duplicate").when(similarity >= 0.85, "near").otherwise("related")


def cross_source(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """kept, dropped, similarity of pairs from different sources: kept is the better by priority, then quality, then id. facts: id, source, priority, quality."""
    side = lambda name: facts.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("source", "priority", "quality")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_source <> b_source")
    order = lambda n: F.struct(F.col(f"{n}_priority"), -F.coalesce(f"{n}_quality", F.lit(0)), F.col(n))
    first = order("a") < order("b")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("kept"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dropped"), "similarity")
