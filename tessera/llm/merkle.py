"""Merkle manifest of a table of documents, with an inclusion proof for each row.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves of a source,
by doc_id, become nodes by sixteens until one is left, the source's subroot;
subroots, by source, become the root in the same way.

1. Spark computes leaves, one pass over the texts, and places them: a sort by range
   over (source, doc_id, leaf) and counts per task give each leaf its number within its
   source, so a source of any size is spread over many tasks.
2. A bucket is an aligned run of 16^3 numbers of one source. Executors take whole
   buckets as Arrow tables and run DuckDB queries on them, level by level: ordered
   string_agg, then sha256.
3. Spark joins bucket roots to nodes, sixteen at a time, up to subroots and root, and
   carries the siblings of each step back down: a bucket's outer proof.
4. Outer proofs go to their buckets, where DuckDB computes each row's proof and folds
   its leaf, or that of tampered text, back to the root.

Rows with null ids come first in their source, a null source comes first. Rows that repeat
an id are ordered by leaf; equal rows have equal leaves and take neighbouring places.
An empty table has an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import picked, staged, table, tasks

FAN = 16
#: Levels inside a bucket, which holds FAN ** LEVELS leaves.
LEVELS = 3
#: A DuckDB query takes whole buckets of at least this many leaves together (fewer at a task's end) and fewer than that, a bucket and an Arrow batch.
CHUNK = 4096
#: Copies of a row are spread over this many keys of the sort.
SALTS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(**changed: Column) -> Column:
    """SHA-256 of the fields: their UTF-8 byte counts, a colon and their values, or a hyphen."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """part (the source, null before all), doc_id, leaf, changed (the leaf with capitals lowered, where tampered says so and it differs)."""
    lowered = digest(text=F.translate("text", UPPER, LOWER))
    return docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("part"),
        "doc_id",
        digest().alias("leaf"),
        F.when(tampered, lowered).alias("changed"),
    )


def placed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with pos (the number within the part, from 0, by the order given) and n (the part's rows)."""
    keys = [F.asc_nulls_first(c) for c in ("part", *order, "salt")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    ranged = salted.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("salt")
    ordered = staged(ranged.withColumn("place", F.monotonically_increasing_id()), name).withColumn("task", F.shiftright("place", 33))
    counts = ordered.groupBy("part", "task").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    all_of, before = Window.partitionBy("part"), Window.partitionBy("part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "task", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(all_of).alias("n"))
    return ordered.join(starts, ["part", "task"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "task", "shift")


def depth(n: Column, levels: int = LEVELS) -> Column:
    """Levels of a tree over n leaves, at most the levels of a bucket."""
    found = F.when(n <= 1, 0)
    for k in range(1, levels):
        found = found.when(n <= FAN**k, k)
    return found.otherwise(levels)


@functools.cache
def engine():
    """One DuckDB connection for each worker process."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def answer(sql: str, **tables: pa.Table) -> pa.Table:
    con = engine()
    for name, rows in tables.items():
        con.register(name, rows)
    found = con.execute(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return found


def nodes_sql() -> str:
    """n0 to n3: the nodes of each level of each bucket, with what was hashed."""
    parts = ["n0 AS (SELECT bucket, pos, levels, leaf AS h FROM leaves)"]
    for k in range(1, LEVELS + 1):
        cat = f"SELECT bucket, pos // {FAN} AS pos, any_value(levels) AS levels, string_agg(h, '' ORDER BY pos) AS cat FROM n{k - 1} WHERE levels >= {k} GROUP BY bucket, pos // {FAN}"
        parts.append(f"n{k} AS MATERIALIZED (SELECT *, sha256(cat) AS h FROM ({cat}))")
    return "WITH " + ", ".join(parts)


ROOTS = nodes_sql() + " " + " UNION ALL ".join(f"SELECT bucket, h FROM n{k} WHERE levels = {k}" for k in range(LEVELS + 1))


def siblings(cat: str, place: str) -> tuple[str, str]:
    """What stands before and after a digest among those that were hashed together."""
    return f"left({cat}, 64 * ({place}))", f"substr({cat}, 64 * ({place}) + 65)"


def proofs_sql(outer: int) -> str:
    """Each row's proof and folded root; outer: the most steps above a bucket."""
    parts = ["w0 AS (SELECT *, coalesce(changed, leaf) AS f, '' AS proof FROM leaves)"]
    for k in range(1, LEVELS + 1):
        low, high = siblings("n.cat", f"w.pos // {FAN ** (k - 1)} % {FAN}")
        kept = "w.* EXCLUDE (f, proof)"
        parts.append(
            f"w{k} AS (SELECT {kept}, CASE WHEN n.cat IS NULL THEN w.f ELSE sha256({low} || w.f || {high}) END AS f, CASE WHEN n.cat IS NULL THEN w.proof ELSE w.proof || {low} || {high} END AS proof"
            f" FROM w{k - 1} w LEFT JOIN n{k} n ON w.bucket = n.bucket AND w.pos // {FAN**k} = n.pos AND w.levels >= {k})"
        )
    last = f"o0 AS (SELECT w.*, o.lows, o.highs, o.subroot, o.root FROM w{LEVELS} w JOIN outers o ON w.bucket = o.bucket)"
    parts.append(last)
    for k in range(1, outer + 1):
        parts.append(f"o{k} AS (SELECT * REPLACE (CASE WHEN len(lows) >= {k} THEN sha256(lows[{k}] || f || highs[{k}]) ELSE f END AS f, CASE WHEN len(lows) >= {k} THEN proof || lows[{k}] || highs[{k}] ELSE proof END AS proof) FROM o{k - 1})")
    return nodes_sql() + ", " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root FROM o{outer}"


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from sorted rows, with the bucket's number in the table."""
    held: list[pa.Table] = []

    def numbered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        part = rows.column("part").combine_chunks().dictionary_encode()
        part = (part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part).indices.to_numpy(zero_copy_only=False)
        of = rows.column("bucket_of").to_numpy()
        starts = np.ones(len(of), bool)
        starts[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
        return rows.append_column("bucket", pa.array(np.cumsum(starts) - 1)), np.flatnonzero(starts)

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        rows, starts = numbered(pa.concat_tables(held).combine_chunks())
        if cut := int(starts[-1]):
            yield rows.slice(0, cut)
        held = [rows.slice(cut).drop_columns(["bucket"])]
    if held and sum(x.num_rows for x in held):
        yield numbered(pa.concat_tables(held).combine_chunks())[0]


def bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_buckets(batches):
        found = answer(ROOTS, leaves=rows.select(["bucket", "pos", "levels", "leaf"])).sort_by("bucket")
        first = rows.take(pa.array(np.unique(rows.column("bucket").to_numpy(), return_index=True)[1]))
        yield from pa.table({"part": first.column("part"), "bucket_of": first.column("bucket_of"), "n": first.column("n"), "h": found.column("h")}).to_batches()


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def bucket_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_buckets(batches):
        told = pc.is_null(rows.column("leaf"))
        outers = rows.filter(told).select(["bucket", "lows", "highs", "subroot", "root"])
        outer = pc.max(pc.list_value_length(outers.column("lows"))).as_py()
        found = answer(proofs_sql(outer), outers=outers, leaves=rows.filter(pc.invert(told)).select(["bucket", "doc_id", "pos", "levels", "leaf", "changed"]))
        yield from found.cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])).to_batches()


def climbed(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """part, pos, top, lows, highs: each node's way up its part's tree. nodes: part, pos, n (of the part), h; most: the greatest n.

    A step is an aggregation by sixteens; its table has a sixteenth of the rows of the one before.
    """
    level, below = nodes.select("part", "pos", "n", "h"), []
    tops = []
    while most > 1:
        tops.append(level.filter("n = 1"))
        run = F.sort_array(F.collect_list(F.struct("pos", "h")))
        runs = level.filter("n > 1").groupBy("part", F.expr(f"pos div {FAN}").alias("up"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")).agg(run.alias("run"))
        runs = staged(runs.withColumn("h", F.sha2(F.array_join("run.h", ""), 256)), f"{name}-runs")
        steps = F.expr("transform(run, (x, i) -> struct(x.pos AS pos, array_join(slice(run.h, 1, i), '') AS low, array_join(slice(run.h, i + 2, size(run)), '') AS high))")
        below.append(runs.select("part", "up", F.inline(steps)))
        level = runs.select("part", F.col("up").alias("pos"), "n", "h")
        most = -(-most // FAN)
    none = F.array().cast("array<string>")
    ways = level.select("part", "pos", F.col("h").alias("top"), none.alias("lows"), none.alias("highs"))
    for step, done in zip(reversed(below), reversed(tops), strict=True):
        above = ways.withColumnRenamed("pos", "up")
        joined = step.join(above, ["part", "up"]).select("part", "pos", "top", F.concat(F.array("low"), "lows").alias("lows"), F.concat(F.array("high"), "highs").alias("highs"))
        ways = joined.unionByName(done.select("part", "pos", F.col("h").alias("top"), none.alias("lows"), none.alias("highs")))
    return ways


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A row for each of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: for which rows of doc_id the text's capitals are lowered before its leaf is
    folded to the root with the original siblings; by default for none.
    """
    rows = picked(docs, **{c: c for c in FIELDS})
    found = staged(leaves(rows, F.lit(False) if tampered is None else tampered), "leaves")
    bucket = placed(found, "ordered", "doc_id", "leaf").withColumn("bucket_of", F.expr(f"pos div {FAN**LEVELS}"))
    numbered = staged(bucket.withColumn("pos", F.col("pos") % FAN**LEVELS).withColumn("levels", depth(F.col("n"))), "placed")
    whole = numbered.select("part", "bucket_of", "n", "pos", "levels", "leaf").repartition(tasks(docs.sparkSession), "part", "bucket_of").sortWithinPartitions("part", "bucket_of", "pos")
    roots = staged(whole.mapInArrow(bucket_roots, "part string, bucket_of long, n long, h string"), "roots")
    inner = roots.select("part", F.col("bucket_of").alias("pos"), F.expr(f"(n + {FAN**LEVELS - 1}) div {FAN**LEVELS}").alias("n"), "h")
    up = staged(climbed(inner, inner.agg(F.max("n")).first()[0] or 0, "sources"), "ways")
    # One row a source from here on; their order is that of the parts.
    tops = up.filter("pos = 0").select(F.lit("").alias("part"), F.col("part").alias("source"), F.col("top").alias("h"))
    sources = staged(placed(tops, "tops", "source"), "subroots")
    over = climbed(sources, sources.count(), "root").join(sources.select("pos", "source"), "pos").select(F.col("source").alias("part"), F.col("top").alias("root"), F.col("lows").alias("more"), F.col("highs").alias("higher"))
    outer = up.join(over, "part").select(
        "part", F.col("pos").alias("bucket_of"), F.col("top").alias("subroot"), "root", F.concat("lows", "more").alias("lows"), F.concat("highs", "higher").alias("highs"), F.lit(-1).cast("long").alias("pos")
    )
    both = numbered.unionByName(outer, allowMissingColumns=True).repartition(tasks(docs.sparkSession), "part", "bucket_of").sortWithinPartitions("part", "bucket_of", "pos")
    return both.mapInArrow(bucket_proofs, RESULT).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
