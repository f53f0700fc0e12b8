"""Shared helpers: tables, the shared folder, staged tables, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers handle about this much text at once, whatever the batch holds.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (a local session, as in tests) a temporary folder is made
    and set once; a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        return f"file://{found}"
    return found


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    Cuts the lineage and keeps the rows when executors are lost. The files stay
    until the folder's own retention removes them, since the frame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter of ids: PARTS rows of 4 KB, whatever the input. A fuller filter lets more through, and what reads it checks again.
PARTS, PART_BITS = 1024, 1 << 15


def filter_of(ids: DataFrame, column: str) -> DataFrame:
    """(part, bits): a bit is set for the hash of each id."""
    at = F.pmod(F.xxhash64(column), F.lit(PARTS * PART_BITS))
    return ids.select(F.shiftright(at, 15).cast("int").alias("part"), at.bitwiseAND(PART_BITS - 1).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))


def perhaps(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose id may be in the filter: all that are, few others. The filter is broadcast, 4 MB at most."""
    at = F.pmod(F.xxhash64(column), F.lit(PARTS * PART_BITS))
    where = at.bitwiseAND(PART_BITS - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(where, 3) + 1, F.lit(1))), 16, 10).cast("int")
    keyed = rows.withColumn("part", F.shiftright(at, 15).cast("int")).join(F.broadcast(bits), "part")
    return keyed.filter(F.getbit(byte, where.bitwiseAND(7)) == 1).select(*rows.columns)


def tasks(spark: SparkSession, factor: int = 1) -> int:
    """Partitions for a repartition that is spelled out: as many as shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about SLICE_CHARS bytes of text, one row at least.

    Each is a copy: some of Arrow's kernels read arrays that start inside their buffers wrongly.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(text).nbytes // batch.num_rows)
        step = max(1, SLICE_CHARS // size)
        for at in range(0, batch.num_rows, step):
            yield batch.take(pa.array(range(at, min(at + step, batch.num_rows))))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
