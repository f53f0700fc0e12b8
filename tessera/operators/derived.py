"""Columns that are derived when rows are written, from the last written state: only the keys of a batch are read and written anew.

The state lies in buckets of its key's hash. A batch touches the buckets of its keys; their files are replaced, partition by
partition, and no other file is opened. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import saved

BUCKETS = 64


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The state as last written, or none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_derived(batch: DataFrame, path: str, key: str, derive: Callable[[DataFrame, DataFrame | None], DataFrame], buckets: int = BUCKETS) -> int:
    """Writes derive(batch, old rows of the batch's keys or None), one row a key; how many keys the batch has.

    Rows of other keys in a touched bucket are copied as they are. Rows with a null key go.
    """
    spark = batch.sparkSession
    rows = saved(batch.filter(F.col(key).isNotNull()))
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = [r[0] for r in rows.select(of).distinct().collect()]
    if not touched:
        return 0
    old = written(spark, path)
    near = None if old is None else saved(old.filter(F.col("bucket").isin(touched)).drop("bucket"))
    keys = rows.select(key).distinct()
    new = derive(rows, None if near is None else near.join(keys, key, "left_semi"))
    whole = new if near is None else new.unionByName(near.join(keys, key, "left_anti"))
    placed = saved(whole).withColumn("bucket", of)
    placed.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return keys.count()


def run_state(runs: DataFrame, old: DataFrame | None) -> DataFrame:
    """name, last_run, last_success, failures (since the last success), runs, of finished runs (name, at, ok), which come after those in old."""
    told = runs.withColumn("last_ok", F.max(F.when(F.col("ok"), F.struct("at", F.lit(1).alias("i")))).over(Window.partitionBy("name"))["at"])
    by = told.groupBy("name").agg(F.max("at").alias("last_run"), F.max("last_ok").alias("last_success"), F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).alias("failures"), F.count("*").alias("runs"))
    if old is None:
        return by
    both = by.join(old.select("name", *[F.col(c).alias(f"old_{c}") for c in ("last_run", "last_success", "failures", "runs")]), "name", "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "name",
        F.greatest("last_run", "old_last_run").alias("last_run"),
        F.coalesce("last_success", "old_last_success").alias("last_success"),
        (F.col("failures") + F.when(F.col("last_success").isNull(), F.coalesce("old_failures", zero)).otherwise(zero)).alias("failures"),
        (F.col("runs") + F.coalesce("old_runs", zero)).alias("runs"),
    )
