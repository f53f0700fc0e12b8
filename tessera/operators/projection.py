"""Principal components of vectors, from a covariance that tasks sum up and Spark adds together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer rows than this are not projected.
LEAST_ROWS = 16
COMPONENTS = 50
#: Vectors are handled so many at once.
ROWS = 2000


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the places of whole vectors of that size, and these as rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            vectors = some.column("v").to_pylist()
            whole = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v]
            yield some, np.asarray(whole, np.int64), np.asarray([vectors[i] for i in whole], float).reshape(len(whole), size)


def covariance(rows: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (of n) of the vectors v: a task sends size * (size + 3) / 2 + 1 sums, which are added by place."""
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(size), np.zeros((size, size))
        for _, _, x in matrices(batches, size):
            n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            told = np.concatenate([[n], first, second[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told))), pa.array(told)], ["place", "total"])

    found = np.zeros(1 + size + len(upper[0]))
    # Bounded by the vectors' size, not by their number.
    for r in rows.select("v").mapInArrow(sums, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        found[r["place"]] = r["total"]
    n = int(found[0])
    mean, second = found[1 : size + 1] / max(n, 1), np.zeros((size, size))
    second[upper] = found[size + 1 :] / max(n, 1)
    second = second + np.triu(second, 1).T
    return n, mean, second - np.outer(mean, mean)


def components(covariance: np.ndarray, k: int) -> np.ndarray:
    """The k directions of greatest variance as columns; of each, the entry of greatest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    found = vectors[:, np.argsort(values)[::-1][:k]]
    return found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1, 1)


def projected(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """id, v of rows (id, v): vectors in their k principal components. Under LEAST_ROWS rows, or where k is not less than their size, they stay as they are.

    The size is that of most vectors; those of another size, null ones and such with a null in them have null.
    """
    sizes = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    plain = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    if sizes is None:
        return plain
    size = sizes["size"]
    own = F.when((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull()), F.col("v"))
    n, mean, cov = covariance(rows, size) if k < size else (0, None, None)
    if n < LEAST_ROWS:
        return plain.withColumn("v", own)
    axes = components(cov, k)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole, x in matrices(batches, size):
            found: list = [None] * batch.num_rows
            for i, v in zip(whole.tolist(), ((x - mean) @ axes).tolist(), strict=True):
                found[i] = v
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float64()))], ["id", "v"])

    return rows.select("id", "v").mapInArrow(turned, f"id {dict(rows.dtypes)['id']}, v array<double>")
