"""Structured Streaming over file sources: indexing increments, windows, rate limits, change detection.

The file source's offsets and the checkpoint take the place of a job table's claims, retries and
orphan recovery; maxFilesPerTrigger bounds a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that has arrived, in batches, then ends; a later run goes on where this one stopped."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def append_to(path: str, stream: DataFrame, checkpoint: str) -> None:
    """As run_available, into Parquet, each row once."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for run_available: each batch in a folder of its own number, written anew when the batch is, so that a run killed half-way leaves every row once."""

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each


def windowed(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are left out."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = told.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return told.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limit(events: DataFrame, most: int, seconds: float, block: float = 2.0, late: str | None = None) -> DataFrame:
    """user_id, event_id, allowed: at most `most` events of a user in the last seconds; one too many blocks the
    user for `block` times as long. The state of a user is the few times that count and the end of a block.

    late: how much later than others an event may come; with it, a user's state goes once no event could meet it, so the
    state is as large as the users of that time, not as all that ever were.
    """
    keep = seconds * max(1.0, block)

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for at, event in zip(rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["event_id"], strict=True):
            times = [t for t in times if t > at - seconds]
            allowed = at >= until and len(times) < most
            if allowed:
                times.append(at)
            elif at >= until:
                until = at + block * seconds
            out.append((key[0], int(event), allowed))
        state.update((times, until))
        if late is not None:
            state.setTimeoutTimestamp(max(int((max([*times, until]) + keep) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    told, ends = events.select("user_id", "event_id", "ts"), GroupStateTimeout.NoTimeout
    if late is not None:
        told, ends = told.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    return told.groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, allowed boolean", "times array<double>, until double", "append", ends)


def changed_pages(pages: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """url, page_id, kind (new, changed, same) of each page as it comes, by the hash last seen of its URL. A URL not seen for keep_ms is forgotten, if that is given."""

    def compare(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for page, digest in pd.concat(list(frames)).sort_values("page_id")[["page_id", "digest"]].itertuples(index=False):
            out.append((key[0], int(page), "new" if last is None else "same" if digest == last else "changed"))
            last = digest
        state.update((last,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["url", "page_id", "kind"])

    told = pages.select("url", "page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    return told.groupBy("url").applyInPandasWithState(compare, "url string, page_id long, kind string", "digest string", "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
