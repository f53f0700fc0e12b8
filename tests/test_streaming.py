"""Streams over small files against the same rows in batch."""

from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def collected(spark, stream, at, mode="append"):
    rows = []
    jobs.run_available(stream, str(at), lambda df, _: rows.extend(df.collect()), mode)
    return rows


def parts(spark, df, at, n=3):
    for k in range(n):
        df.filter(F.col(df.columns[0]) % n == k).coalesce(1).write.mode("append").parquet(str(at))
    return str(at)


def test_windows(spark, tmp_path):
    events = table(spark, SF_DIR, "events")
    path = parts(spark, events, tmp_path / "e")
    found = collected(spark, jobs.windowed(jobs.source(spark, path, EVENTS), "1 day", "60 days"), tmp_path / "c", "complete")
    want = jobs.windowed(events, "1 day", "60 days").collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in want} and want


def test_rate_limit(spark, tmp_path):
    start = 1_700_000_000
    rows = [(k, start + s, 1) for k, s in enumerate([0, 1, 2, 3, 100, 200])] + [(50, start, 2)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long").selectExpr("event_id", "to_timestamp_ntz(cast(timestamp_seconds(s) as timestamp_ntz)) as ts", "user_id")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = jobs.rate_limit(jobs.source(spark, str(tmp_path / "e"), "event_id long, ts timestamp_ntz, user_id long"), 3, 60)
    found = {r.event_id: r.allowed for r in collected(spark, out, tmp_path / "c", "append")}
    assert found == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 50: True}


def test_changes(spark, tmp_path):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, "u", "b"), (4, "v", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    out = jobs.changed_pages(jobs.source(spark, str(tmp_path / "p"), "page_id long, url string, html string"))
    assert {r.page_id: r.kind for r in collected(spark, out, tmp_path / "c")} == {1: "new", 2: "same", 3: "changed", 4: "new"}


def test_append_once(spark, tmp_path):
    path = parts(spark, table(spark, SF_DIR, "events"), tmp_path / "e")
    for _ in range(2):
        jobs.append_to(str(tmp_path / "out"), jobs.source(spark, path, EVENTS, 1), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table(spark, SF_DIR, "events").count()
