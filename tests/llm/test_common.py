import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import common


def test_slices_are_copies(monkeypatch):
    """Arrow's ascii_lower reads arrays that start inside their buffers wrongly; slices must not."""
    monkeypatch.setattr(common, "SLICE_CHARS", 64)
    texts = [f"É{'A' * (i % 7)} É {i}" for i in range(100)] + [None, "", "x" * 500]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got = [x for s in common.slices(iter([batch, batch.slice(0, 0)]), "text") for x in pc.ascii_lower(s.column("text").cast(pa.large_string())).to_pylist()]
    assert got == [None if t is None else t.replace("A", "a") for t in texts]


def test_filter_of_ids(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "concat('t', doc_id) as text")
    ids = rows.filter("doc_id % 7 = 0").select("doc_id")
    got = {r.doc_id for r in common.perhaps(rows, "doc_id", common.filter_of(ids, "doc_id")).collect()}
    want = set(range(0, 5000, 7))
    assert want <= got and len(got - want) < 10
    assert common.perhaps(rows, "doc_id", common.filter_of(ids.limit(0), "doc_id")).count() == 0
