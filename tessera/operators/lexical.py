"""A persistent inverted index of words, in segments that are appended and merged.

Under the index's folder:

- `postings/segment=S/bucket=B`: rows of a word and documents that have it (term, docs: doc_id, tags, n, tf), sorted by
  term, B being the term's hash; n is the document's number of words. A row has the documents of one Arrow batch, so its size is bounded. Bucket -1, of the term "", has all documents.
- `dead/segment=S`: documents of earlier segments (of, doc_id, n) that S replaces or removes.
- `segments`: a row for each finished segment, written last, with the totals of its documents. What a killed
  run leaves behind is in no such row and is never read.

A search reads the buckets of the asked terms in living segments, nothing else: lengths stand in the postings,
totals in the segments' rows. A frequent term's postings are spread over SPREAD tasks and files of its bucket. One
writer at a time; readers need no lock, since files never change.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens
from tessera.operators.retrieval import K1, B

BUCKETS, SPREAD = 64, 8
#: Terms that leave a task's Python at once.
TERMS_AT_ONCE = 1 << 11
#: Totals are documents, those with a text, and words.
SEGMENTS = "seq long, segment string, docs long, texts long, words long, lost_docs long, lost_texts long, lost_words long, buckets int, replaces array<string>"
DEAD = "of string, doc_id long, n long, segment string"


@dataclass(frozen=True)
class State:
    """The living segments of an index and the totals of its documents."""

    segments: list[str]
    totals: tuple[int, int, int]
    buckets: int
    next_seq: int


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def opened(spark: SparkSession, path: str) -> State:
    """The index as its finished segments have it; a row each, so their number is what merging bounds."""
    try:
        rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").orderBy("seq").collect()
    except AnalysisException:
        rows = []
    gone = {s for r in rows for s in r["replaces"]}
    live = [r for r in rows if r["segment"] not in gone]
    docs, texts, words = (sum(r[x] - r[f"lost_{x}"] for r in live) for x in ("docs", "texts", "words"))
    return State([r["segment"] for r in live], (docs, texts, words), rows[0]["buckets"] if rows else BUCKETS, rows[-1]["seq"] + 1 if rows else 0)


def _dead(spark: SparkSession, path: str, state: State) -> DataFrame:
    try:
        found = spark.read.schema(DEAD).parquet(f"{path}/dead")
    except AnalysisException:
        return spark.createDataFrame([], DEAD)
    return found.filter(F.col("segment").isin(state.segments) & F.col("of").isin(state.segments))


def _postings(spark: SparkSession, path: str, state: State, buckets: Sequence[int]) -> DataFrame:
    """Postings of the buckets in living segments, without those of replaced documents."""
    found = spark.read.parquet(f"{path}/postings").filter(F.col("segment").isin(state.segments) & F.col("bucket").isin(list(buckets)))
    dead = _dead(spark, path, state).select(F.col("of").alias("segment"), "doc_id")
    return _unpacked(found).join(dead, ["segment", "doc_id"], "left_anti")


def _totals(rows: DataFrame) -> tuple[int, int, int]:
    return tuple(rows.agg(F.count("*"), F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first())


def _commit(spark: SparkSession, path: str, state: State, segment: str, totals: tuple[int, int, int], lost: tuple[int, int, int], buckets: int, replaces: list[str]) -> None:
    row = [(state.next_seq, segment, *totals, *lost, buckets, replaces)]
    spark.createDataFrame(row, SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _lose(spark: SparkSession, path: str, state: State, segment: str, ids: DataFrame) -> tuple[int, int, int]:
    """Marks living documents of these ids as dead; their totals."""
    if not state.segments:
        return 0, 0, 0
    old = _postings(spark, path, state, [-1]).select(F.col("segment").alias("of"), "doc_id", "n").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    old.select("of", "doc_id", "n").write.parquet(f"{path}/dead/segment={segment}")
    return _totals(spark.read.schema("of string, doc_id long, n long").parquet(f"{path}/dead/segment={segment}"))


def _write(postings: DataFrame, path: str, segment: str) -> None:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = postings.repartition(parts, "bucket", F.pmod(F.xxhash64(F.col("docs")[0]["doc_id"]), F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")


def _unpacked(packed: DataFrame) -> DataFrame:
    return packed.select(*[c for c in packed.columns if c != "docs"], F.inline("docs"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of documents with their words (w, a list) a row a word with the documents that have it, and one of the term "" with all."""
    for batch in batches:
        rest, lists = batch.drop_columns(["w"]), batch.column("w")
        words = lists.flatten().dictionary_encode()
        size = max(len(batch), 1)
        found, tf = np.unique(words.indices.to_numpy().astype(np.int64) * size + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
        terms, rows = found // size, found % size
        starts = np.append(np.flatnonzero(np.diff(terms, prepend=-1)), len(found))
        yield _row_a_term(pa.array([""], pa.string()), np.array([0, len(batch)]), rest, np.zeros(len(batch), np.int32))
        for low in range(0, len(starts) - 1, TERMS_AT_ONCE):
            ends = starts[low : low + TERMS_AT_ONCE + 1]
            of = slice(ends[0], ends[-1])
            yield _row_a_term(words.dictionary.take(pa.array(terms[ends[:-1]])), ends - ends[0], rest.take(pa.array(rows[of])), tf[of].astype(np.int32))


def _row_a_term(terms: pa.Array, ends: np.ndarray, docs: pa.RecordBatch, tf: np.ndarray) -> pa.RecordBatch:
    postings = pa.StructArray.from_arrays([*docs.columns, pa.array(tf)], [*docs.schema.names, "tf"])
    return pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), postings)], ["term", "docs"])


def index_documents(docs: DataFrame, path: str, tags: Sequence[str] = (), buckets: int = BUCKETS) -> str:
    """Adds a segment of docs (doc_id, text, tags); documents that the index has under the same id are replaced.

    Empty texts are documents of no words; null ones are documents that the mean length leaves out. A batch in which an id is null or repeats is refused, before anything
    of it can be seen. Every segment has the tags of the first.
    """
    spark, segment = docs.sparkSession, f"s{uuid.uuid4().hex}"
    state = opened(spark, path)
    buckets = state.buckets if state.segments else buckets
    # Words are counted within their document: no shuffle before the one that deals postings out.
    told = docs.select(F.col("doc_id").cast("long"), *tags, tokens("text").alias("w"))
    told = told.select("doc_id", *tags, F.size("w").cast("long").alias("n"), "w")
    posting = T.StructType([*told.schema.fields[:-1], T.StructField("tf", T.IntegerType())])
    each = told.mapInArrow(_packed, T.StructType([T.StructField("term", T.StringType()), T.StructField("docs", T.ArrayType(posting))]))
    _write(each.withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))), path, segment)
    mine = _unpacked(spark.read.parquet(f"{path}/postings/segment={segment}").filter("bucket = -1")) if not docs.isEmpty() else docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("n"))
    totals = _totals(mine)
    if totals[0] != mine.agg(F.count_distinct("doc_id")).first()[0]:
        raise ValueError("an id is null or repeats")
    if totals[0]:
        _commit(spark, path, state, segment, totals, _lose(spark, path, state, segment, mine), buckets, [])
    return segment


def forget_documents(ids: DataFrame, path: str) -> int:
    """Removes documents by doc_id; how many there were."""
    spark, segment = ids.sparkSession, f"s{uuid.uuid4().hex}"
    state = opened(spark, path)
    lost = _lose(spark, path, state, segment, ids)
    if lost[0]:
        _commit(spark, path, state, segment, (0, 0, 0), lost, state.buckets, [])
    return lost[0]


def merge_segments(spark: SparkSession, path: str) -> str | None:
    """One segment in place of all living ones, without what is dead. Readers of the old ones are not disturbed."""
    state = opened(spark, path)
    if len(state.segments) < 2:
        return None
    segment = f"s{uuid.uuid4().hex}"
    packed, dead = spark.read.parquet(f"{path}/postings").filter(F.col("segment").isin(state.segments)), _dead(spark, path, state)
    if not dead.isEmpty():
        # A row's first document tells it from the term's other rows.
        living = _unpacked(packed.withColumn("first", F.col("docs")[0]["doc_id"])).join(dead.select(F.col("of").alias("segment"), "doc_id"), ["segment", "doc_id"], "left_anti")
        fields = packed.schema["docs"].dataType.elementType.names
        packed = living.groupBy("segment", "bucket", "term", "first").agg(F.collect_list(F.struct(*fields)).alias("docs"))
    _write(packed.select("term", "docs", "bucket"), path, segment)
    _commit(spark, path, state, segment, state.totals, (0, 0, 0), state.buckets, state.segments)
    return segment


def indexed_search(spark: SparkSession, path: str, terms: Sequence[str], k: int | None = None, where: Column | None = None, with_idf: bool = True) -> DataFrame:
    """doc_id, score by Okapi BM25, as `retrieval.bm25` gives it, from the asked terms' buckets. where: a filter on tags; statistics stay those of all documents."""
    state = opened(spark, path)
    if not state.segments or not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    hits = _postings(spark, path, state, sorted({bucket_of(t, state.buckets) for t in terms})).filter(F.col("term").isin(*terms))
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()} if with_idf else {}
    found = hits if where is None else hits.filter(where)
    tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    (docs, texts, words), score = state.totals, F.lit(0.0)
    mean = words / texts if words else 1.0
    for i, term in enumerate(terms):
        idf = math.log(1 + (docs - df.get(term, 0) + 0.5) / (df.get(term, 0) + 0.5)) if with_idf else 1.0
        score = score + F.lit(idf) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("n") / mean))
    ranked = found.groupBy("doc_id", "n").agg(*tf).select("doc_id", F.round(score, 6).alias("score")).filter("score > 0")
    return ranked.orderBy(F.desc("score"), "doc_id").limit(k) if k else ranked


def indexed_matches(spark: SparkSession, path: str, terms: Sequence[str], every: bool = True, where: Column | None = None) -> DataFrame:
    """doc_id of documents with all terms, or with any."""
    state = opened(spark, path)
    if not state.segments or not terms:
        return spark.createDataFrame([], "doc_id long")
    hits = _postings(spark, path, state, sorted({bucket_of(t, state.buckets) for t in terms})).filter(F.col("term").isin(*terms))
    found = (hits if where is None else hits.filter(where)).groupBy("doc_id").agg(F.count("*").alias("held"))
    return found.filter(F.col("held") == len(set(terms)) if every else F.lit(True)).select("doc_id")
