"""Queries of the persistent index, of containment, of chunks by meaning and of shared parts of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, content, derived, graph, lexical, pages, projection, retrieval, selection, similar
from tessera.operators.containment import containing
from tessera.operators.graph import shared_path
from tessera.plans.registry import query
from tessera.plans.search import TERMS, TOKENS, WORDS
from tessera.sources.tables import table

TITLE = "'(?is)<title[^>]*>([^<]*)</title>'"


def indexed(spark: SparkSession, sf_dir: str) -> str:
    """An index of all documents in two batches, the second after the first can be searched."""
    path, docs = shared_path(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    lexical.index_documents(docs.filter(english), path, ["lang"])
    lexical.index_documents(docs.filter(~english), path, ["lang"])
    return path


@query(f"WITH {WORDS} SELECT id AS doc_id, score FROM b ORDER BY score DESC, id LIMIT 20")
def indexed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.indexed_search(spark, indexed(spark, sf_dir), TERMS, 20)


@query(f"WITH {WORDS} SELECT id AS doc_id, score FROM b JOIN documents ON id = documents.doc_id WHERE lang = 'de'")
def indexed_words_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of one language; ranks by the statistics of all."""
    path = indexed(spark, sf_dir)
    lexical.merge_segments(spark, path)
    return lexical.indexed_search(spark, path, TERMS, where=F.col("lang") == "de")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'and', 'with', 'that'])")
def indexed_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.indexed_matches(spark, indexed(spark, sf_dir), ["the", "and", "with", "that"])


@query(f"""WITH t AS (SELECT DISTINCT lower(trim(regexp_extract(html, {TITLE}, 1), ' ')) AS title FROM pages) SELECT title, doc_id FROM t JOIN documents ON contains(lower(text), title) WHERE title <> ''""")
def titles_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages that stand in a document, in any case."""
    titles = table(spark, sf_dir, "pages").select(F.lower(pages.title_of(F.col("html"))).alias("needle")).distinct().withColumn("needle_id", F.col("needle"))
    found = containing(titles, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")))
    return found.select(F.col("needle_id").alias("title"), F.col("text_id").alias("doc_id"))


@query(r"""WITH p AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), f AS (SELECT host, arg_min(path, (length(path), path)) AS first, count(*) AS n FROM p WHERE host <> '' GROUP BY 1 HAVING count(*) > 1),
 a AS (SELECT host, first, n, unnest(range(1, length(first) + 1)) AS i FROM f), c AS (SELECT host, n, i, unnest(range(4, length(first) - i + 2)) AS l, first FROM a), s AS (SELECT host, n, i, l, substr(first, i, l) AS value FROM c),
 k AS (SELECT s.host, i, l, value, n FROM s JOIN p ON s.host = p.host GROUP BY ALL HAVING count(*) FILTER (contains(path, value)) = n) SELECT host, arg_max(value, (l, -i)) AS value, any_value(n) AS n_paths FROM k GROUP BY 1""")
def common_path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.common_substrings(table(spark, sf_dir, "pages"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents where neighbouring sentences differ; vectors count letters."""
    return chunking.semantic_chunks(chunking.letter_vectors(table(spark, sf_dir, "documents")), 120, 20)


@query()
def main_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.main_contents(table(spark, sf_dir, "pages"))


@query("""WITH c AS (SELECT a.conv_id, a.turn, CASE a.role WHEN 'user' THEN 'article' ELSE 'source' END AS kind, lower(a.text) AS a, lower(b.text) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 w AS (SELECT *, list_filter(regexp_split_to_array(a, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 2) AS x, list_filter(regexp_split_to_array(b, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 2) AS y, regexp_extract_all(a, '[0-9]+') AS n FROM c),
 s AS (SELECT *, len(list_filter(x, lambda v: list_contains(y, v))) / greatest(least(len(x), len(y)), 1) AS share FROM w)
 SELECT conv_id, turn, round(CASE WHEN contains(b, a) THEN 1.0 WHEN share >= 0.7 THEN share WHEN kind = 'article' AND len(n) > 0 AND len(list_filter(n, lambda v: NOT contains(b, v))) = 0 THEN 0.6 ELSE 0.0 END, 6) AS support FROM s""")
def turn_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn is held by the one after it."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("source"))
    kind = F.when(F.col("role") == "user", "article").otherwise("source")
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(retrieval.citation_support(F.col("text"), F.col("source"), kind), 6).alias("support"))


CACHE = """a AS (SELECT vec_id AS id, 'q' || vec_id % 5 AS text, CAST(label AS VARCHAR) AS scope, CAST(label % 3 AS VARCHAR) AS domain, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
 c AS (SELECT 'k' || vec_id AS key, 'q' || vec_id AS text, CAST(label AS VARCHAR) AS scope, CAST(label % 3 AS VARCHAR) AS domain, embedding::DOUBLE[] AS v, vec_id AS t FROM embeddings WHERE vec_id % 2 = 1)"""


@query(f"""WITH {CACHE}, e AS (SELECT id, arg_max(key, t) AS key FROM a JOIN c ON a.text = c.text AND a.scope = c.scope GROUP BY 1), n AS (SELECT id, arg_min(key, t) AS key FROM a JOIN c ON a.scope = c.scope AND list_cosine_similarity(a.v, c.v) >= 0.85 GROUP BY 1), p AS (SELECT id, arg_min(key, t) AS key FROM a JOIN c ON a.domain = c.domain AND list_cosine_similarity(a.v, c.v) >= 0.7 GROUP BY 1)
 SELECT a.id, coalesce(e.key, n.key, p.key) AS key, CASE WHEN e.key IS NOT NULL THEN 'exact' WHEN n.key IS NOT NULL THEN 'near' WHEN p.key IS NOT NULL THEN 'partial' ELSE 'none' END AS how FROM a LEFT JOIN e ON a.id = e.id LEFT JOIN n ON a.id = n.id LEFT JOIN p ON a.id = p.id""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the odd vectors, as a cache, serves each of the even ones."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), (F.col("label") % 3).cast("string").alias("domain"), F.col("embedding").alias("v"))
    asked = rows.filter("id % 2 = 0").withColumn("text", F.concat(F.lit("q"), F.col("id") % 5))
    cache = rows.filter("id % 2 = 1").select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("q"), "id").alias("text"), "scope", "domain", "v", F.col("id").alias("at"))
    return selection.cached_answers(asked, cache, 0.85, 0.7)


@query("""WITH r AS (SELECT event_type || user_id % 50 AS name, ts AS t, value >= 20 AS ok FROM events), l AS (SELECT *, max(t) FILTER (ok) OVER (PARTITION BY name) AS last_ok FROM r)
 SELECT name, max(t) AS last_run, max(last_ok) AS last_success, count(*) FILTER (NOT ok AND (last_ok IS NULL OR t > last_ok)) AS failures, count(*) AS runs FROM l GROUP BY 1""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each job after its runs were written in three batches, each from the state before it."""
    runs = table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id") % 50).alias("name"), F.col("ts").alias("at"), (F.col("value") >= 20).alias("ok"))
    low, high = runs.agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [0.3, 0.7])).first()[0]
    at, path = F.unix_micros(F.col("at").cast("timestamp")), shared_path(spark, "runs")
    for batch in (at <= low, (at > low) & (at <= high), at > high):
        derived.write_derived(runs.filter(batch), path, "name", derived.run_state)
    return spark.read.parquet(path).drop("bucket")


@query()
def projected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of vectors in their 50 principal components."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    flat = graph.saved(projection.projected(rows).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    classes = graph.saved(similar.vector_classes(flat))
    copies = classes.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))
    return graph.density_clusters(flat.select(F.col("vec_id").alias("node")), similar.similar_pairs(flat, 0.85).select("a", "b").union(copies))
