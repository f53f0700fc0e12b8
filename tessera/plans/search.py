"""Search, similarity and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import boosts, graph, retrieval, similar
from tessera.plans.registry import query
from tessera.sources.tables import table

#: Words after which the lexical queries look.
TERMS = retrieval.query_terms("thing into there error section Thand orand tionre with that")
LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
V = "e.embedding::DOUBLE[]"
NEAR = f"""q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, round(list_cosine_similarity({V}, q), 6) AS score FROM embeddings e, q)"""
WORDS = f"""d AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), tf AS (SELECT doc_id, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM d, (SELECT unnest({LIST}) AS term) t),
 df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1), b AS (SELECT doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (term), n GROUP BY 1 HAVING score > 0)"""
POOLS = f"{NEAR}, {WORDS}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS v FROM (SELECT * FROM v ORDER BY score DESC, id LIMIT 20)), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS w FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 100))"


PAIRS = """e1 AS (SELECT vec_id, embedding, min(vec_id) OVER (PARTITION BY embedding) AS first FROM embeddings), f AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM e1 WHERE vec_id = first), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM f a JOIN f b ON a.vec_id < b.vec_id)"""


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query: one vector, empty where it is not there."""
    found = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()
    return list(found["embedding"]) if found and found["embedding"] is not None else []


def two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = retrieval.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    words = retrieval.bm25(table(spark, sf_dir, "documents"), TERMS, 100).select(F.col("doc_id").alias("id"), "score")
    return near, words


@query(f"WITH {NEAR} SELECT id AS vec_id, score AS similarity FROM v WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 10")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, 0.2).select("vec_id", "similarity")


@query(f"WITH {NEAR} SELECT vec_id, label, score AS similarity FROM v JOIN embeddings ON id = vec_id WHERE label IN (0, 1, 2) AND score >= 0.1 ORDER BY score DESC, id LIMIT 10")
def filtered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings").filter(F.col("label").isin(0, 1, 2)), first_vector(spark, sf_dir), 10, 0.1).select("vec_id", "label", "similarity")


@query(f"""WITH {NEAR}, s AS (SELECT label FROM embeddings WHERE vec_id = 0), c AS (SELECT id, CASE WHEN e.label = s.label THEN 0.95 ELSE score END AS score FROM v JOIN embeddings e ON id = vec_id, s WHERE id <> 0 AND (e.label = s.label OR score > 0.5)) SELECT id, CAST(score AS DOUBLE) AS score FROM c ORDER BY score DESC, id LIMIT 12""")
def related_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id = 0").first() or {"embedding": [], "label": None}
    scored = rows.filter("vec_id <> 0").withColumn("s", F.round(retrieval.cosine(F.col("embedding"), retrieval.literal(list(asked["embedding"]))), 6))
    same = F.coalesce(F.col("label") == F.lit(asked["label"]), F.lit(False))
    return scored.filter(same | (F.col("s") > 0.5)).select(F.col("vec_id").alias("id"), F.when(same, 0.95).otherwise(F.col("s")).alias("score")).orderBy(F.desc("score"), "id").limit(12)


@query(f"WITH {WORDS} SELECT id AS doc_id, score FROM b ORDER BY score DESC, id LIMIT 20")
def ranked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), TERMS, 20)


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'and', 'with'])")
def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_all_words(table(spark, sf_dir, "documents"), ["the", "and", "with"]).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, {LIST})")
def any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_any_word(table(spark, sf_dir, "documents"), TERMS).select("doc_id")


@query(f"WITH {POOLS} SELECT coalesce(a.id, l.id) AS id, round(coalesce(1.0 / (60 + v), 0) + coalesce(1.0 / (60 + w), 0), 8) AS score FROM a FULL JOIN l ON a.id = l.id ORDER BY score DESC, id LIMIT 10")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_fusion(*two_rankings(spark, sf_dir), 10)


@query(f"""WITH {POOLS} SELECT coalesce(a.id, l.id) AS id, round(CASE WHEN v IS NULL THEN 0.7 / (60 + w) ELSE 0.7 / (60 + v) + 0.3 / (60 + coalesce(w, 100)) END, 8) AS score FROM a FULL JOIN l ON a.id = l.id ORDER BY score DESC, id LIMIT 10""")
def weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_fusion(*two_rankings(spark, sf_dir), 10, (0.7, 0.3), alone=0.7, pool=100)


@query(f"""WITH {POOLS}, u AS (SELECT id, score AS s, 0.0 AS r FROM (SELECT * FROM v ORDER BY score DESC, id LIMIT 20) UNION ALL SELECT id, 0.0, score FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 100)) SELECT id, round(0.7 * max(s) + (1 - 0.7) * least(max(r) * 0.1, 1.0), 6) AS score FROM u GROUP BY 1 ORDER BY score DESC, id LIMIT 10""")
def linear_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.linear_fusion(*two_rankings(spark, sf_dir), 10, scale=0.1)


@query(f"""WITH {NEAR}, q2 AS (SELECT id, score, label, CASE quality WHEN 1 THEN 85 WHEN 0 THEN 15 END AS quality FROM v JOIN embeddings ON id = vec_id LEFT JOIN labels ON id = doc_id),
 f AS (SELECT id, label, round(least(score * CASE WHEN quality >= 80 THEN 1.10 WHEN quality >= 60 THEN 1.05 WHEN quality >= 40 THEN 1.0 WHEN quality >= 20 THEN 0.85 WHEN quality IS NOT NULL THEN 0.60 ELSE 1.0 END * CASE label WHEN 0 THEN 1.2 WHEN 1 THEN 0.4 ELSE 1.0 END, 2.0), 6) AS score FROM q2),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS i FROM f) SELECT id, label, score FROM r WHERE i <= 2""")
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted similarities, two rows a label."""
    scored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.round(retrieval.cosine(F.col("embedding"), retrieval.literal(first_vector(spark, sf_dir))), 6).alias("s"))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 85).when(F.col("quality") == 0, 15).alias("quality"))
    score = retrieval.boosted(F.col("s"), retrieval.quality_boost(F.col("quality")), retrieval.table_boost(F.col("label"), {0: 1.2, 1: 0.4}))
    return retrieval.at_most_per(scored.join(quality, "id", "left").select("id", "label", F.round(score, 6).alias("score")), "label", 2, F.desc("score"), F.asc("id"))


@query(f"""WITH {WORDS}, c AS (SELECT id, score / 40 AS score FROM b ORDER BY b.score DESC, id LIMIT 50), x AS (SELECT id, score, term, tf / greatest(dl, 1) AS share, tf FROM c JOIN tf ON id = doc_id), k AS (SELECT count(*) + 1 AS docs FROM c), g AS (SELECT term, ln(docs / (1 + count(*) FILTER (WHERE tf > 0))) + 1 AS idf FROM x, k GROUP BY term, docs),
 t AS (SELECT id, score, sum(share * idf) AS t FROM x JOIN g USING (term) GROUP BY 1, 2), m AS (SELECT greatest(max(t), 0.001) AS most FROM t) SELECT id, round(0.4 * t / most + (1 - 0.4) * score, 6) AS score FROM t, m""")
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = retrieval.bm25(docs, TERMS, 50).select(F.col("doc_id").alias("id"), (F.col("score") / 40).alias("score"))
    return retrieval.tfidf_rerank(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(found), "id"), TERMS)


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.embedding <> b.embedding),
 m AS (SELECT e.vec_id, min(o.vec_id) AS first FROM embeddings e JOIN embeddings o ON e.embedding = o.embedding GROUP BY 1), f AS (SELECT vec_id FROM m WHERE vec_id = first) SELECT a, b, similarity, CASE WHEN similarity >= 0.95 THEN 'duplicate' WHEN similarity >= 0.85 THEN 'near' ELSE 'related' END AS band FROM p WHERE similarity >= 0.8 AND a IN (SELECT * FROM f) AND b IN (SELECT * FROM f)""")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different vectors, by the smallest id of equal ones."""
    return similar.similar_pairs(table(spark, sf_dir, "embeddings"), 0.8).withColumn("band", similar.band_name(F.col("similarity")))


@query("SELECT e.vec_id AS id, min(o.vec_id) AS class FROM embeddings e JOIN embeddings o ON e.embedding = o.embedding GROUP BY 1")
def equal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.vector_classes(table(spark, sf_dir, "embeddings"))


@query(f"""WITH {PAIRS}, s AS (SELECT vec_id AS id, label, coalesce(quality, 0) AS q FROM embeddings LEFT JOIN labels ON vec_id = doc_id), j AS (SELECT a, b, similarity, (x.label, -x.q, a) < (y.label, -y.q, b) AS first FROM p JOIN s x ON a = x.id JOIN s y ON b = y.id WHERE similarity >= 0.9 AND x.label <> y.label)
 SELECT CASE WHEN first THEN a ELSE b END AS kept, CASE WHEN first THEN b ELSE a END AS dropped, similarity FROM j""")
def cross_source_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    facts = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("source"), F.col("label").alias("priority")).join(quality, "id", "left")
    return similar.cross_source(similar.similar_pairs(rows, 0.9), facts)


@query(f"""WITH RECURSIVE {PAIRS}, l AS (SELECT a, b FROM p WHERE similarity >= 0.85 UNION SELECT first, vec_id FROM e1 WHERE first <> vec_id), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c AS (SELECT a FROM g GROUP BY 1 HAVING count(*) >= 2), i AS (SELECT a, b FROM g WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)),
 r AS (SELECT a AS node, a AS o FROM c UNION SELECT r.node, i.b FROM r JOIN i ON r.o = i.a), k AS (SELECT node, min(o) AS cluster FROM r GROUP BY 1), n AS (SELECT g.a AS node, min(k.cluster) AS near FROM g JOIN k ON g.b = k.node GROUP BY 1) SELECT vec_id AS node, coalesce(cluster, near, -1) AS cluster FROM embeddings LEFT JOIN k ON vec_id = k.node LEFT JOIN n ON vec_id = n.node""")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of vectors within a cosine of 0.85 of each other."""
    rows = table(spark, sf_dir, "embeddings")
    classes = graph.saved(similar.vector_classes(rows))
    copies = classes.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))
    return graph.density_clusters(rows.select(F.col("vec_id").alias("node")), similar.similar_pairs(rows, 0.85).select("a", "b").union(copies))


@query()
def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part, supplier = table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    # Parts are even numbers and suppliers odd ones, names where a key's double would not fit.
    if lines.filter(" OR ".join(f"{key} NOT BETWEEN {-(1 << 62)} AND {(1 << 62) - 1}" for key in ("l_partkey", "l_suppkey"))).isEmpty():
        found = graph.pagerank(lines.select(F.shiftleft(part, 1).alias("src"), (F.shiftleft(supplier, 1) + 1).alias("dst")), both=True)
        found = found.withColumn("node", F.concat(F.when(F.col("node") % 2 == 0, "p").otherwise("s"), F.shiftright("node", 1)))
    else:
        found = graph.pagerank(lines.select(F.concat(F.lit("p"), part).alias("src"), F.concat(F.lit("s"), supplier).alias("dst")), both=True)
    return found.select("node", F.round("rank", 8).alias("rank"), F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
 w AS (SELECT 'c7' AS url, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.url WHERE w.depth < 3) SELECT url, min(depth) AS depth FROM w GROUP BY 1""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"))
    links = edge(table(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey").union(edge(lines, "o", "l_orderkey", "p", "l_partkey")).union(edge(lines, "p", "l_partkey", "s", "l_suppkey"))
    return graph.crawl_order(spark, links, ["c7"], 3).select("url", "depth")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), m AS (SELECT conv_id, count(*) AS n, avg(length(text)) / 1000.0 AS mean FROM t GROUP BY 1) SELECT conv_id, n, round(mean, 6) AS mean, CASE WHEN n = 0 THEN 'no_sources' WHEN mean < 0.30 THEN 'abstain' WHEN mean < 0.40 AND n < 2 THEN 'low_quality' ELSE 'answer' END AS decision,
 round(greatest(0.12, least(CASE WHEN mean > 0.2 THEN 0.25 ELSE 0.30 END * CASE WHEN n <= 3 THEN 0.85 ELSE 1.0 END * CASE WHEN n <= 2 THEN 0.90 ELSE 1.0 END, 0.30)), 6) AS gate FROM m""")
def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"), (F.avg(F.length("text")) / 1000.0).alias("m"))
    gate = retrieval.quality_gate(F.col("n"), F.col("n"), F.lit("fr"), F.col("m") > 0.2)
    return by.select("conv_id", "n", F.round("m", 6).alias("mean"), retrieval.abstention(F.col("m"), F.col("n")).alias("decision"), F.round(gate, 6).alias("gate"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS n, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM conversations), l AS (SELECT conv_id, list({'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[]), 't': t, 'id': CAST(turn AS VARCHAR)} ORDER BY n DESC, turn, t) AS l FROM t GROUP BY 1),
 f AS (SELECT conv_id, list_reduce(list_prepend({'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[]), 't': CAST(0 AS BIGINT), 'id': ''}, l), lambda a, x: CASE WHEN a.used + x.t <= 200 THEN {'used': a.used + x.t, 'ids': list_append(a.ids, x.id), 't': x.t, 'id': x.id} ELSE a END) AS f FROM l) SELECT conv_id AS query_id, f.used AS used, array_to_string(f.ids, ',') AS ids FROM f""")
def packed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation the turns, longest first, that fit in a budget of tokens."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("long").alias("id"), F.length("text").cast("double").alias("score"), F.ceil(F.length("text") / 4).alias("tokens"))
    return retrieval.packed_context(turns, 200).select("query_id", "used", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {POOLS}, s AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 20), r AS (SELECT * FROM b ORDER BY score DESC, id LIMIT 100) SELECT coalesce(s.id, r.id) AS id, CAST(round(coalesce(s.score, greatest(0.35, least(r.score / 1000 * 10, 0.5))), 6) AS DOUBLE) AS score FROM s FULL JOIN r ON s.id = r.id")
def effective_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of both rankings' rows; what only the words found has one of its rank."""
    near, words = two_rankings(spark, sf_dir)
    both = near.select("id", F.col("score").alias("s")).join(words.select("id", (F.col("score") / 1000).alias("r")), "id", "full")
    return both.select("id", F.round(retrieval.effective_similarity(F.col("s"), F.col("r")), 6).alias("score"))


@query(f"""WITH {NEAR}, n AS (SELECT label, count(*) FILTER (score >= 0.2) AS n, count(*) AS rows FROM v JOIN embeddings ON id = vec_id GROUP BY 1), b AS (SELECT label, n, CASE WHEN n < 3 THEN greatest(0.8 * 0.2, 0.1) ELSE 0.2 END AS bar FROM n)
 SELECT b.label, b.n, CAST(round(bar, 6) AS DOUBLE) AS bar, count(*) FILTER (score >= bar) AS found FROM b JOIN embeddings e ON e.label = b.label JOIN v ON v.id = e.vec_id GROUP BY ALL""")
def adaptive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label how many vectors are at the bar, the lower bar where these are few, and how many that one finds."""
    scored = graph.saved(table(spark, sf_dir, "embeddings").select("label", F.round(retrieval.cosine(F.col("embedding"), retrieval.literal(first_vector(spark, sf_dir))), 6).alias("s")))
    bars = scored.groupBy("label").agg(F.count_if(F.col("s") >= 0.2).alias("n")).withColumn("bar", retrieval.adaptive_bar(F.col("n"), 0.2, 0.1))
    return scored.join(bars, "label").groupBy("label", "n", F.round("bar", 6).alias("bar")).agg(F.count_if(F.col("s") >= F.col("bar")).alias("found"))


@query("SELECT o_orderkey, CAST(round(1 + greatest(0.0, least((year(o_orderdate) - 1956) / 70, 1.0)) * 0.15, 9) AS DOUBLE) AS boost FROM orders")
def recency_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.coalesce(retrieval.recency_boost(F.year("o_orderdate"))), 9).alias("boost"))


@query("SELECT user_id, count(*) AS errors, CAST(least(1.0 * pow(2.0, count(*)), 60.0) AS DOUBLE) AS seconds FROM events WHERE event_type = 'error' GROUP BY 1")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait before each user's next try."""
    by = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    return by.select("user_id", "errors", graph.backoff_seconds(F.col("errors")).alias("seconds"))


ARTICLES_ASKED = "what do Article 5 and الفصل 12 say?"
ARTICLE_SET = r"list_distinct(list_concat(regexp_extract_all(translate(X, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '(?:الفصل|فصل)\s+([0-9]+(?:\s+مكرر)?)', 1), regexp_extract_all(lower(X), '(?:article|art\.?)\s+([0-9]+(?:\s+(?:bis|ter|quater))?)', 1)))"


@query(f"""WITH {WORDS}, c AS (SELECT id, score / 40 AS score FROM b ORDER BY b.score DESC, id LIMIT 50), x AS (SELECT id, score, term, tf / greatest(dl, 1) AS share, tf FROM c JOIN tf ON id = doc_id), k AS (SELECT count(*) + 1 AS docs FROM c), g AS (SELECT term, ln(docs / (1 + count(*) FILTER (WHERE tf > 0))) + 1 AS idf FROM x, k GROUP BY term, docs),
 t AS (SELECT id, score, sum(share * idf) AS t FROM x JOIN g USING (term) GROUP BY 1, 2), m AS (SELECT greatest(max(t), 0.001) AS most FROM t), s AS (SELECT id, 0.4 * t / most + (1 - 0.4) * score AS score FROM t, m),
 h AS (SELECT doc_id, len(list_intersect(['5', '12'], {ARTICLE_SET.replace("X", "text")})) AS n FROM documents) SELECT id, round(CASE n WHEN 0 THEN score WHEN 1 THEN least(score * 1.25, 1) ELSE least(score * 1.35, 1) END, 6) AS score FROM s JOIN h ON id = h.doc_id""")
def article_reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As reranked_search, with the articles that are asked for."""
    docs = table(spark, sf_dir, "documents")
    found = retrieval.bm25(docs, TERMS, 50).select(F.col("doc_id").alias("id"), (F.col("score") / 40).alias("score"))
    return retrieval.tfidf_rerank(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(found), "id"), TERMS, question=ARTICLES_ASKED)


#: What a registry of sources says of some: type, category, origin.
REGISTRY = {"src0": ("code", "codes", "iort_gov_tn"), "src1": ("jurisprudence", "jurisprudence", "cassation_tn"), "src2": ("modele", "procedures", "9anoun_tn"), "src3": ("doctrine", "doctrine", "da5ira_tn"), "src4": ("code", "codes", "autre")}
ASKED = boosts.Question("Quel délai d'appel selon l'article 5 ?", [(["appel"], ["And", "The"], 1.5)], ["en"], ["es"], stance="defense")


def registered(column: int) -> str:
    return "CASE source " + " ".join(f"WHEN '{name}' THEN '{told[column]}'" for name, told in REGISTRY.items()) + " END"


@query(f"""WITH {WORDS}, c AS (SELECT id, score / 40 AS s FROM b ORDER BY b.score DESC, id LIMIT 50), q AS (SELECT doc_id, CASE quality WHEN 1 THEN 85 WHEN 0 THEN 15 END AS quality FROM labels),
 r AS (SELECT id, s, lang, text, string_split(text, chr(10))[1] AS name, {registered(0)} AS type, {registered(1)} AS category, {registered(2)} AS origin, try_cast(regexp_extract(text, '(19[5-9][0-9]|20[0-2][0-9])', 1) AS INTEGER) AS year, quality
 FROM c JOIN documents d ON id = d.doc_id LEFT JOIN q ON id = q.doc_id), f AS (SELECT id, s, CASE type WHEN 'code' THEN 1.3 WHEN 'jurisprudence' THEN 1.1 WHEN 'doctrine' THEN 1 WHEN 'modele' THEN 0.95 ELSE 0.85 END::DOUBLE * CASE WHEN contains(name, 'And') OR contains(name, 'The') THEN 1.5 ELSE 1 END
 * CASE lang WHEN 'en' THEN 1.2 WHEN 'es' THEN 0.4 ELSE 1 END * CASE category WHEN 'codes' THEN 1.08::DOUBLE * 1.02 WHEN 'jurisprudence' THEN 1.04 WHEN 'doctrine' THEN 0.97 WHEN 'procedures' THEN 0.95 ELSE 1 END
 * CASE WHEN category IN ('codes', 'jurisprudence') AND year BETWEEN 1956 AND year(current_date) THEN 1 + least((year - 1956) / 70, 1) * 0.15 ELSE 1 END * CASE WHEN category = 'jurisprudence' THEN 1.3 ELSE 1 END * CASE WHEN contains(text, '!!') THEN 0.85 ELSE 1 END
 * CASE quality WHEN 85 THEN 1.1 WHEN 15 THEN 0.6 ELSE 1 END * CASE origin WHEN 'iort_gov_tn' THEN 1.2 WHEN 'cassation_tn' THEN 1.12 WHEN '9anoun_tn' THEN 1.08 WHEN 'da5ira_tn' THEN 1.05 ELSE 1 END * CASE category WHEN 'codes' THEN 1.1 WHEN 'procedures' THEN 1.2 ELSE 1 END
 * CASE WHEN category = 'codes' AND contains(name, 'COC') THEN 1.25 ELSE 1 END * CASE WHEN contains(text, 'الفصل 5') OR contains(lower(text), 'article 5') THEN 1.8 ELSE 1 END AS product FROM r) SELECT id, round(least(product, 2), 6) AS boost, round(s * least(product, 2), 6) AS score FROM f""")
def boosted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents by words, with the whole product of boosts."""
    docs = table(spark, sf_dir, "documents")
    found = retrieval.bm25(docs, TERMS, 50).select(F.col("doc_id").alias("id"), (F.col("score") / 40).alias("similarity"))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 85).when(F.col("quality") == 0, 15).alias("quality"))
    told = [boosts.mapped(F.col("source"), {name: x[i] for name, x in REGISTRY.items()}) for i in range(3)]
    none = F.lit(None).cast("string")
    year = F.nullif(F.regexp_extract("text", "(19[5-9][0-9]|20[0-2][0-9])", 1), F.lit("")).cast("int")
    sources = docs.select(
        F.col("doc_id").alias("id"), "text", F.split("text", "\n")[0].alias("name"), told[0].alias("type"), told[1].alias("category"), told[2].alias("origin"),
        none.alias("doc_type"), none.alias("document_type"), none.alias("norm_level"), F.col("lang").alias("branch"), year.alias("year"), F.contains("text", F.lit("!!")).alias("ocr_low"),
    )
    rows = boosts.boosted_sources(sources.join(F.broadcast(found), "id").join(quality, "id", "left"), ASKED)
    return rows.select("id", F.round("boost", 6).alias("boost"), F.round("score", 6).alias("score"))
