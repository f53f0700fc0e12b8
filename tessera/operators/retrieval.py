"""Search: nearest vectors, ranked words, fusion of rankings, boosts, gates, reranking, selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.functions.vectors import cosine, literal
from tessera.operators.graph import saved

K1, B, RRF = 1.2, 0.75, 60


def nearest(rows: DataFrame, query: list[float], k: int, least: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the highest cosine, `least` at least; ties by id. Each task sends its own k."""
    scored = rows.withColumn("similarity", F.round(cosine(F.col(vector), literal(query)), 6))
    scored = scored if least is None else scored.filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def query_terms(text: str, longer_than: int = 3) -> list[str]:
    """Distinct words in order; short ones go."""
    import re

    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", text.lower()) if len(w) > longer_than))


def is_word(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], k: int | None = None, with_idf: bool = True) -> DataFrame:
    """doc_id, score: Okapi BM25, or its saturation of term counts alone. Statistics cover all rows: the texts are read once, into a row of counts each, and there is no shuffle."""
    # Generators of one row: the filter on scores is not pushed below them, which would split and walk the text again for every term.
    told = docs.select("doc_id", F.explode(F.array(tokens("text"))).alias("w"))
    asked = F.struct(F.size("w").alias("n"), F.filter("w", lambda x: x.isin(*terms)).alias("w"))
    hits = told.select("doc_id", F.explode(F.array(asked)).alias("h")).select("doc_id", "h.n", "h.w")
    counts = saved(hits.select("doc_id", "n", *[F.size(F.filter("w", is_word(term))).alias(f"tf{i}") for i, term in enumerate(terms)]))
    stats = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        idf = F.log(F.lit(1 + (stats["docs"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))) if with_idf else F.lit(1.0)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / (stats["mean"] or 1.0)))
    found = counts.select("doc_id", F.round(score, 6).alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), "doc_id").limit(k) if k else found


def with_all_words(docs: DataFrame, terms: list[str]) -> DataFrame:
    return docs.filter(F.size(F.array_except(F.array(*map(F.lit, terms)), tokens("text"))) == 0)


def with_any_word(docs: DataFrame, terms: list[str]) -> DataFrame:
    return docs.filter(F.arrays_overlap(tokens("text"), F.array(*map(F.lit, terms))))


def ranked(rows: DataFrame, score: str, name: str, id_col: str) -> DataFrame:
    """id and place of rows that are already a short list."""
    return rows.select(id_col, F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias(name))


def reciprocal_fusion(vectors: DataFrame, words: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), alone: float | None = None, pool: int | None = None) -> DataFrame:
    """id, score of two short rankings (id, score) by the sum of weight / (60 + place); a place that is missing counts nothing,
    or as `pool` for what only the vectors found; what only the words found has the weight `alone`, if given."""
    a, b = ranked(vectors, "score", "v", "id"), ranked(words, "score", "w", "id")
    both = a.join(b, "id", "full")
    of = lambda place, weight: F.coalesce(F.lit(weight) / (RRF + F.col(place)), F.lit(0.0))
    lexical = of("w", weights[1]) if pool is None else F.lit(weights[1]) / (RRF + F.coalesce("w", F.lit(pool)))
    score = of("v", weights[0]) + lexical
    if alone is not None:
        score = F.when(F.col("v").isNull(), of("w", alone)).otherwise(score)
    return both.select("id", F.round(score, 8).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def linear_fusion(vectors: DataFrame, words: DataFrame, k: int, share: float = 0.7, scale: float = 10.0) -> DataFrame:
    """id, score: share of the best similarity and the rest of the best rank, scaled and capped at 1."""
    both = vectors.select("id", F.col("score").alias("s"), F.lit(0.0).alias("r")).unionByName(words.select("id", F.lit(0.0).alias("s"), F.col("score").alias("r")))
    score = share * F.max("s") + (1 - share) * F.least(F.max("r") * scale, F.lit(1.0))
    return both.groupBy("id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def effective_similarity(similarity: Column, rank: Column) -> Column:
    return F.coalesce(similarity, F.greatest(F.lit(0.35), F.least(rank * 10, F.lit(0.5))))


def quality_boost(score: Column) -> Column:
    """Of a score from 0 to 100; none counts 1."""
    return F.when(score >= 80, 1.10).when(score >= 60, 1.05).when(score >= 40, 1.0).when(score >= 20, 0.85).when(score.isNotNull(), 0.60).otherwise(1.0)


def recency_boost(year: Column, first: int = 1956, span: int = 70, most: float = 0.15) -> Column:
    return F.coalesce(1 + F.greatest(F.lit(0.0), F.least((year - first) / span, F.lit(1.0))) * most, F.lit(1.0))


def table_boost(value: Column, factors: Mapping[str, float], other: float = 1.0) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, factor in factors.items():
        out = out.when(value == name, factor)
    return out.otherwise(other)


def boosted(score: Column, *factors: Column, most: float = 2.0) -> Column:
    """The score times its factors, whose product counts `most` at most."""
    product = F.lit(1.0)
    for factor in factors:
        product = product * factor
    return score * F.least(product, F.lit(most))


def at_most_per(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def adaptive_bar(n_found: Column, least: float, floor: float, wanted: int = 3) -> Column:
    return F.when(n_found < wanted, F.greatest(F.lit(0.8 * least), F.lit(floor))).otherwise(F.lit(least))


def quality_gate(n_words: Column, n_sources: Column, language: Column, has_vectors: Column | None = None) -> Column:
    """The least score of an answer's sources; higher where only words found them (has_vectors false)."""
    vectors = F.lit(True) if has_vectors is None else has_vectors
    base = F.when(language == "ar", F.when(vectors, 0.20).otherwise(0.22)).otherwise(F.when(vectors, 0.25).otherwise(0.30))
    bar = base * F.when(n_words <= 3, 0.85).otherwise(1.0) * F.when(n_sources <= 2, 0.90).otherwise(1.0)
    return F.greatest(F.lit(0.12), F.least(bar, F.lit(0.30)))


def abstention(mean: Column, n_sources: Column) -> Column:
    return F.when(n_sources == 0, "no_sources").when(mean < 0.30, "abstain").when((mean < 0.40) & (n_sources < 2), "low_quality").otherwise("answer")


def article_set(text: Column) -> Column:
    """The distinct numbers of articles that a text names in French or Arabic, as "258", "42 bis" or "39 مكرر"."""
    arabic = F.regexp_extract_all(F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789"), F.lit(r"(?:الفصل|فصل)\s+([0-9]+(?:\s+مكرر)?)"), 1)
    french = F.regexp_extract_all(F.lower(text), F.lit(r"(?:article|art\.?)\s+([0-9]+(?:\s+(?:bis|ter|quater))?)"), 1)
    return F.array_distinct(F.concat(arabic, french))


def article_bonus(question: Column, text: Column) -> Column:
    """1.25 if one article that the question names is in the text, 1.35 if more are, else 1, of null texts too."""
    n = F.size(F.array_intersect(article_set(question), article_set(text)))
    return F.when(n == 1, 1.25).when(n > 1, 1.35).otherwise(1.0)


def tfidf_rerank(candidates: DataFrame, terms: list[str], share: float = 0.4, question: str = "") -> DataFrame:
    """id, score of a short list (id, text, score): share of the normalized TF-IDF of the terms, the rest of the score; a text that has articles of
    the question gains by article_bonus, up to 1."""
    told = candidates.select("id", "score", tokens("text").alias("w"), article_bonus(F.lit(question), F.col("text")).alias("bonus")).withColumn("n", F.greatest(F.size("w"), F.lit(1)))
    each = told.select("id", "score", "bonus", "n", F.explode_outer(F.filter("w", lambda x: x.isin(*terms))).alias("term"))
    tf = each.groupBy("id", "score", "bonus", "n", "term").agg(F.count("term").alias("m"))
    # The list is short: its statistics are one row a term, and one row for all.
    df = tf.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    total = candidates.agg((F.count("*") + 1).alias("docs"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log(F.col("docs") / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term", "left").groupBy("id", "score", "bonus").agg(F.sum(F.coalesce(F.col("m") / F.col("n") * F.col("idf"), F.lit(0.0))).alias("t"))
    most = raw.agg(F.greatest(F.max("t"), F.lit(0.001)).alias("most"))
    base = share * F.col("t") / F.col("most") + (1 - share) * F.col("score")
    return raw.crossJoin(F.broadcast(most)).select("id", F.round(F.when(F.col("bonus") > 1, F.least(base * F.col("bonus"), F.lit(1.0))).otherwise(base), 6).alias("score"))


def packed_context(rows: DataFrame, budget: int) -> DataFrame:
    """query_id and the ids taken, best first, each that still fits: rows (query_id, id, score, tokens), short lists a query."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate("all", start, lambda a, x: F.when(a["used"] + x["tokens"] <= budget, F.struct((a["used"] + x["tokens"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a))
    return rows.groupBy("query_id").agg(best.alias("all")).select("query_id", fold.alias("f")).select("query_id", "f.used", "f.ids")


def citation_support(claim: Column, source: Column, kind: Column | None = None) -> Column:
    """1 if the source has the claim as it stands, in any case; from 0.7 the claim's words of over two letters that the source has, repeated
    ones counted, over the fewer words of the two; 0.6 if all numbers of an article or a law (kind) stand in it; else 0."""
    low, text = F.lower(claim), F.lower(source)
    long_words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 2)
    a, b = long_words(low), long_words(text)
    share = F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    numbers = F.regexp_extract_all(low, F.lit(r"([0-9]+)"), 1)
    numbered = F.lit(True) if kind is None else kind.isin("article", "law")
    held = numbered & (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(text, n))
    return F.when(F.contains(text, low), 1.0).when(share >= 0.7, share).when(held, 0.6).otherwise(0.0)
