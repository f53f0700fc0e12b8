"""Choosing among search results: query kinds, expansion, merging of sources, gates, graph boosts, cached answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.filters import tag_overlap
from tessera.operators.graph import saved
from tessera.operators.similar import first_near

# Asked like these, in lower case, a question is about words rather than meaning. Words of Arabic count after a letter of ASCII
# or a digit only, where a boundary of ASCII words is.
EDGE, INSIDE = r"(?:^|[^a-z0-9_])", r"[a-z0-9_]"
KEYWORD_QUERIES = (
    rf"{EDGE}(article|art\.?)\s+[0-9]{{1,4}}",
    rf"{INSIDE}(فصل|الفصل)\s+[0-9]{{1,4}}",
    rf"(?:{EDGE}code|{INSIDE}قانون|{INSIDE}مجلة)\s+(civil|pénal|commerce|travail)",
    rf"(?:{EDGE}loi|{INSIDE}قانون)\s+(n°|رقم|عدد)\s*[0-9]{{4}}",
    rf"(?:{EDGE}décret|{INSIDE}قرار|{INSIDE}أمر)\s+(n°|رقم|عدد)\s*[0-9]{{4}}",
    r"^\s*[0-9]{1,4}\s*$",
    rf"(?:{EDGE}tribunal|{INSIDE}محكمة)\s+(civil|pénal|commercial)",
    rf"(?:{EDGE}arrêt|{INSIDE}قرار|{INSIDE}حكم)\s+(n°|رقم|عدد)?\s*[0-9]{{1,6}}",
)


def query_kind(question: Column) -> Column:
    """keyword or semantic."""
    hit = F.lit(False)
    for pattern in KEYWORD_QUERIES:
        hit = hit | F.lower(question).rlike(pattern)
    return F.when(hit, "keyword").otherwise("semantic")


def kind_weights(kind: Column) -> tuple[Column, Column]:
    """Of vectors and of words."""
    return F.when(kind == "keyword", 0.4).otherwise(0.7), F.when(kind == "keyword", 0.6).otherwise(0.3)


def expanded(question: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """The question with the synonyms of its words behind it, those it does not have already."""
    words = tokens(question)
    more = F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains(words, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in synonyms.items()])))
    return F.concat_ws(" ", question, F.array_join(F.array_except(more, words), " "))


def merged(sources: Mapping[str, DataFrame], boosts: Mapping[str, float], k: int, repealed: DataFrame | None = None, cap: float = 0.10) -> DataFrame:
    """id, source, score: of each id the best boosted score of all sources (id, score); repealed ids get `cap` at most."""
    every = None
    for name, rows in sources.items():
        one = rows.select("id", F.lit(name).alias("source"), (F.col("score") * boosts.get(name, 1.0)).alias("score"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.max(F.struct("score", "source")).alias("m")).select("id", "m.source", "m.score")
    if repealed is not None:
        best = best.join(repealed.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
        best = best.select("id", "source", F.when(F.col("gone"), F.least("score", F.lit(cap))).otherwise(F.col("score")).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(k)


def in_force(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows (id) that no event repeals, with modified: whether one changes them. events: id, kind, in any number."""
    told = events.groupBy("id").agg(F.max(F.col("kind") == "repealed").alias("gone"), F.max(F.col("kind") == "modified").alias("modified"))
    both = rows.join(told, "id", "left").filter(~F.coalesce("gone", F.lit(False)))
    return both.drop("gone").withColumn("modified", F.coalesce("modified", F.lit(False)))


def relevant(rows: DataFrame, positive: Sequence[str], negative: Sequence[str], confidence: float, least: float = 0.7) -> DataFrame:
    """rows (query_id, id, score, text): those with a positive word, or without a negative one; all below the confidence;
    where a query would lose everything its best row stays."""
    if confidence < least or not positive:
        return rows
    words = tokens("text")
    has = lambda terms: F.arrays_overlap(words, F.array(*map(F.lit, terms))) if terms else F.lit(False)
    told = rows.withColumn("ok", has(positive) | ~has(negative))
    w = Window.partitionBy("query_id")
    placed = told.withColumns({"any": F.max("ok").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "id"))})
    return placed.filter(F.col("ok") | (~F.col("any") & (F.col("place") == 1))).drop("ok", "any", "place")


def graph_boosted(rows: DataFrame, edges: DataFrame, least: float = 0.7, factor: float = 0.3) -> DataFrame:
    """rows (query_id, id, score): ids that an edge (source, target, strength) ties to a query's best row gain by its strength."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = rows.withColumn("place", F.row_number().over(w)).filter("place = 1").select("query_id", F.col("id").alias("top"))
    strong = edges.filter(F.col("strength") >= least)
    both = strong.select("source", "target", "strength").union(strong.select("target", "source", "strength")).groupBy(F.col("source").alias("top"), F.col("target").alias("id")).agg(F.max("strength").alias("strength"))
    tied = best.join(both, "top").select("query_id", "id", "strength")
    return rows.join(tied, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") * (1 + factor * F.coalesce("strength", F.lit(0.0)))).alias("score"))


def _near(asked: DataFrame, cache: DataFrame, least: float, key: str) -> DataFrame:
    """id, key, at: the first cached row in time of the same `key` whose cosine is at the bar. Equal vectors are compared once."""
    rows = asked.filter("v IS NOT NULL").select("id", F.col(key).alias("scope"), "v")
    wanted = saved(rows.groupBy("scope", "v").agg(F.min("id").alias("id")))
    held = saved(cache.filter("v IS NOT NULL").groupBy(F.col(key).alias("scope"), "v").agg(F.min(F.struct("at", "key")).alias("first")).withColumn("id", F.xxhash64("v")))
    best = first_near(wanted, held, least, "scope")
    return rows.join(wanted.join(best, "id").select("scope", "v", "key"), ["scope", "v"]).select("id", "key")


def cached_answers(asked: DataFrame, cache: DataFrame, least: float, partial: float | None = None) -> DataFrame:
    """id, key, how: which cached row (key, text, scope, v, at; for partial hits, domain) serves each asked one (id, text, scope, v; domain).

    In this order: `exact`, the same text in the same scope, the latest; `near`, the first in time of the same scope with a cosine of at least
    `least`; `partial`, the first of the same domain with one of at least `partial`, where that is given; else `none`. Every vector of
    a scope or domain is compared, so no hit is missed; null scopes and domains match nothing.
    """
    exact = saved(asked.join(cache.groupBy("text", "scope").agg(F.max_by("key", F.struct("at", "key")).alias("exact")), ["text", "scope"], "left"))
    near = _near(exact.filter("exact IS NULL AND scope IS NOT NULL"), cache.filter("scope IS NOT NULL"), least, "scope").withColumnRenamed("key", "near")
    told = saved(exact.join(near, "id", "left"))
    if partial is None:
        told = told.withColumn("partial", F.lit(None).cast("string"))
    else:
        rest = told.filter("exact IS NULL AND near IS NULL AND domain IS NOT NULL")
        told = told.join(_near(rest, cache.filter("domain IS NOT NULL"), partial, "domain").withColumnRenamed("key", "partial"), "id", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").when(F.col("partial").isNotNull(), "partial").otherwise("none")
    return told.select("id", F.coalesce("exact", "near", "partial").alias("key"), how.alias("how"))


def gated_pairs(pairs: DataFrame, facts: DataFrame, overlap: float = 0.5) -> DataFrame:
    """pairs (a, b, similarity) of one category and language whose tags overlap enough, unless the first has none. facts: id, category, language, tags."""
    side = lambda n: facts.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("category", "language", "tags")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_category = b_category AND a_language = b_language")
    enough = (F.size(F.coalesce("a_tags", F.array().cast("array<string>"))) == 0) | (tag_overlap(F.col("a_tags"), F.col("b_tags")) >= overlap)
    return both.filter(enough).select("a", "b", "similarity")


def spread_out(rows: DataFrame, k: int, caps: Mapping[str, int]) -> DataFrame:
    """Per query the k best rows of which no value of a column in caps has more than its cap; rows without contradicted ones."""
    kept = rows.filter(~F.coalesce("contradicted", F.lit(False)))
    for column, most in caps.items():
        w = Window.partitionBy("query_id", column).orderBy(F.desc("score"), "id")
        kept = kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
