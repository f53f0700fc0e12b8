"""References inside texts: numbered articles, laws and dates; what repeals or amends what; precedents and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLE = r"(?i)(?:article|art\.|section)\s+([0-9]{1,4}(?:\s*(?:bis|ter))?)"
LAW = r"(?i)(?:law|loi|decree|d[ée]cret|act)\s+(?:no?\.?\s*|n°\s*)?([0-9]{2,4}[-/][0-9]{1,5})"
REPEAL = r"(?i)\b(?:repeal(?:s|ed)?|abrog\w+|is no longer in force)\b"
AMEND = r"(?i)\b(?:amend(?:s|ed|ment)?|modif\w+|replaces?|is replaced by)\b"
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "premier": 1, "première": 1, "deuxième": 2, "troisième": 3, "quatrième": 4, "cinquième": 5}


def cited(docs: DataFrame) -> DataFrame:
    """doc_id, kind, number, n of the articles and laws that each text names."""
    article = docs.select("doc_id", F.lit("article").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(ARTICLE), 1)).alias("number"))
    law = docs.select("doc_id", F.lit("law").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(LAW), 1)).alias("number"))
    return article.unionByName(law).groupBy("doc_id", "kind", F.regexp_replace("number", r"\s+", " ").alias("number")).agg(F.count("*").alias("n"))


def changed_laws(docs: DataFrame) -> DataFrame:
    """doc_id, number, effect of the laws in sentences that repeal or amend; repeal wins in a sentence with both."""
    told = docs.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s")).filter(F.col("s").rlike(REPEAL) | F.col("s").rlike(AMEND))
    effect = F.when(F.col("s").rlike(REPEAL), "repealed").otherwise("amended")
    return told.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(LAW), 1))).alias("number"), effect.alias("effect")).distinct()


def articles_numbered(text: Column) -> Column:
    """Article ordinals written as digits."""
    for word, n in ORDINALS.items():
        text = F.regexp_replace(text, rf"(?i)\b(article)\s+{word}\b", f"$1 {n}")
    return text


def without_boilerplate(text: Column) -> Column:
    """Page numbers, dot leaders and rules of a printed page go."""
    x = F.regexp_replace(text, r"(?im)^[ \t]*(?:page[ \t]+)?[-–]?[ \t]*[0-9]{1,4}[ \t]*(?:(?:/|of)[ \t]*[0-9]{1,4})?[ \t]*[-–]?[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(x, r"\.{4,}[ \t]*[0-9]*", " "), r"(?m)^[ \t]*[-_=*]{4,}[ \t]*$", "")


def valid_date(x: Column, first: int = 1800, last: int = 2100) -> Column:
    day = F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "dd/MM/yyyy"), F.try_to_date(x, "dd-MM-yyyy"))
    return F.coalesce(F.year(day).between(first, last), F.lit(False))


def valid_number(x: Column, kind: str) -> Column:
    patterns = {"law": r"^[0-9]{2,4}[-/][0-9]{1,5}$", "decision": r"^[0-9]{1,6}([-/][0-9]{2,4})?$", "gazette": r"^(no?\.?\s*)?[0-9]{1,3}([-/][0-9]{4})?$"}
    return F.coalesce(F.trim(x).rlike("(?i)" + patterns[kind]), F.lit(False))


def precedents(edges: DataFrame, k: int) -> DataFrame:
    """node, cited_by, overruled of the k most cited nodes; edges: source, target, kind, validated."""
    sure = edges.filter("validated")
    by = sure.groupBy(F.col("target").alias("node")).agg(F.count_if(F.col("kind") == "cites").alias("cited_by"), F.max(F.col("kind") == "overrules").alias("overruled"))
    return by.orderBy(F.desc("cited_by"), "node").limit(k)


def timeline(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """node, day, event, cited_by of decisions (node, day) in order of days: the strongest thing an edge from them does."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.max(F.col("kind") == "overrules").alias("o"), F.max(F.col("kind") == "confirms").alias("c"), F.max(F.col("kind") == "distinguishes").alias("d"))
    into = edges.filter("kind = 'cites'").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("cited_by"))
    event = F.when(F.col("o"), "overruling").when(F.col("c"), "confirmation").when(F.col("d"), "distinction").when(F.col("cited_by") >= 5, "landmark").otherwise("standard")
    both = decisions.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["cited_by"])
    return both.select("node", "day", event.alias("event"), "cited_by")
