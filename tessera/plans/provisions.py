"""Queries of legal texts: ordinals, references, statements of repeal, status."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, legal
from tessera.plans.registry import query, quoted
from tessera.sources.tables import table


def sql_pattern(pattern: str) -> str:
    return quoted("(?i)" + legal.spaced(pattern))


def sql_group(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(text, {sql_pattern(pattern)}, {group}), '')" if re.compile(pattern).groups >= group else "NULL"


def status_sql() -> str:
    ways = [(status, confidence, p) for status, confidence, patterns in legal.STATUSES for p in patterns]

    def cases(value) -> str:
        return "CASE WHEN text IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(text, {sql_pattern(p)}) THEN {value(s, c, p)}" for s, c, p in ways) + " END"

    day = cases(lambda s, c, p: sql_group(p, 2))
    return f"""WITH f AS (SELECT doc_id, text, {cases(lambda s, c, p: f"'{s}'")} AS status, {cases(lambda s, c, p: c)} AS confidence, {cases(lambda s, c, p: f"regexp_extract(text, {sql_pattern(p)}, 0)")} AS told,
 {cases(lambda s, c, p: sql_group(p, 1))} AS "by", string_split_regex({day}, '[/-]') AS d FROM documents)
 SELECT doc_id, coalesce(status, CASE WHEN text IS NULL THEN 'unknown' ELSE 'active' END) AS status, CAST(coalesce(confidence, CASE WHEN text IS NULL THEN 0 ELSE 0.3 END) AS DOUBLE) AS confidence, told, "by", d[3] || '-' || lpad(d[2], 2, '0') || '-' || lpad(d[1], 2, '0') AS day FROM f"""


def places_sql(patterns: tuple, names: tuple[str, ...]) -> str:
    """All matches of patterns as doc_id, names, position, told, by, context, before: what lies between two matches is matched with the second."""
    parts = []
    for *called, pattern, before in patterns:
        whole = quoted(f"(?is)(.*?)({legal.spaced(pattern)})")
        by = f"regexp_extract(m[i], {sql_pattern(pattern)}, 1)" if re.compile(pattern).groups else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"""SELECT doc_id, {"".join(f"'{c}' AS {n}, " for c, n in zip(called, names, strict=True))}p AS position, m[i] AS told, {by} AS "by", substr(text, greatest(p - {legal.CONTEXT}, 0) + 1, least(p, {legal.CONTEXT}) + length(m[i]) + {legal.CONTEXT}) AS context
 FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS p
 FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {whole}, 1) AS g, regexp_extract_all(text, {whole}, 2) AS m FROM documents)))"""
            + (f" WHERE regexp_matches(substr(text, greatest(p - {legal.CONTEXT}, 0) + 1, least(p, {legal.CONTEXT})), {sql_pattern(before)})" if before else "")
        )
    return " UNION ALL ".join(parts)


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{legal.SIGNS}', '', 'g'), '{legal.BLANK}+', ' ', 'g'))"


REFERENCES = f"SELECT doc_id, kind, language, position, told AS reference, {key_sql('told')} AS key FROM ({places_sql(legal.REFERENCES, ('kind', 'language'))})"
STATEMENTS = places_sql(tuple((*x, None) for x in legal.STATEMENTS), ("language",))
REPEALED = f"""WITH refs AS ({REFERENCES}), says AS ({STATEMENTS}), e AS (SELECT doc_id, position, reference, {{'e': position + length(reference), 'reference': reference}} AS r, NULL AS "by", 0 AS s FROM refs
 UNION ALL SELECT doc_id, position, '', NULL, trim("by"), 1 FROM says), l AS (SELECT doc_id, position, "by", s, last_value(r IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position, s, reference) AS r FROM e),
 t AS (SELECT r.reference AS reference, "by", CASE WHEN "by" IS NULL THEN 'implicit' ELSE 'total' END AS scope FROM l WHERE s = 1 AND position - r.e BETWEEN 0 AND {legal.CONTEXT}),
 n AS (SELECT {key_sql("reference")} AS key, "by", scope FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY "by" NULLS FIRST, scope) = 1)
 SELECT doc_id, position, reference, "by", scope, CASE scope WHEN 'total' THEN 'high' WHEN 'implicit' THEN 'low' ELSE 'medium' END AS severity FROM refs JOIN n USING (key)"""


def normalized_sql() -> str:
    x = "text"
    for pattern, by in (
        (r"(?i)(?:^|\n)\s*(?:Journal Officiel de la R[ée]publique Tunisienne|الرائد الرسمي للجمهورية التونسية)[^\n]*", "\n"),
        (r"(?:^|\n)\s*(?:[-–—]\s*)?[0-9]{1,4}\s*(?:[-–—]\s*)?(?:\n|\z)", "\n"),
        (r"(?i)(?:^|\n)\s*(?:page\s+[0-9]+\s*(?:sur|/|de)\s*[0-9]+|صفحة\s+[0-9]+)[^\n]*", "\n"),
        (r"\.{5,}\s*[0-9]*", ""),
        (r"(?:^|\n)\s*[-=_]{3,}\s*(?:\n|\z)", "\n"),
        (r"\n{4,}", "\n\n\n"),
        (r"\A\s+|\s+\z", ""),
        (r"(?i)(^|[^\p{L}\p{N}_])art\.?\s+([0-9]+(?:\s*[-–]\s*[0-9]+)?(?:\s+(?:bis|ter|quater|quinquies|sexies))?)", r"\1Article \2"),
        (r"(^ل?|[^ا]ل|[^ل])فصل\s+([0-9]+(?:\s+مكرر)?)", r"\1الفصل \2"),
    ):
        x = f"regexp_replace({x}, {quoted(legal.spaced(pattern))}, {quoted(by)}, 'g')"
    for word, n in sorted(legal.ordinals().items(), key=lambda w: -len(w[0])):
        for _ in range(2):  # a sign between two ordinals is the end of one and the beginning of the next
            pattern = rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_]){word.replace(' ', legal.BLANK + '+')}($|[^\p{{L}}\p{{M}}\p{{N}}_])"
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(rf'\1{n}\2')}, 'g')"
    return f"SELECT doc_id, sha256(x) AS hash, x <> text AS changed FROM (SELECT doc_id, text, {x} AS x FROM documents)"


@query(status_sql())
def legal_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", legal.legal_status(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(REFERENCES)
def legal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal.legal_references(table(spark, sf_dir, "documents"))


@query(STATEMENTS)
def repeal_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal.repeal_statements(table(spark, sf_dir, "documents"))


@query(REPEALED)
def repealed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all texts to what any text says is repealed."""
    docs = table(spark, sf_dir, "documents")
    # Texts are searched for references once; few rows come of it.
    references = graph.saved(legal.legal_references(docs))
    return legal.repealed_references(references, legal.repeals_told(docs, references))


@query(normalized_sql())
def normalized_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without marks of the printed page, with article numbers of one form and ordinals as digits."""
    x = legal.ordinals_as_digits(legal.article_numbers(legal.without_gazette(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", "text", x.alias("x")).select("doc_id", F.sha2("x", 256).alias("hash"), (F.col("x") != F.col("text")).alias("changed"))
