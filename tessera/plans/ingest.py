"""Queries over ingestion, gates and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, pages, references, retrieval, selection
from tessera.operators.containment import containing
from tessera.plans.registry import query, quoted
from tessera.sources.tables import table

PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(lower({PATH}), '/(news|actualites?|articles?|blog)(/|$)') THEN 'news' WHEN regexp_matches(lower({PATH}), '/(laws?|lois?|codes?|legislation)(/|$)') THEN 'law' WHEN regexp_matches(lower({PATH}), '/(jurisprudence|decisions?|cases?)(/|$)') THEN 'decisions'
 WHEN regexp_matches(lower({PATH}), '/(forms?|formulaires?|modeles?)(/|$)') THEN 'forms' ELSE 'other' END AS category FROM pages""")
def url_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.url_category(F.col("url")).alias("category"))


@query(rf"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({PATH}, '/'), lambda s: trim(regexp_replace(regexp_replace(s, '\.[A-Za-z0-9]+$', ''), '[-_+]+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_full_match(s, '[0-9 ]+')), ' > ') AS crumbs FROM pages""")
def page_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.breadcrumbs(table(spark, sf_dir, "pages")).select("page_id", F.array_join("crumbs", " > ").alias("crumbs"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS n_headings, len(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1)) AS n_tables FROM pages""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)).alias("n_headings"), F.size(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("n_tables"))


CELLS = r"list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: replace(trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), '|', '\|'))"


@query(rf"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1), lambda t: list_filter(list_transform(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: {CELLS}), lambda r: len(r) > 0)), lambda t: len(t) > 0) AS tables FROM pages),
 u AS (SELECT page_id, unnest(tables) AS c, unnest(range(0, len(tables))) AS n FROM t), w AS (SELECT *, list_max(list_transform(c, lambda r: len(r))) AS width FROM u), l AS (SELECT *, list_transform(c, lambda r: '| ' || array_to_string(list_resize(r, width, ''), ' | ') || ' |') AS l FROM w)
 SELECT page_id, CAST(n AS INTEGER) AS n, '[TABLE]' || chr(10) || l[1] || chr(10) || '|' || repeat(' --- |', width) || chr(10) || array_to_string(l[2:], chr(10)) || chr(10) || '[/TABLE]' AS markdown FROM l""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(pages.markdown_tables(F.col("html"))).alias("n", "markdown"))
    return found


DOMAINS = {"connectives": {"and": 1.0, "with": 2.0}, "articles": {"the": 1.0, "der": 1.0, "la": 1.0}}


@query(f"""WITH d AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, greatest(len(w), 1) AS n, len(list_filter(w, lambda x: x = 'and')) * 1.0 + len(list_filter(w, lambda x: x = 'with')) * 2.0 AS c, len(list_filter(w, lambda x: x IN ('the', 'der', 'la'))) * 1.0 AS a, len(list_filter(w, lambda x: x IN ('and', 'with', 'the', 'der', 'la'))) AS hits FROM d)
 SELECT doc_id, CASE WHEN c >= a THEN 'connectives' ELSE 'articles' END AS domain, CAST(round(least(greatest(c, a) / (c + a), 0.95), 6) AS DOUBLE) AS share, round(hits / n, 6) AS density, hits / n > 0.02 AS dense FROM s WHERE greatest(c, a) > 0""")
def text_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.keyword_domains(table(spark, sf_dir, "documents"), DOMAINS)
    return found.select("doc_id", "domain", F.round("share", 6).alias("share"), F.round("density", 6).alias("density"), "dense")


@query(f"""SELECT conv_id, turn, CASE WHEN {" OR ".join(f"regexp_matches(lower(text), {quoted(p)})" for p in selection.KEYWORD_QUERIES)} THEN 'keyword' ELSE 'semantic' END AS kind FROM conversations WHERE role = 'user'""")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", selection.query_kind(F.col("text")).alias("kind"))


@query(rf"""WITH f AS (SELECT doc_id, 'article' AS kind, unnest(regexp_extract_all(text, {quoted(references.ARTICLE)}, 1)) AS number FROM documents UNION ALL SELECT doc_id, 'law', unnest(regexp_extract_all(text, {quoted(references.LAW)}, 1)) FROM documents) SELECT doc_id, kind, regexp_replace(number, '\s+', ' ', 'g') AS number, count(*) AS n FROM f GROUP BY ALL""")
def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.cited(table(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT d.doc_id, length(text) AS chars, coalesce(quality, 0) AS q, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT CASE WHEN chars < 100 THEN 'crawled' WHEN q < 0.5 THEN 'extracted' WHEN chars < 500 THEN 'accepted' WHEN coalesce(toxic, 1) = 1 THEN 'indexed' ELSE 'published' END AS stage FROM s) SELECT stage, count(*) AS n FROM g GROUP BY 1""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    chunks = F.when(F.col("chars") < 500, 0).otherwise(1)
    stage = pages.crawl_stage(F.col("chars"), F.coalesce("quality", F.lit(0)), chunks, chunks, F.coalesce("toxic", F.lit(1)) == 0)
    return joined.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT vec_id AS id, 'v' AS source, (vec_id % 97) / 97.0 AS score FROM embeddings), b AS (SELECT doc_id AS id, 'd' AS source, 1.2 * (doc_id % 89) / 89.0 AS score FROM documents), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT id, max(score) AS s, arg_max(source, score) AS source FROM u GROUP BY 1)
 SELECT id, source, CAST(round(CASE WHEN toxic = 1 THEN least(s, 0.1) ELSE s END, 6) AS DOUBLE) AS score FROM m LEFT JOIN labels ON id = doc_id ORDER BY score DESC, id LIMIT 30""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 97) / 97.0).alias("score"))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 89) / 89.0).alias("score"))
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return selection.merged({"v": a, "d": b}, {"d": 1.2}, 30, gone).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT CAST(source AS VARCHAR) AS query_id, doc_id AS id, length(text) AS score, lang FROM documents), c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) <= 2) SELECT query_id, id, lang FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.length("text").alias("score"), "lang", F.lit(False).alias("contradicted"))
    return selection.spread_out(rows, 5, {"lang": 2}).select("query_id", "id", "lang")


@query("""WITH l AS (SELECT b.item_id, lower(trim(b.text)) AS t FROM benchmark b) SELECT item_id, doc_id FROM l JOIN documents d ON contains(lower(d.text), t) WHERE t <> ''""")
def supported_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a text holds as they stand."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.lower(F.trim("text")).alias("needle"))
    found = containing(claims, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")))
    return found.select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"))


@query("""WITH c AS (SELECT role, count(*) AS n, count(*) FILTER (WHERE length(text) < 50) AS short, list_sort(list(DISTINCT turn)) AS turns FROM conversations GROUP BY 1) SELECT role, n, short, array_to_string(turns[1:5], ',') AS turns, round(100.0 * short / n, 4) AS share FROM c""")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 50).alias("short"), F.array_sort(F.collect_set("turn")).alias("t"))
    return by.select("role", "n", "short", F.array_join(F.transform(F.slice("t", 1, 5), lambda x: x.cast("string")), ",").alias("turns"), F.round(100.0 * F.col("short") / F.col("n"), 4).alias("share"))


@query("""WITH q AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, length(answer) AS n FROM q WHERE role = 'user' AND next = 'assistant' AND length(answer) >= 100""")
def silver_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answer right behind them, one row each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next"))
    return told.filter("role = 'user' AND next = 'assistant'").select("conv_id", "turn", F.length("answer").alias("n")).filter("n >= 100")


@query("""SELECT c_nationkey, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, round(sum(t), 2) AS total FROM customer JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def case_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums before the join, so that none is multiplied by it."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query()
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed_chunks(table(spark, sf_dir, "documents"), "headings", 300)


@query(f"""WITH t AS (SELECT doc_id, len(list_filter({W}, lambda x: x = 'the')) AS tf, length(text) AS n FROM documents), m AS (SELECT avg(n) AS mean FROM t) SELECT doc_id, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM t, m WHERE tf > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def saturated_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts saturated against the length in characters, without inverse frequencies."""
    told = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(text.tokens("text"), retrieval.is_word("the"))).alias("tf"), F.length("text").alias("n"))
    mean = told.agg(F.avg("n")).first()[0] or 1.0
    return told.filter("tf > 0").select("doc_id", F.round(F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / mean)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query(r"""SELECT doc_id, coalesce(length(text) > 0 AND length(regexp_replace(p, '[^\p{L}\s]', '', 'g')) / length(p) < 0.6, false) AS garbled FROM (SELECT doc_id, text, substr(text, 1, 500) || substr(text, greatest(CAST(floor(length(text) / 2) AS INTEGER), 1), 500) || right(text, 500) AS p FROM documents)""")
def garbled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pages.garbled(F.col("text"), 0.6).alias("garbled"))


@query(r"""WITH p AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), m AS (SELECT host, min(path) AS a, max(path) AS b FROM p GROUP BY 1),
 s AS (SELECT host, left(a, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))) AS prefix FROM m) SELECT host, prefix FROM s WHERE length(prefix) >= 2""")
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.mined_affix(table(spark, sf_dir, "pages"), 2)


def meta_sql(name: str) -> str:
    content = r"""content\s*=\s*["']([^"'>]*)["']"""
    named = rf"""(?:name|property)\s*=\s*["']{name}["']"""
    first, second = (f"nullif(regexp_extract(html, {quoted(p)}, 1), '')" for p in (rf"(?is)<meta[^>]*?{named}[^>]*?{content}", rf"(?is)<meta[^>]*?{content}[^>]*?{named}"))
    return f"nullif(trim(coalesce({first}, {second}), ' '), '')"


STRUCTURED = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
TIMES = r"""(?i)<time[^>]*\sdatetime\s*=\s*["']([^"']+)"""


@query(rf"""WITH s AS (SELECT *, coalesce({meta_sql("article:published_time")}, {meta_sql("date")}, nullif(regexp_extract(html, '"datePublished"\s*:\s*"([^"]+)"', 1), ''), nullif(regexp_extract(html, {quoted(TIMES)}, 1), '')) AS said FROM pages)
 SELECT page_id, CAST(try_strptime(CASE WHEN regexp_full_match(left(said, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left(said, 10) END, '%Y-%m-%d') AS DATE) AS published, {meta_sql("description")} AS description, CAST(len(regexp_extract_all(html, {quoted(STRUCTURED)}, 1)) AS INTEGER) AS n_blocks FROM s""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.published_on(html).alias("published"), pages.meta_of(html, "description").alias("description"), F.size(pages.structured_data(html)).alias("n_blocks"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, round(avg(n), 4) AS mean, max(n) AS largest, min(n) AS smallest, count(*) FILTER (WHERE n < 45) AS small FROM c""")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count_if(F.col("n") < 45).alias("small"))


@query("""SELECT count(*) AS documents, count(vec_id) AS embedded, round(100.0 * count(vec_id) / count(*), 4) AS coverage, count(*) FILTER (WHERE quality IS NOT NULL AND vec_id IS NOT NULL) AS both_known FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(F.count("*").alias("documents"), F.count("v").alias("embedded"), F.round(100.0 * F.count("v") / F.count("*"), 4).alias("coverage"), F.count_if(F.col("v") & F.col("quality").isNotNull()).alias("both_known"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type LIKE '_iew') AS views, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS watched, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') > 0""")
def security_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind.like("_iew")).alias("views"), F.count_if(kind.isin("error", "signup")).alias("watched"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(kind == "error").alias("errors"))
    return by.filter("errors > 0").drop("errors")


@query(r"""WITH m AS (SELECT doc_id, text, 0.75::DOUBLE AS similarity FROM documents WHERE length(text) > 100 AND regexp_matches(lower(strip_accents(text)), '(^|[^a-z])the[^a-z]+and([^a-z]|$)')) SELECT doc_id, similarity FROM m ORDER BY doc_id LIMIT 15""")
def article_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a phrase whatever its accents and case, long enough to say something."""
    plain = F.translate(F.lower("text"), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    hit = table(spark, sf_dir, "documents").filter(F.length("text") > 100).filter(plain.rlike(r"(^|[^a-z])the[^a-z]+and([^a-z]|$)"))
    return hit.select("doc_id", F.lit(0.75).alias("similarity")).orderBy("doc_id").limit(15)
