"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, graph, pages
from tessera.plans.registry import query, quoted
from tessera.sources.tables import table

W = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({W}) AS n_words, len(list_filter({W}, lambda w: length(w) > 1)) AS n_longer, CAST(ceil(length(text) / 4) AS BIGINT) AS n_tokens, CAST(ceil(len({W}) / 200) AS BIGINT) AS minutes FROM documents")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("n_words"), T.word_count("text", 1).alias("n_longer"), T.token_estimate("text").alias("n_tokens"), T.reading_minutes("text").alias("minutes"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.content_hash("text").alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS letters, round(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) / greatest(length(text), 1), 6) AS share FROM documents""")
def letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.letters_of("text", T.LATIN)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("letters"), F.round(n / F.greatest(F.length("text"), F.lit(1)), 6).alias("share"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} \t\n\r]', '', 'g'), '[ \t\n\r]+', ' ', 'g')), 1, 200) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, doc_id) = 1""")
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of each key, by aggregation rather than by sorting each group."""
    docs = table(spark, sf_dir, "documents").select(T.dedup_key("text").alias("key"), "doc_id", F.length("text").alias("n"))
    return docs.groupBy("key").agg(F.min(F.struct(-F.col("n"), "doc_id")).alias("m")).select("m.doc_id", "key")


CORRUPT = r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, 'SPACE+'), lambda v: v <> '') AS w FROM documents), s AS (SELECT doc_id, text, length(text) AS chars, len(w) AS n, len(list_filter(w, lambda v: length(v) <= 2)) / greatest(len(w), 1) AS short,
 len(list_filter(w, lambda v: regexp_full_match(v, '[0-9]{1,3}'))) / greatest(len(w), 1) AS numbers, len(regexp_extract_all(text, 'SINGLE_LETTERS')) AS single, len(regexp_extract_all(text, 'MIXED_LETTERS')) AS mixed, len(regexp_extract_all(text, '[*#$%&!^|\\~<>{}=]')) / greatest(length(text), 1) AS odd FROM d)
 SELECT doc_id, CAST(CASE WHEN chars < 100 THEN 0.0 ELSE round(least(CASE WHEN contains(text, 'GAZETTE') THEN 0.5 ELSE 0.0 END + CASE WHEN n > 50 AND short > 0.65 THEN 0.35 WHEN n > 50 AND short > 0.5 THEN 0.2 ELSE 0.0 END
 + CASE WHEN single > 20 THEN 0.3 WHEN single > 10 THEN 0.15 ELSE 0.0 END + CASE WHEN odd > 0.025 THEN 0.2 WHEN odd > 0.015 THEN 0.1 ELSE 0.0 END + CASE WHEN mixed > 15 THEN 0.25 WHEN mixed > 8 THEN 0.15 ELSE 0.0 END + CASE WHEN n > 50 AND numbers > 0.12 THEN 0.15 ELSE 0.0 END, 1.0), 2) END AS DOUBLE) AS score FROM s"""
for _name in ("SINGLE_LETTERS", "MIXED_LETTERS", "SPACE", "GAZETTE"):
    CORRUPT = CORRUPT.replace(_name, getattr(T, _name))


@query(CORRUPT)
def corruption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.corruption_score("text").alias("score"))


@query(r"""WITH d AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS l FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'block:short' END,
 CASE WHEN length(text) > 500000 THEN 'block:long' END, CASE WHEN len(W) < 20 THEN 'block:words' END, CASE WHEN length(trim(source)) < 5 THEN 'warn:title' END, CASE WHEN len(list_filter(l, lambda s: length(trim(s)) < 4)) / greatest(len(l), 1) > 0.7 THEN 'block:noise' END,
 CASE WHEN regexp_matches(lower(substr(text, 1, 500)), '404 not found|page not found|500 internal server error|access denied') THEN 'block:error' END,
 CASE WHEN length(text) < 500 AND regexp_matches(lower(substr(text, 1, 500)), 'log in|sign in|password') THEN 'block:login' END], lambda x: x IS NOT NULL), ',') AS failures FROM d""".replace("len(W)", f"len({W})"))
def inclusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pages.inclusion_failures(F.col("source"), F.col("text")), ",").alias("failures"))


@query(f"""WITH c AS (SELECT unnest({TOKENS}) AS word, doc_id FROM documents), t AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE length(word) > 3 GROUP BY 1) SELECT * FROM t ORDER BY n DESC, word LIMIT 20""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("word")).filter(F.length("word") > 3)
    by = each.groupBy("word", "doc_id").agg(F.count("*").alias("m")).groupBy("word").agg(F.sum("m").alias("n"), F.count("*").alias("docs"))
    return by.orderBy(F.desc("n"), "word").limit(20)


@query(r"SELECT doc_id, regexp_replace(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), '^(.)[^@]*(@.*)$', '\1***\2') AS masked FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')")
def masked_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0)
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", address.alias("a")).filter("a <> ''").select("doc_id", T.mask_email("a").alias("masked"))


PHONE = r"\+[0-9][0-9 ().-]{6,}[0-9]"


@query(f"""WITH p AS (SELECT doc_id, sha256(text) AS h, nullif(regexp_extract(text, {quoted(PHONE)}, 0), '') AS p FROM documents)
 SELECT doc_id, coalesce(substr(h, 1, 12), '') || '***' AS hash, CASE WHEN length(p) >= 8 THEN substr(p, 1, 4) || '***' || substr(p, length(p) - 3) ELSE '***' END AS phone FROM p""")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and first telephone numbers of all texts as logs may show them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.nullif(F.regexp_extract("text", PHONE, 0), F.lit("")).alias("p"))
    return docs.select("doc_id", T.mask_hash("h").alias("hash"), T.mask_phone("p").alias("phone"))


@query(r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_(?:source|medium|campaign)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?&]+$', '')) AS hash, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_hash("url").alias("hash"), T.host_of("url").alias("host"), T.path_of("url").alias("path"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*\slang\s*=\s*["'']?([A-Za-z-]+)', 1)) AS lang, length(html) AS n_chars FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.title_of(F.col("html")).alias("title"), pages.html_language(F.col("html")).alias("lang"), F.length("html").cast("long").alias("n_chars"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links_of(table(spark, sf_dir, "pages"))


SCRIPTS = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript"))


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|{SCRIPTS}', ' ', 'g'), '(?i)</?(p|div|br|li|tr|h[1-6]|table|section|article|ul|ol)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages),
 b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a) SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ') AS text FROM b""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("""WITH p AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, list_distinct(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '' AND NOT regexp_full_match(s, '[0-9]+'))) AS seg FROM pages),
 t AS (SELECT host, count(*) AS pages FROM p GROUP BY 1), c AS (SELECT host, segment, count(*) AS n FROM (SELECT host, unnest(seg) AS segment FROM p) GROUP BY ALL) SELECT host, segment, n, pages FROM c JOIN t USING (host) WHERE n >= 0.7 * pages""")
def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.mined_segments(table(spark, sf_dir, "pages"))


RULES = [
    {"name": "mobile", "category": "mobile", "conditions": [("url_contains", "://m.", False)], "boost": 0.1},
    {"name": "tracked", "category": "campaign", "conditions": [("url_contains", "utm_", False), ("url_contains", "ref=", True)], "boost": 0.3},
    {"name": "deep", "category": "detail", "conditions": [("url_pattern", "/[0-9]+", False), ("url_starts_with", "http", False)]},
    {"name": "headed", "category": "article", "conditions": [("heading_contains", "the", False), ("title_pattern", "[a-z]", False), ("url_ends_with", ".pdf", True)], "boost": 0.05},
    {"name": "crumbed", "category": "section", "conditions": [("breadcrumb_level", "p", False), ("breadcrumb_contains", "p", False), ("domain_match", "nowhere.org", True)]},
]


@query(r"""WITH p AS (SELECT url, lower(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda h: h <> ''), chr(10))) AS headings, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title,
 list_filter(list_transform(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: trim(regexp_replace(regexp_replace(s, '\.[A-Za-z0-9]+$', ''), '[-_+]+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_full_match(s, '[0-9 ]+')) AS crumbs, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages)
 SELECT url, 'mobile' AS rule, 'mobile' AS category, 1.0::DOUBLE AS confidence FROM p WHERE contains(lower(url), '://m.') UNION ALL SELECT url, 'tracked', 'campaign', 0.8 FROM p WHERE contains(lower(url), 'utm_') AND NOT contains(lower(url), 'ref=')
 UNION ALL SELECT url, 'deep', 'detail', 1.0 FROM p WHERE regexp_matches(url, '/[0-9]+') AND starts_with(lower(url), 'http')
 UNION ALL SELECT url, 'headed', 'article', round(2 / 3 + 0.05, 6) FROM p WHERE contains(headings, 'the') AND regexp_matches(title, '[a-z]') AND NOT ends_with(lower(url), '.pdf')
 UNION ALL SELECT url, 'crumbed', 'section', round(2 / 3, 6) FROM p WHERE crumbs[1] = 'p' AND contains(lower(array_to_string(crumbs, chr(10))), 'p') AND NOT (host = 'nowhere.org' OR ends_with(host, '.nowhere.org'))""")
def classified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    told = table(spark, sf_dir, "pages").select("url", pages.title_of(html).alias("title"), F.array_join(pages.headings(html), "\n").alias("headings"), pages.crumbs_of("url").alias("crumbs"))
    return pages.apply_rules(told, RULES).withColumn("confidence", F.round("confidence", 6).cast("double"))


@query("""WITH v AS (SELECT doc_id AS key, lang AS choice, 1.0 AS weight FROM documents UNION ALL SELECT doc_id, source, 0.6 FROM documents UNION ALL SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'en' ELSE 'fr' END, 0.5 FROM documents),
 s AS (SELECT key, choice, sum(weight) AS w FROM v GROUP BY ALL) SELECT key, first(choice ORDER BY w DESC, choice) AS choice, CAST(round(max(w) / sum(w), 6) AS DOUBLE) AS share FROM s GROUP BY 1""")
def fused_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vote = lambda choice, weight: docs.select(F.col("doc_id").alias("key"), choice.alias("choice"), F.lit(weight).alias("weight"))
    votes = vote(F.col("lang"), 1.0).unionByName(vote(F.col("source"), 0.6)).unionByName(vote(F.when(F.length("text") > 1000, "en").otherwise("fr"), 0.5))
    return pages.fused_votes(votes).withColumn("share", F.round("share", 6))


@query("""WITH o AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM documents), l AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(coalesce(old, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS a, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS b FROM o WHERE old IS NOT NULL)
 SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS changed FROM l""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text's lines differs from the text before it of its source. Ids are numbered over all rows, so that no source is one task; texts meet by id."""
    docs = table(spark, sf_dir, "documents")
    own = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    ids = graph.numbered(docs.select(own.alias("source"), "doc_id"), ["source", "doc_id"])
    pairs = ids.join(ids.select("source", (F.col("place") + 1).alias("place"), F.col("doc_id").alias("old_id")), ["source", "place"]).select("doc_id", "old_id")
    old = docs.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old")).filter("old IS NOT NULL")
    versions = pairs.join(docs.select("doc_id", "text"), "doc_id").join(old, "old_id")
    return versions.select("doc_id", F.round(pages.change_share(F.col("old"), F.col("text")), 6).alias("changed"))


@query(f"""WITH d AS (SELECT doc_id, {W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(floor((len(w) - 1) / 160) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0) SELECT doc_id, CAST(i AS INTEGER) AS chunk, len(list_slice(w, i * 160 + 1, i * 160 + 200)) AS n_words, md5(array_to_string(list_slice(w, i * 160 + 1, i * 160 + 200), ' ')) AS digest FROM c""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.word_windows(table(spark, sf_dir, "documents"), 200, 40)
    return made.select("doc_id", "chunk", "n_words", F.md5("content").alias("digest"))


@query(rf"""WITH d AS (SELECT doc_id, {W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(floor((len(w) - 1) / 45) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0), k AS (SELECT doc_id, i, len(list_slice(w, i * 45 + 1, i * 45 + 50)) AS n, array_to_string(list_slice(w, i * 45 + 1, i * 45 + 50), ' ') AS t, i = max(i) OVER (PARTITION BY doc_id) AS last FROM c)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk, n AS n_words, md5(t) AS digest FROM k WHERE (n >= 40 OR last) AND NOT regexp_full_match(t, '[\s|─═*-]+')""")
def chunk_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.kept_chunks(chunking.word_windows(table(spark, sf_dir, "documents"), 50, 5))
    return made.select("doc_id", "chunk", "n_words", F.md5("content").alias("digest"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed_chunks(table(spark, sf_dir, "documents"), "sentences", 120)


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed_chunks(table(spark, sf_dir, "documents"), "paragraphs", 200)


@query("""WITH c AS (SELECT source, length(text) AS n FROM documents) SELECT source, count(*) AS docs, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS spread, min(n) AS least, max(n) AS most, count(*) FILTER (WHERE n < 100) AS short FROM c GROUP BY 1""")
def chunk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_samp(n), 4).alias("spread"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n < 100).alias("short"))


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def orphan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT lang, count(*) AS docs, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, round(100.0 * count(quality) / count(*), 4) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.round(100.0 * F.count("quality") / F.count("*"), 4).alias("coverage"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {TOKENS} AS w FROM conversations) SELECT conv_id, turn FROM t WHERE role = 'user' AND (list_has_all(w, ['the', 'of']) OR text ILIKE '%tion%')""")
def chat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.size(F.array_except(F.array(F.lit("the"), F.lit("of")), T.tokens("text"))) == 0
    return table(spark, sf_dir, "conversations").filter("role = 'user'").filter(every | F.contains(F.lower("text"), F.lit("tion"))).select("conv_id", "turn")


@query("""WITH t AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM conversations GROUP BY 1) SELECT *, round(tokens * 0.000002, 8) AS cost FROM t""")
def conversation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(T.token_estimate("text")).alias("tokens"))
    return by.withColumn("cost", F.round(F.col("tokens") * 0.000002, 8))


@query("""WITH c AS (SELECT DISTINCT conv_id, CAST(('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM conversations) SELECT CASE WHEN u < 0.5 THEN 'control' WHEN u < 0.8 THEN 'a' ELSE 'b' END AS variant, count(*) AS n FROM c GROUP BY 1""")
def ab_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.graph import hash_bucket

    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.groupBy(hash_bucket(F.col("conv_id"), {"control": 0.5, "a": 0.3, "b": 0.2}).alias("variant")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3))))) AS g FROM part), q AS (SELECT lower(p_name) AS name, g FROM p ORDER BY p_partkey LIMIT 1),
 s AS (SELECT p_partkey, lower(p_name) = name AS exact, contains(lower(p_name), left(name, 6)) AS inside, len(list_intersect(p.g, q.g)) / len(list_distinct(list_concat(p.g, q.g))) AS s FROM p, q) SELECT p_partkey, exact, round(s, 6) AS similarity FROM s WHERE inside OR s >= 0.6 ORDER BY exact DESC, s DESC, p_partkey LIMIT 50""")
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold what is asked (here the first six letters of a name) or have at least 0.6 of its trigrams; equal ones first, then by similarity. The best 50."""
    part = table(spark, sf_dir, "part")
    # One row.
    asked = part.orderBy("p_partkey").limit(1).select(F.lower("p_name").alias("name"), T.trigrams("p_name").alias("asked"))
    told = part.select("p_partkey", F.lower("p_name").alias("mine"), T.trigrams("p_name").alias("g")).crossJoin(F.broadcast(asked))
    scored = told.select("p_partkey", (F.col("mine") == F.col("name")).alias("exact"), F.contains("mine", F.left("name", F.lit(6))).alias("inside"), T.set_similarity(F.col("g"), F.col("asked")).alias("s"))
    found = scored.filter("inside or s >= 0.6").orderBy(F.desc("exact"), F.desc("s"), "p_partkey").limit(50)
    return found.select("p_partkey", "exact", F.round("s", 6).alias("similarity"))
