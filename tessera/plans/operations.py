"""Running a corpus: jobs, throughput, quotas, quality, duplicates, thresholds, chunks by kind, and calculators with amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import finance
from tessera.operators import pages, routing
from tessera.operators.filters import any_between, any_object, holds_all, where_all
from tessera.operators.graph import subtree
from tessera.plans.registry import query
from tessera.sources.tables import deleted, table

#: Stands for "now", so that results do not depend on the day.
NOW = "2024-01-15 00:00:00"
END = "2001-12-31"


def at(moment: str) -> F.Column:
    return F.lit(moment).cast("timestamp")


def seconds_ago(ts: str) -> F.Column:
    return (F.unix_micros(at(NOW)) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000


# Jobs ---------------------------------------------------------------------------

RUNS = f"""r AS (SELECT 'job' || CAST(user_id % 20 AS VARCHAR) AS job, event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status, CAST(round(value * 1000) AS BIGINT) AS ms FROM events WHERE ts < TIMESTAMP '{NOW}')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("completed")
    past = table(spark, sf_dir, "events").filter(F.col("ts") < at(NOW))
    return past.select(F.concat(F.lit("job"), (F.col("user_id") % 20).cast("string")).alias("job"), "event_id", "user_id", "ts", status.alias("status"), F.round(F.col("value") * 1000).cast("long").alias("ms"))


@query(f"""WITH {RUNS}, s AS (SELECT job, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running,
 round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*), 2) AS success, CAST(floor(sum(ms) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status = 'completed') + 0.5) AS BIGINT) AS mean_ms, max(ms) FILTER (WHERE status = 'completed') AS longest_ms, max(ts) AS last FROM r WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR GROUP BY 1),
 c AS (SELECT job, CASE WHEN arg_max(status, (ts, event_id)) = 'failed' THEN 1 ELSE 0 END AS failing FROM r WHERE status <> 'running' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1) SELECT s.*, coalesce(failing, 0) AS failing FROM s LEFT JOIN c USING (job)""")
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the last 72 hours by job; failing is 1 where the last finished run of seven days failed. One scan, one shuffle of partial sums."""
    told = runs(spark, sf_dir).filter(F.col("ts") >= at(NOW) - F.expr("INTERVAL 7 DAYS"))
    recent = F.col("ts") >= at(NOW) - F.expr("INTERVAL 72 HOURS")
    of = lambda s: recent & (F.col("status") == s)
    done, last = F.count_if(of("completed")), F.max(F.when(F.col("status") != "running", F.struct("ts", "event_id", "status")))
    by = told.groupBy("job").agg(
        F.count_if(recent).alias("runs"), done.alias("completed"), F.count_if(of("failed")).alias("failed"), F.count_if(of("running")).alias("running"),
        F.round(F.try_divide(100.0 * done, F.count_if(recent)), 2).alias("success"), F.floor(F.try_divide(F.sum(F.when(of("completed"), F.col("ms"))), done) + 0.5).alias("mean_ms"),
        F.max(F.when(of("completed"), F.col("ms"))).alias("longest_ms"), F.max(F.when(recent, F.col("ts"))).alias("last"), F.coalesce((last["status"] == "failed").cast("int"), F.lit(0)).alias("failing"),
    )
    return by.filter("runs > 0")


@query(f"""WITH {RUNS}, t AS (SELECT event_id, job, CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000) * 1000 AS BIGINT) AS running_ms, coalesce(s_suppkey * 8640000, 120000) AS limit_ms, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000 AS exact FROM r LEFT JOIN supplier ON s_suppkey = user_id WHERE status = 'running') SELECT event_id, job, running_ms, limit_ms, running_ms - limit_ms AS over_ms FROM t WHERE exact > limit_ms""")
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that go on beyond their job's time limit, two minutes where none is set."""
    limits = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") * 8_640_000).alias("limit_ms"))
    told = runs(spark, sf_dir).filter("status = 'running'").join(limits, "user_id", "left").withColumn("limit_ms", F.coalesce("limit_ms", F.lit(120_000)))
    over = told.filter(seconds_ago("ts") * 1000 > F.col("limit_ms")).withColumn("running_ms", (F.round(seconds_ago("ts")) * 1000).cast("long"))
    return over.select("event_id", "job", "running_ms", "limit_ms", (F.col("running_ms") - F.col("limit_ms")).alias("over_ms"))


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS advanced FROM events WHERE event_type IN ('purchase', 'click') AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{NOW}' GROUP BY 1""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click") & (F.col("ts") >= at(NOW) - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < at(NOW)))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("advanced"))


@query("""SELECT coalesce(source, 'unknown') AS source, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) AS total, CAST(floor(100.0 * count(*) FILTER (WHERE quality = 0) / count(*) + 0.5) AS BIGINT) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 5 ORDER BY rejected DESC, 1 LIMIT 10""")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sources with the most rejected documents, of those with at least five."""
    joined = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    by = joined.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("rejected"), F.count("*").alias("total")).filter("total >= 5")
    return by.withColumn("rate", F.floor(100.0 * F.col("rejected") / F.col("total") + 0.5)).orderBy(F.desc("rejected"), "source").limit(10)


@query("""SELECT o_orderstatus AS stage, count(*) AS waiting, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 3 DAY) AS breaches FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def late_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits at a stage that is not the last, and what has waited for more than three days."""
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return open_.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("waiting"), F.count_if(F.col("o_orderdate") < at("2000-01-01") - F.expr("INTERVAL 3 DAYS")).alias("breaches"))


@query(f"""WITH e AS (SELECT user_id, event_type, CAST(round(value * 1000) AS BIGINT) AS ms, ts >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS hour, ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS day FROM events WHERE ts < TIMESTAMP '{NOW}'),
 s AS (SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, count(*) FILTER (WHERE hour) AS this_hour, count(*) FILTER (WHERE day) AS this_day FROM e GROUP BY 1)
 SELECT *, coalesce(this_hour >= CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1 END, false) OR coalesce(this_day >= CASE WHEN user_id % 2 = 0 THEN NULL ELSE 2 END, false) AS over_quota FROM s""")
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response times and quotas by source; a missing quota is none."""
    since = lambda span: F.count_if(F.col("ts") >= at(NOW) - F.expr(f"INTERVAL 1 {span}"))
    told = table(spark, sf_dir, "events").filter(F.col("ts") < at(NOW)).withColumn("ms", F.round(F.col("value") * 1000).cast("long"))
    by = told.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.percentile("ms", 0.5), 4).alias("p50"), F.round(F.percentile("ms", 0.95), 4).alias("p95"), since("HOUR").alias("this_hour"), since("DAY").alias("this_day"))
    hourly, daily = F.when(F.col("user_id") % 3 != 0, 1), F.when(F.col("user_id") % 2 != 0, 2)
    over = F.coalesce(F.col("this_hour") >= hourly, F.lit(False)) | F.coalesce(F.col("this_day") >= daily, F.lit(False))
    return by.withColumn("over_quota", over)


@query(f"""WITH f AS (SELECT event_type, 1 + event_id % 5 AS rating, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 20 END AS sources, user_id % 2 = 0 AS expert FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{NOW}'),
 d AS (SELECT avg(date_diff('day', o_orderdate, TIMESTAMP '1998-01-01')) AS age FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'), k AS (SELECT count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'abrog')) AS told FROM documents WHERE lang = 'fr')
 SELECT coalesce(floor(1000.0 * count(*) FILTER (WHERE event_type <> 'error') / nullif(count(*), 0) + 0.5) / 10, 95) AS citations, coalesce(floor(1000.0 * count(*) FILTER (WHERE event_type = 'view') / nullif(count(*), 0) + 0.5) / 10, 0) AS inventions, coalesce(floor(1000.0 * count(*) FILTER (WHERE sources >= 10) / nullif(count(sources), 0) + 0.5) / 10, 75) AS coverage,
 coalesce(floor(800.0 * count(*) FILTER (WHERE rating >= 4) / nullif(count(*), 0) + 0.5) / 10, 70) AS perspectives, coalesce(floor(1000.0 * count(*) FILTER (WHERE rating >= 4) / nullif(count(*), 0) + 0.5) / 10, 80) AS actionable, floor(coalesce(avg(rating) FILTER (WHERE expert), 4.0) / 5 * 1000 + 0.5) / 10 AS satisfaction,
 floor(greatest(0, 100 - coalesce(max(age), 365) / 730 * 100) * 10 + 0.5) / 10 AS freshness, coalesce(least(100, floor(1000.0 * max(told) / nullif(max(k.n), 0) + 0.5) / 10), 85) AS repeals FROM f, d, k""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight figures in percent, with what stands where nothing is known. Three aggregates of one row each."""
    recent = table(spark, sf_dir, "events").filter((F.col("ts") >= at(NOW) - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < at(NOW)))
    rating = 1 + F.col("event_id") % 5
    part = lambda n, of, otherwise, whole=1000.0: F.coalesce(F.floor(F.try_divide(whole * n, of) + 0.5) / 10, F.lit(float(otherwise)))
    all_, liked, known = F.count("*"), F.count_if(rating >= 4), F.col("event_id") % 7 != 0
    said = recent.agg(
        part(F.count_if(F.col("event_type") != "error"), all_, 95).alias("citations"), part(F.count_if(F.col("event_type") == "view"), all_, 0).alias("inventions"), part(F.count_if(known & (F.col("event_id") % 20 >= 10)), F.count_if(known), 75).alias("coverage"),
        part(liked, all_, 70, 800.0).alias("perspectives"), part(liked, all_, 80).alias("actionable"), (F.floor(F.coalesce(F.avg(F.when(F.col("user_id") % 2 == 0, rating)), F.lit(4.0)) / 5 * 1000 + 0.5) / 10).alias("satisfaction"),
    )
    age = F.coalesce(F.avg(F.datediff(F.lit("1998-01-01").cast("date"), "o_orderdate")), F.lit(365.0))
    fresh = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= at("1996-01-01")) & (F.col("o_orderdate") < at("1998-01-01"))).agg((F.floor(F.greatest(F.lit(0.0), 100 - age / 730 * 100) * 10 + 0.5) / 10).alias("freshness"))
    told = table(spark, sf_dir, "documents").filter("lang = 'fr'").agg(F.least(F.lit(100.0), part(F.count_if(F.contains(F.lower("text"), F.lit("abrog"))), F.count("*"), 85)).alias("repeals"))
    return said.crossJoin(fresh).crossJoin(told)


# Duplicates, thresholds, changes ----------------------------------------------------

COPIES = "h AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE text IS NOT NULL), c AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1 HAVING count(*) > 1)"


@query(f"""WITH {COPIES}, r AS (SELECT least(h.source, o.source) || ' - ' || greatest(h.source, o.source) AS pair FROM h JOIN c USING (h) JOIN h o ON o.doc_id = c.first WHERE h.doc_id <> c.first AND h.source <> o.source) SELECT pair, count(*) AS copies, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM r GROUP BY 1 ORDER BY copies DESC, pair LIMIT 10""")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose first text is of another source, by pair of sources: the ten most frequent. Copies are counted by text and source before
    any join, so a group of many copies is a row per source."""
    by = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h"), "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    origin = by.groupBy("h").agg(F.min_by("source", "first").alias("origin"))
    pairs = by.join(origin, "h").filter("source <> origin").groupBy(F.concat_ws(" - ", F.least("source", "origin"), F.greatest("source", "origin")).alias("pair")).agg(F.sum("n").alias("copies"))
    # One row a pair of sources.
    return pairs.withColumn("total", F.sum("copies").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("copies"), "pair").limit(10)


@query(f"""WITH {COPIES} SELECT doc_id, coalesce(doc_id = c.first, true) OR doc_id % 3 = 0 AS enabled, CASE WHEN doc_id <> c.first AND doc_id % 3 <> 0 THEN 'copy' END AS reason FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN c USING (h)""")
def reverted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies are disabled with a reason; of those, the documents to be reverted (here every third) are enabled again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.filter("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("first"))
    copy = F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False))
    marked = docs.join(first, "h", "left").select("doc_id", (~copy).alias("enabled"), F.when(copy, "copy").alias("reason"))
    back = F.col("doc_id") % 3 == 0
    return marked.select("doc_id", (F.col("enabled") | back).alias("enabled"), F.when(~back, F.col("reason")).alias("reason"))


BARS = ", ".join(f"('{name}', {c}::DOUBLE, {q}::DOUBLE)" for name, (c, q) in pages.THRESHOLDS.items())


@query(f"""WITH b(name, c, q) AS (VALUES {BARS}), d AS (SELECT doc_id, ['jurisprudence', 'legislation', 'doctrine', 'other'][doc_id % 4 + 1] AS category, CASE doc_id % 5 WHEN 0 THEN 'fiscal' WHEN 1 THEN 'penal' WHEN 2 THEN 'none' WHEN 3 THEN 'social' END AS domain FROM documents),
 t AS (SELECT doc_id, coalesce(x.c, y.c, 0.7) AS c, coalesce(x.q, y.q, 80) AS q FROM d LEFT JOIN b x ON x.name = domain LEFT JOIN b y ON y.name = category) SELECT doc_id, (doc_id % 100) / 100 < c AS to_review, doc_id % 101 >= q AS good_enough FROM t""")
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % by + 1).cast("int"))
    category, domain = pick(["jurisprudence", "legislation", "doctrine", "other"], 4), pick(["fiscal", "penal", "none", "social", None], 5)
    told = table(spark, sf_dir, "documents").select("doc_id", pages.threshold(category, domain).alias("c"), pages.threshold(category, domain, quality=True).alias("q"))
    return told.select("doc_id", ((F.col("doc_id") % 100) / 100 < F.col("c")).alias("to_review"), (F.col("doc_id") % 101 >= F.col("q")).alias("good_enough"))


@query(f"""WITH o AS (SELECT doc_id, source, coalesce(text, '') AS text, doc_id % 5 AS k FROM documents), v AS (SELECT doc_id, CASE WHEN k = 0 THEN NULL ELSE text END AS old, CASE WHEN k = 1 THEN text WHEN k = 2 THEN text || chr(10) || 'Loi abrogée' WHEN k = 3 THEN text || chr(10) || 'one more line' ELSE 'nothing of it' END AS new FROM o),
 l AS (SELECT doc_id, old, new, list_distinct(list_filter(list_transform(string_split(coalesce(old, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS a, list_distinct(list_filter(list_transform(string_split(new, chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS b FROM v),
 s AS (SELECT doc_id, old, new, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS s FROM l)
 SELECT doc_id, CASE WHEN old IS NULL THEN 'new' WHEN s = 0 THEN 'none' WHEN regexp_matches(new, 'R') AND NOT regexp_matches(old, 'R') THEN 'repeal' WHEN s < 0.05 THEN 'minor' ELSE 'major' END AS kind FROM s""".replace("'R'", "'" + pages.REPEALED.replace("(?iu:", "(?i:") + "'"))
def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against a later version of it: new, the same, with a repeal, with one more line, or another text."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    new = F.when(k == 1, text).when(k == 2, F.concat(text, F.lit("\nLoi abrogée"))).when(k == 3, F.concat(text, F.lit("\none more line"))).otherwise("nothing of it")
    versions = table(spark, sf_dir, "documents").select("doc_id", F.when(k != 0, text).alias("old"), new.alias("new"))
    return versions.select("doc_id", pages.change_kind(F.col("old"), F.col("new")).alias("kind"))


# Chunks by kind ---------------------------------------------------------------------

CATEGORIES = ["codes", "Jurisprudence", "doctrine", "unknown"]
SETTINGS = ", ".join(f"('{name}', {routing.SIZES.get(name, routing.SIZE)}, {routing.OVERLAPS.get(name, routing.OVERLAPS['default'])})" for name in sorted({*routing.SIZES, *routing.OVERLAPS}))


@query(f"""WITH s(name, size, overlap) AS (VALUES {SETTINGS}), d AS (SELECT doc_id, [{", ".join(f"'{c}'" for c in CATEGORIES)}, NULL][doc_id % 5 + 1] AS category FROM documents) SELECT doc_id, coalesce(size, {routing.SIZE}) AS size, coalesce(overlap, {routing.OVERLAPS["default"]}) AS overlap FROM d LEFT JOIN s ON s.name = lower(category)""")
def chunk_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(c) for c in [*CATEGORIES, None]]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", routing.chunk_size(category).alias("size"), routing.chunk_overlap(category).alias("overlap"))


@query()
def routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    strategy = F.element_at(F.array(*map(F.lit, ("adaptive", "article", "page"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return routing.routed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text", category.alias("category"), strategy.alias("strategy")))


@query()
def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.compressed_texts(table(spark, sf_dir, "documents"), "the law of the contract", 300)


# JSON, orders of rows, deletes ----------------------------------------------------------


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its lines as JSON; an order bounds them."""
    each = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(each))).alias("lines"), F.to_json(F.array_sort(F.collect_set("l_returnflag"))).alias("flags"))


@query("""SELECT l_orderkey, CAST(to_json(list({'line': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag)) AS VARCHAR) AS lines FROM lineitem GROUP BY 1""")
def lines_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("l_orderkey", "lines")


@query("""SELECT flag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 1) AS leading FROM (SELECT l_returnflag AS flag, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1""")
def flag_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each flag the orders whose JSON list holds it, and those that lead with it: all flags in one pass over the orders."""
    told = order_lines(spark, sf_dir)
    leads = lambda f: any_object("lines", "line int, part bigint, flag string", lambda x: (x["flag"] == f) & (x["line"] == 1))
    counts = told.agg(*[c for f in "ANR" for c in (F.count_if(holds_all("flags", [f])).alias(f), F.count_if(leads(f)).alias(f"{f}1"))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("orders"), F.col(f"{f}1").alias("leading")) for f in "ANR"])).alias("r")).select("r.*").filter("orders > 0")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_partkey % 7 = 0")
def pending_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an object in their JSON lines that was given back and is of certain parts."""
    wanted = any_object("lines", "line int, part bigint, flag string", lambda x: x["flag"].isin("R", "A") & (x["part"] % 7 == 0))
    return order_lines(spark, sf_dir).filter(wanted).select("l_orderkey")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 100")
def unlabelled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.orderBy(F.asc_nulls_first("quality"), "doc_id").limit(100)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01' OR o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01'""")
def either_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return where_all(joined, [any_between(["l_shipdate", "o_orderdate"], at("1997-01-01"), at("1997-02-01"))]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, user_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS errors FROM events")
def running_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count_if(F.col("event_type") == "error").over(w).alias("errors"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def deleted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return deleted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[.!?]')) AS stops FROM documents")
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.regexp_count("text", F.lit("[.!?]")).alias("stops"))


@query("""SELECT CASE WHEN n_nationkey IS NULL THEN 'r1' ELSE 'n' || n_nationkey END AS code, coalesce(n_name, r_name) AS label, CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN n_nationkey IS NULL THEN r_name ELSE r_name || ' > ' || n_name END AS path
 FROM (SELECT r_name, NULL AS n_nationkey, NULL AS n_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 1)""")
def taxonomy_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    below = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    return subtree(top.unionByName(below), "r1")


# Calculators ------------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice AS p, date_diff('day', o_orderdate, TIMESTAMP '{END}') AS days, CASE WHEN o_orderkey % 3 = 0 THEN 12.0::DOUBLE END AS rate FROM orders), i AS (SELECT *, CASE WHEN p > 0 AND days > 0 THEN round(p * 0.145 * (days / 365), 3) ELSE 0 END AS owed FROM o)
 SELECT o_orderkey, CASE WHEN p > 0 THEN floor((p + owed + 40) * 1000 + 0.5) / 1000 END AS due, round(p * (coalesce(rate, 14.5) / 100) * (days / 365), 3) AS statutory FROM i""")
def amounts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, principal = F.datediff(F.lit(END).cast("date"), "o_orderdate"), F.col("o_totalprice")
    rate = F.when(F.col("o_orderkey") % 3 == 0, 12.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", finance.amount_due(principal, finance.interest(principal, F.lit(14.5), days)).alias("due"), finance.statutory_interest(principal, rate, days).alias("statutory"))


@query(f"""WITH f AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1), t AS (SELECT c_custkey, c_acctbal AS i, c_custkey % 4 AS k, date_diff('day', d, TIMESTAMP '{END}') AS days, datesub('month', CAST(d AS DATE), DATE '{END}') AS months FROM customer JOIN f ON o_custkey = c_custkey), y AS (SELECT *, floor(days / 365.25 * 10) / 10 AS years FROM t)
 SELECT c_custkey, years, CASE WHEN years > 0 AND i > 0 THEN floor(years * 2.0::DOUBLE * i * 100 + 0.5) / 100 ELSE 0 END AS compensation, round(floor(months / 12) + (months % 12) / 12, 4) AS by_calendar, floor(days / 365.25) < 18 AS minor,
 CASE WHEN i > 0 AND k > 0 THEN floor(i * 25.0::DOUBLE / 100 / k * 100 + 0.5) / 100 ELSE 0 END AS per_child, CASE WHEN i > 0 AND k > 0 THEN floor(i * 25.0::DOUBLE / 100 * 100 + 0.5) / 100 ELSE 0 END AS total, CASE WHEN i > 0 AND k > 0 THEN floor(i * 20 / 100 / k * 100 + 0.5) / 100 ELSE 0 END AS low, CASE WHEN i > 0 AND k > 0 THEN floor(i * 30 / 100 / k * 100 + 0.5) / 100 ELSE 0 END AS high FROM y""")
def family_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d"))
    end, income = F.lit(END).cast("date"), F.col("c_acctbal")
    years = finance.years_between(F.col("d"), end)
    told = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(first, "c_custkey")
    return told.select("c_custkey", years.alias("years"), finance.compensation(years, income).alias("compensation"), F.round(finance.years_by_calendar(F.col("d"), end), 4).alias("by_calendar"), finance.minor(F.col("d"), end).alias("minor"), finance.support_band(income, F.col("c_custkey") % 4).alias("s")).select("*", "s.*").drop("s")


RISK = " + ".join(f"CASE WHEN {test} THEN {finance.SIGNS[name]} ELSE 0 END" for name, test in {"low_similarity": "value < 10", "single_source": "k % 3 = 1", "source_conflict": "k % 5 = 0", "source_outdated": "user_id % 4 = 0", "sensitive_topic": "event_type = 'view'", "citation_warning": "event_type = 'error'", "quality_gate": "k >= 80", "cross_legal_code": "k % 7 = 0"}.items())


@query(f"""WITH e AS (SELECT event_id, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), s AS (SELECT event_id, least(round({RISK}, 2), 1)::DOUBLE AS score FROM e) SELECT event_id, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM s""")
def answer_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    signs = {"low_similarity": F.col("value") < 10, "single_source": k % 3 == 1, "source_conflict": k % 5 == 0, "source_outdated": F.col("user_id") % 4 == 0, "sensitive_topic": kind == "view", "citation_warning": kind == "error", "quality_gate": k >= 80, "cross_legal_code": k % 7 == 0}
    return table(spark, sf_dir, "events").select("event_id", finance.answer_risk(signs).alias("r")).select("event_id", "r.*")
