"""Evaluation, drift, feedback, deadlines and money."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import finance, text
from tessera.operators import evaluation
from tessera.plans.registry import query
from tessera.sources.tables import table

HOLIDAYS = ["01-01", "03-20", "04-09", "05-01", "07-25", "08-13", "10-15"]  # fixed values: month and day


@query("""WITH f AS (SELECT o_custkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, o_orderkey) AS found FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), g AS (SELECT o_custkey, list(DISTINCT l_partkey) AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT o_custkey, round(CASE WHEN gold IS NULL THEN 1.0 ELSE len(list_filter(gold, lambda x: list_contains(list_slice(found, 1, 5), x))) / len(gold) END, 6) AS recall, round(CASE WHEN gold IS NULL THEN 1.0 ELSE len(list_filter(list_slice(found, 1, 5), lambda x: list_contains(gold, x))) / len(list_slice(found, 1, 5)) END, 6) AS precision FROM f LEFT JOIN g USING (o_custkey)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    # Ranks first: what is gathered of a customer is five parts, and the distinct gold ones.
    w = Window.partitionBy("o_custkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_orderkey")
    found = lines.withColumn("i", F.row_number().over(w)).filter("i <= 5").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("i", "l_partkey"))).alias("f"))
    gold = lines.filter("l_returnflag = 'R'").groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("gold"))
    both = found.join(gold, "o_custkey", "left").select("o_custkey", F.col("f.l_partkey").alias("found"), F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold"))
    return both.select("o_custkey", F.round(evaluation.recall_at(F.col("found"), F.col("gold"), 5), 6).alias("recall"), F.round(evaluation.precision_at(F.col("found"), F.col("gold"), 5), 6).alias("precision"))


@query("""WITH m AS (SELECT unnest([{'metric': 'value', 'before': avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-08'), 'current': avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-08'), 'bar': 0.1}, {'metric': 'errors', 'before': avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE ts < TIMESTAMP '2024-01-08'), 'current': avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE ts >= TIMESTAMP '2024-01-08'), 'bar': 0.02}]) AS m FROM events)
 SELECT m.metric AS metric, round(m.before, 6) AS before, round(m.current, 6) AS current, round((m.current - m.before) / abs(m.before), 6) AS change, abs((m.current - m.before) / abs(m.before)) > m.bar AS drifted FROM m""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("2024-01-08").cast("timestamp")
    metrics = {"value": (F.col("value"), 0.1), "errors": (F.when(F.col("event_type") == "error", 1.0).otherwise(0.0), 0.02)}
    told = evaluation.drift(table(spark, sf_dir, "events"), F.col("ts") >= cut, F.col("ts") < cut, metrics)
    return told.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "current", "change")], "drifted")


@query("""SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS liked, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 4) AS satisfaction, round(count(*) * (1 - count(*) FILTER (WHERE quality = 1) / count(*)), 6) AS priority FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def feedback_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    liked = F.count_if(F.col("quality") == 1)
    return joined.groupBy("lang", "source").agg(F.count("*").alias("n"), liked.alias("liked"), F.round(100.0 * liked / F.count("*"), 4).alias("satisfaction"), F.round(F.count("*") * (1 - liked / F.count("*")), 6).alias("priority"))


@query("""WITH s AS (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(avg(value), 6) AS mean, max(ts) AS last FROM events GROUP BY 1) SELECT *, round(100.0 * ok / nullif(runs, 0), 2) AS rate, CASE WHEN ok = 0 THEN 'failing' WHEN 100.0 * ok / runs < 80 THEN 'degraded' ELSE 'healthy' END AS health FROM s""")
def crawler_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") != "error").alias("ok"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))
    rate = F.try_divide(100.0 * F.col("ok"), F.col("runs"))
    return by.withColumn("rate", F.round(rate, 2)).withColumn("health", F.when(F.col("ok") == 0, "failing").when(rate < 80, "degraded").otherwise("healthy"))


@query("""SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean, max(length(text)) AS longest, count(*) FILTER (WHERE quality = 1) AS gold, coalesce(round(avg(quality), 6), 0.75) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def corpus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("longest"), F.count_if(F.col("quality") == 1).alias("gold"), F.coalesce(F.round(F.avg("quality"), 6), F.lit(0.75)).alias("score"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 AND date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') > 0 THEN o_totalprice * 0.145 * (date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') / 365) ELSE 0 END, 6) AS interest, CAST(round(CAST(o_totalprice AS DECIMAL(15,2)) * 0.19::DECIMAL(3,2), 2) AS DOUBLE) AS tax FROM orders""")
def order_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2001-12-31").cast("date"), "o_orderdate")
    owed = finance.interest(F.col("o_totalprice"), F.lit(14.5), days, 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(owed, 6).alias("interest"), finance.tax(F.col("o_totalprice"), F.lit(19)).alias("tax"))


@query("""SELECT o_orderkey, CAST(floor(date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') / 365.25) AS BIGINT) AS age, round(floor(date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') / 365.25 * 10) / 10, 1) AS years, CASE WHEN date_diff('day', TIMESTAMP '2000-01-01', o_orderdate) < 0 THEN 'overdue' WHEN date_diff('day', TIMESTAMP '2000-01-01', o_orderdate) <= 3 THEN 'critical' WHEN date_diff('day', TIMESTAMP '2000-01-01', o_orderdate) <= 7 THEN 'urgent' WHEN date_diff('day', TIMESTAMP '2000-01-01', o_orderdate) <= 15 THEN 'soon' ELSE 'normal' END AS urgency FROM orders""")
def order_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("2001-12-31").cast("date")
    left = F.datediff("o_orderdate", F.lit("2000-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", finance.full_years(F.col("o_orderdate"), end).alias("age"), F.round(finance.years_between(F.col("o_orderdate"), end), 1).alias("years"), finance.urgency(left).alias("urgency"))


CAL = f"""WITH c AS (SELECT CAST(d AS DATE) AS day, NOT (dayofweek(d) IN (0, 6) OR strftime(d, '%m-%d') IN ({", ".join(f"'{h}'" for h in HOLIDAYS)}) OR strftime(d, '%m-%d') BETWEEN '08-01' AND '08-31') AS b FROM range(TIMESTAMP '1994-12-01', TIMESTAMP '2003-01-01', INTERVAL 1 DAY) t(d)), n AS (SELECT day, b, CAST(sum(CAST(b AS INT)) OVER (ORDER BY day) AS BIGINT) AS nth FROM c)"""


@query(f"{CAL} SELECT o_orderkey, strftime(t.day, '%Y-%m-%d') AS business, strftime(u.day, '%Y-%m-%d') AS moved FROM orders JOIN n ON n.day = CAST(o_orderdate AS DATE) JOIN n t ON t.b AND t.nth = n.nth + 10 JOIN n k ON k.day = CAST(o_orderdate AS DATE) + 30 JOIN n u ON u.b AND u.nth = k.nth + CASE WHEN k.b THEN 0 ELSE 1 END")
def order_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten business days after the order, and thirty days moved to a business day."""
    days = finance.calendar(spark, "1994-12-01", "2002-12-31", HOLIDAYS, ("08-01", "08-31"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    first = finance.business_deadline(orders, days, "o_orderdate", 10).withColumnRenamed("deadline", "first")
    both = finance.calendar_deadline(first, days, "o_orderdate", 30)
    return both.select("o_orderkey", F.date_format("first", "yyyy-MM-dd").alias("business"), F.date_format("deadline", "yyyy-MM-dd").alias("moved"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events QUALIFY in_hour > 2""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are the third or later of their user within an hour."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("in_hour")).filter("in_hour > 2")


@query("""WITH f AS (SELECT c_custkey, least(c_acctbal / 10000, 1.0) AS a, CASE WHEN n IS NOT NULL THEN least(n / 20.0, 1.0) END AS b FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) SELECT c_custkey, round((coalesce(a * 0.3, 0) + coalesce(b * 0.2, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END), 6) AS risk FROM f""")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    # least() passes over nulls, so a customer without orders would have the full share.
    joined = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    score = finance.risk_score([(F.least(F.col("c_acctbal") / 10000, F.lit(1.0)), 0.3), (F.when(F.col("n").isNotNull(), F.least(F.col("n") / 20.0, F.lit(1.0))), 0.2)])
    return joined.select("c_custkey", F.round(score, 6).alias("risk"))


@query(r"""WITH p AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '+216 20 123 ' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '0021620123' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN '20.123.' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN '+33 1 2345 67' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') ELSE '12' END AS raw FROM supplier), n AS (SELECT s_suppkey, regexp_replace(raw, '[^0-9+]', '', 'g') AS n FROM p)
 SELECT s_suppkey, CASE WHEN regexp_full_match(n, '[2-9][0-9]{7}') THEN '+216' || n WHEN regexp_full_match(n, '00216[2-9][0-9]{7}') THEN '+' || substr(n, 3) WHEN regexp_full_match(n, '216[2-9][0-9]{7}') THEN '+' || n ELSE n END AS phone FROM n""")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("+216 20 123 ", "0021620123", "20.123.", "+33 1 2345 67", "12"))), (F.col("s_suppkey") % 5 + 1).cast("int")), F.when(F.col("s_suppkey") % 5 == 4, "").otherwise(end))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.phone_e164(raw).alias("phone"))


@query("""WITH t AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, max(n) AS most FROM t GROUP BY 1""")
def daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return by.groupBy("day").agg(F.count("*").alias("users"), F.sum("n").alias("events"), F.max("n").alias("most"))
