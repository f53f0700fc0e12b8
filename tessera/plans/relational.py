"""Relational analytics: filters, joins, aggregates, windows and sets over the business tables and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.filters import between, contains_ignoring_case, equal, one_of, where_all
from tessera.plans.registry import query
from tessera.sources.tables import latest, table, upsert

#: Stands for "now", so that results do not depend on the day.
NOW = "2024-01-15 00:00:00"


def money(column: str | F.Column) -> F.Column:
    return F.round(column, 2)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000")
def tenant_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = where_all(table(spark, sf_dir, "orders"), [equal("o_custkey", 7), one_of("o_orderstatus", ["F", "O"]), between("o_totalprice", 1000, None), equal("o_orderpriority", None)])
    return chosen.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%re%' AND p_size BETWEEN 5 AND 30 AND (p_retailprice >= 1200 OR p_size >= 20)")
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = (F.col("p_retailprice") >= 1200) | (F.col("p_size") >= 20)
    return where_all(table(spark, sf_dir, "part"), [contains_ignoring_case("p_name", "re"), between("p_size", 5, 30), either, one_of("p_brand", None)]).select("p_partkey", "p_name", "p_brand")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY 1")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").withColumn("k", k).filter("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("""SELECT CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band, count(*) AS n,
 round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM orders GROUP BY 1""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("o_totalprice") >= 300000, "high").when(F.col("o_totalprice") >= 100000, "medium").otherwise("low")
    counts = table(spark, sf_dir, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    # The window sees one row a band.
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O'
 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT n.n_name AS nation, r.r_name AS region, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation n JOIN region r ON n_regionkey = r_regionkey
 LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def nation_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each side is counted before the join, so that customers and suppliers do not multiply.
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey).join(customers, nation.n_nationkey == customers.c_nationkey, "left").join(suppliers, nation.n_nationkey == suppliers.s_nationkey, "left")
    return joined.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT l_orderkey, l_linenumber, cn.n_name AS buyer, sn.n_name AS seller FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE l_quantity >= 45 AND cn.n_name <> sn.n_name""")
def foreign_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer"))
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))
    parties = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    parties = parties.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    parties = parties.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return parties.join(buyer, "c_nationkey", "left").join(seller, "s_nationkey", "left").filter("buyer <> seller").select("l_orderkey", "l_linenumber", "buyer", "seller")


@query("""SELECT c_custkey, count(o_orderkey) AS open_orders, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM customer
 LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1""")
def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The status belongs to the join, not to a later filter: customers without open orders stay.
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("open_orders"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["open_orders", "large"])


@query("""WITH a AS (SELECT user_id, count(*) AS n, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS purchases, round(b.v - a.v, 6) AS delta, coalesce(b.v - a.v < -0.05, false) AS regression FROM a FULL JOIN b ON a.user_id = b.user_id""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A full join of two runs by key is one aggregation over both.
    of = lambda kind, x: F.when(F.col("event_type") == kind, x)
    by = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase")).groupBy("user_id")
    both = by.agg(F.count(of("click", 1)).alias("clicks"), F.count(of("purchase", 1)).alias("purchases"), (F.avg(of("purchase", F.col("value"))) - F.avg(of("click", F.col("value")))).alias("d"))
    return both.select("user_id", "clicks", "purchases", F.round("d", 6).alias("delta"), F.coalesce(F.col("d") < -0.05, F.lit(False)).alias("regression"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days")
    )


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 48)")
def returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(lines, "p_partkey", "left_semi")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey END FROM lineitem WHERE l_suppkey % 7 = 0)")
def not_in_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("not_in_supplier")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("not_in_lineitem")
    return spark.sql("SELECT s_suppkey FROM not_in_supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM not_in_lineitem WHERE l_suppkey % 7 = 0)")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished FROM customer WHERE c_mktsegment = 'BUILDING'")
def correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("finished"))
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["finished"])


@query("""WITH e AS (SELECT DISTINCT user_id, ts, event_type FROM events), d AS (SELECT DISTINCT user_id, ts FROM events), n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM d)
 SELECT e.event_type, count(*) AS n, round(avg(epoch_us(n.after) - epoch_us(n.ts)) / 1e6, 3) AS mean_s FROM e JOIN n USING (user_id, ts) WHERE n.after IS NOT NULL GROUP BY 1""")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to the user's first strictly later event: ties in time are one moment."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type").distinct()
    moment = events.groupBy("user_id", "ts").agg(F.collect_set("event_type").alias("kinds"))
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    gap = F.unix_micros(F.col("after").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return moment.withColumn("after", after).filter("after IS NOT NULL").select(F.explode("kinds").alias("event_type"), gap.alias("gap")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("gap") / 1e6, 3).alias("mean_s"))


@query("""SELECT node, other, way FROM (SELECT l_partkey AS node, l_suppkey AS other, 'out' AS way FROM lineitem WHERE l_partkey <= 50 UNION ALL SELECT l_suppkey, l_partkey, 'in' FROM lineitem WHERE l_suppkey <= 5) GROUP BY ALL""")
def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    out = edges.filter("l_partkey <= 50").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("other"), F.lit("out").alias("way"))
    back = edges.filter("l_suppkey <= 5").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other"), F.lit("in").alias("way"))
    return out.unionByName(back).distinct()


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers,
 round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS error_rate, round(stddev_samp(value), 6) AS spread, count(value) AS valued FROM events""")
def activity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda kind: F.col("event_type") == kind
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"),
        F.count_if(is_("error")).alias("errors"),
        F.count_distinct(F.when(is_("purchase"), F.col("user_id"))).alias("buyers"),
        F.round(F.try_divide(100.0 * F.count_if(is_("error")), F.count_if(is_("view"))), 4).alias("error_rate"),
        F.round(F.stddev_samp("value"), 6).alias("spread"),
        F.count("value").alias("valued"),
    )


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1 HAVING count(*) > 500 AND avg(l_discount) > 0.05")
def busy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the order of a sum of doubles decides: an exact sum, in decimals, tells whether the mean is above 0.05, and a mean halfway between two
    of six digits is rounded as the doubles add up in the table's order, which the SQL does."""
    lines, mean = table(spark, sf_dir, "lineitem"), F.col("total") / F.col("known")
    by = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("l_discount").alias("known"), F.sum("l_discount").alias("total"), F.sum(F.abs("l_discount")).alias("size")).filter("n > 500")
    # No order of the rows moves a mean of doubles by more; decimals hold the sums below 1e15.
    slack = F.col("size") * 2.0**-51 + 1e-12
    open_ = (F.abs(mean - 0.05) <= slack) | (F.abs(F.pmod(mean * 1e6, F.lit(1.0)) - 0.5) <= slack * 1e6)
    added = sums_in_order(lines, by.filter((F.col("size") < 1e15) & open_), "l_suppkey", "l_discount").withColumnRenamed("l_suppkey", "key")
    found = by.join(added, by["l_suppkey"].eqNullSafe(added["key"]), "left").filter(F.coalesce(F.col("exact") * 20 > F.col("known"), mean > 0.05))
    return found.select("l_suppkey", "n", (F.round(F.coalesce(F.col("added") / F.col("known"), mean) * 1e6) / 1e6).alias("discount"))


def sums_in_order(lines: DataFrame, chosen: DataFrame, key: str, value: str, run: int = 1 << 16) -> DataFrame:
    """key, added, exact of the chosen keys: their doubles added in the order of the rows in the Parquet files, in runs of `run` rows of a key whose sums are added in turn, and their exact sum."""
    row = F.col("_metadata.row_index")
    rows = lines.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("x"), F.col("_metadata.file_path").alias("file"), F.floor(row / run).alias("block"), row.alias("row"))
    keys = chosen.select(F.col(key).alias("chosen"))
    rows = rows.join(keys, rows[key].eqNullSafe(keys["chosen"]), "left_semi")
    # Places in a key from counts by block, so that no task sorts more than a block's rows.
    block = [key, "file", "block"]
    before = Window.partitionBy(key).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*block).agg(F.count("*").alias("m")).select(*[F.col(c).alias(f"{c}_") for c in block], F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    same = [rows[c].eqNullSafe(starts[f"{c}_"]) for c in block]
    place = F.col("start") + F.row_number().over(Window.partitionBy(*block).orderBy("row")) - 1
    placed = rows.join(starts, same).select(key, "x", place.alias("place"))
    in_turn = lambda at, x: F.aggregate(F.array_sort(F.collect_list(F.struct(at, x))), F.lit(0.0), lambda a, r: a + r[x])
    runs = placed.groupBy(key, F.floor(F.col("place") / run).alias("run")).agg(in_turn("place", "x").alias("sum"), F.sum(F.col("x").cast("decimal(28,12)")).alias("part"))
    return runs.groupBy(key).agg(in_turn("run", "sum").alias("added"), F.sum("part").alias("exact"))


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def monthly_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / greatest(count(DISTINCT CAST(ts AS DATE)), 1), 4) AS per_day FROM events GROUP BY ALL""")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    dow, days = F.dayofweek("ts") - 1, F.count_distinct(F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy(dow.alias("dow"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), days.alias("days"), F.round(F.count("*") / F.greatest(days, F.lit(1)), 4).alias("per_day"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles by exact counts of distinct values; values to a microunit keep those counts bounded."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
 SELECT event_type, max(value) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(n) AS n FROM r GROUP BY 1""")
def nearest_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(n * p). Found from counts by distinct value, never from a sorted list of a whole group."""
    by_value = table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("m"))
    w = Window.partitionBy("event_type")
    placed = by_value.withColumns({"n": F.sum("m").over(w), "end": F.sum("m").over(w.orderBy("value"))})
    at = lambda p: F.max(F.when((F.floor(F.col("n") * p) < F.col("end")) & (F.floor(F.col("n") * p) >= F.col("end") - F.col("m")), F.col("value")))
    return placed.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("n").alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS i FROM c) SELECT user_id, event_type AS usual, n FROM r WHERE i = 1""")
def usual_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return latest(counts, ["user_id"], [F.desc("n"), F.asc("event_type")]).select("user_id", F.col("event_type").alias("usual"), "n")


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10""")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("""SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS statuses, CAST(array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_totalprice > 100000), ',') AS VARCHAR) AS large FROM orders GROUP BY 1""")
def order_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")))
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(made.alias("h"))
    big = F.filter("h", lambda x: x["o_totalprice"] > 100000)
    return by.select("o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderstatus"]), ",").alias("statuses"), F.when(F.size(big) > 0, F.array_join(F.transform(big, lambda x: x["o_orderkey"].cast("string")), ",")).alias("large"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS by_type FROM c GROUP BY 1""")
def counts_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("by_type"))


@query("""SELECT least(cn, sn) || ' <-> ' || greatest(cn, sn) AS pair, count(*) AS n FROM (SELECT c_nationkey AS cn, s_nationkey AS sn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1""")
def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("m"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    joined = lines.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return joined.groupBy(F.concat_ws(" <-> ", F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")).alias("pair")).agg(F.sum("m").alias("n"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT o_custkey, round(least(100.0, 2.0 * n + 30.0 * t / 5000000 + 20.0 * greatest(0, 1 - date_diff('day', last, TIMESTAMP '2001-08-01') / 365.0)), 4) AS score FROM s""")
def migration_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"), F.max("o_orderdate").alias("last"))
    age = F.datediff(F.lit("2001-08-01").cast("timestamp"), "last")
    return by.select("o_custkey", F.round(F.least(F.lit(100.0), 2.0 * F.col("n") + 30.0 * F.col("t") / 5000000 + 20.0 * F.greatest(F.lit(0), 1 - age / 365.0)), 4).alias("score"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) SELECT user_id, round(sum(value * pow(0.5, CASE WHEN i = n THEN i - 1 ELSE i END)), 6) AS smoothed FROM r GROUP BY 1""")
def smoothed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old + new) / 2, value by value, from the first: weights halve with age, and the first weighs as the second."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w).alias("i"), F.lead("event_id").over(w).isNull().alias("first"))
    weight = F.pow(F.lit(0.5), F.col("i") - F.col("first").cast("int"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("smoothed"))


@query("""SELECT user_id, max(ts) AS last_seen, round(greatest(0.0, 1 - date_diff('day', max(ts), TIMESTAMP '2024-01-15') / 30.0), 6) AS freshness FROM events GROUP BY 1""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return by.withColumn("freshness", F.round(F.greatest(F.lit(0.0), 1 - F.datediff(F.lit(NOW).cast("timestamp"), "last_seen") / 30.0), 6))


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 2")
def top_two_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("i")).filter("i <= 2")


@query("""WITH p AS (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 5 WHEN 'click' THEN 1 ELSE 0 END) AS points FROM events GROUP BY 1)
 SELECT user_id, CAST(points AS BIGINT) AS points, rank() OVER (ORDER BY points DESC) AS place, CASE WHEN points >= 300 THEN 'gold' WHEN points >= 200 THEN 'silver' ELSE 'bronze' END AS badge FROM p""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank is one more than the users with more points: counted by points, so no task sorts all users."""
    worth = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "signup", 5).when(F.col("event_type") == "click", 1).otherwise(0)
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(worth).alias("points"))
    places = users.groupBy("points").agg(F.count("*").alias("m")).withColumn("place", (F.sum("m").over(Window.orderBy(F.desc("points"))) - F.col("m") + 1))
    badge = F.when(F.col("points") >= 300, "gold").when(F.col("points") >= 200, "silver").otherwise("bronze")
    return users.join(places, "points").select("user_id", "points", F.col("place").cast("int").alias("place"), badge.alias("badge"))


@query("""WITH t AS (SELECT user_id, CAST(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS c FROM events) SELECT user_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS changes FROM t GROUP BY 1""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != F.lag("event_type").over(w)).alias("c"))
    return changed.groupBy("user_id").agg(F.count_if("c").alias("changes"))


@query("""WITH r AS (SELECT user_id, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM events) SELECT user_id, count(*) FILTER (WHERE ok = 0) AS streak, count(*) FILTER (WHERE event_type = 'error') AS errors FROM r GROUP BY 1""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors since the last success: events later than the latest other event. No window is needed."""
    by = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("bad"))
    last = by.filter("not bad").groupBy("user_id").agg(F.max("at").alias("good"))
    return by.join(last, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("bad") & (F.col("good").isNull() | (F.col("at") > F.col("good")))).alias("streak"), F.count_if("bad").alias("errors"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
 SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE (event_type = 'error') <> (before = 'error')) AS flips FROM e WHERE i <= 10 GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 3""")
def alert_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    last = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("i"), F.lag("event_type").over(w.orderBy("ts", "event_id")).alias("before")).filter("i <= 10")
    bad = F.col("event_type") == "error"
    return last.groupBy("user_id").agg(F.count_if(bad).alias("errors"), F.count_if(bad != (F.col("before") == "error")).alias("flips")).filter("errors >= 3")


@query("""WITH v AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), c AS (SELECT *, sum(q) OVER (ORDER BY q DESC, l_partkey) AS run, sum(q) OVER () AS total FROM v) SELECT l_partkey, round(q, 2) AS q FROM c WHERE run - q < 0.8 * total""")
def covering_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used parts that together cover 80 %. Running sums go in two levels: over distinct amounts, then inside one amount."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    amounts = used.groupBy("q").agg(F.sum("q").alias("all"))
    placed = amounts.select("q", (F.sum("all").over(Window.orderBy(F.desc("q"))) - F.col("all")).alias("before"), F.sum("all").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = F.row_number().over(Window.partitionBy("q").orderBy("l_partkey")) - 1
    return used.join(placed, "q").withColumn("run", F.col("before") + F.col("q") * inside).filter("run < 0.8 * total").select("l_partkey", F.round("q", 2).alias("q"))


@query("""WITH v AS (SELECT DISTINCT p_brand FROM part), w AS (SELECT p_brand, CAST(substr(p_brand, length(p_brand)) AS INTEGER) + 1 AS weight FROM v) SELECT p_brand, weight, CAST(sum(weight) OVER (ORDER BY p_brand) AS BIGINT) AS upto, CAST(sum(weight) OVER () AS BIGINT) AS total FROM w""")
def traffic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("weight", F.substring("p_brand", -1, 1).cast("int") + 1)
    return brands.select("p_brand", "weight", F.sum("weight").over(Window.orderBy("p_brand")).alias("upto"), F.sum("weight").over(Window.partitionBy(F.lit(1))).alias("total"))


@query("""SELECT kind, happened, label FROM (SELECT 'order' AS kind, o_orderdate AS happened, o_orderstatus AS label FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'shipment', l_shipdate, l_linestatus FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT 'event', ts, event_type FROM events WHERE value > 50)""")
def unified_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("happened"), F.col("o_orderstatus").alias("label"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.lit("shipment").alias("kind"), F.col("l_shipdate").alias("happened"), F.col("l_linestatus").alias("label"))
    events = table(spark, sf_dir, "events").filter("value > 50").select(F.lit("event").alias("kind"), F.col("ts").alias("happened"), F.col("event_type").alias("label"))
    return orders.unionByName(lines).unionByName(events)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders""")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    changes = base.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    return upsert(base, changes, ["o_orderkey"], "version")


@query("SELECT c_custkey FROM customer ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy(draw, "c_custkey").limit(50)


@query("""WITH s AS (SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1) SELECT o_orderstatus, n, customers, mean, round(100.0 * n / sum(n) OVER (), 4) AS share FROM s""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), money(F.avg("o_totalprice")).alias("mean"))
    return by.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("""WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS code, CAST(NULL AS VARCHAR) AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
 walk AS (SELECT code, label, 0 AS depth, label AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.code, t.label, w.depth + 1, w.path || ' > ' || t.label FROM tree t JOIN walk w ON t.parent = w.code) SELECT code, label, depth, path FROM walk""")
def taxonomy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.graph import tree_paths

    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    below = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    return tree_paths(top.unionByName(below))


@query("""WITH a AS (SELECT user_id, count(*) AS n, round(sum(value), 4) AS cost FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, event_type, round(sum(value), 4) AS cost FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL)
 SELECT b.user_id, b.event_type, b.cost, a.n, round(100.0 * b.cost / nullif(a.cost, 0), 2) AS percent FROM b JOIN a USING (user_id)""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(NOW).cast("timestamp"))
    by = past.groupBy("user_id", "event_type").agg(F.count("*").alias("m"), F.sum("value").alias("s"))
    w = Window.partitionBy("user_id")
    cost, whole = F.round("s", 4), F.round(F.sum("s").over(w), 4)
    return by.select("user_id", "event_type", cost.alias("cost"), F.sum("m").over(w).alias("n"), F.round(F.try_divide(100.0 * cost, whole), 2).alias("percent"))
