"""Trees, PageRank, connected components and density clustering by joins."""

from __future__ import annotations

import itertools
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str = "step") -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or that of setCheckpointDir; a local session without either gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            at = known.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        else:
            at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
            spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tree_paths(nodes: DataFrame, separator: str = " > ", most: int = 50) -> DataFrame:
    """code, label, depth, path of each node (code, parent, label) below a root, level by level.

    A node whose parents lead nowhere or in a circle is not reached. A level is one join.
    """
    level = nodes.filter("parent IS NULL").select("code", "label", F.lit(0).alias("depth"), F.col("label").alias("path"))
    found = level
    for _ in range(most):
        up = level.select(F.col("code").alias("parent"), F.col("depth").alias("d"), F.col("path").alias("p"))
        level = saved(nodes.join(up, "parent").select("code", "label", (F.col("d") + 1).alias("depth"), F.concat_ws(separator, "p", "label").alias("path")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"the tree is deeper than {most} levels")


def subtree(nodes: DataFrame, root: str, separator: str = " > ") -> DataFrame:
    """code, label, depth, path of the node called root and all below it, depth and path from there."""
    cut = nodes.withColumn("parent", F.when(F.col("code") != root, F.coalesce("parent", F.lit(""))))
    return tree_paths(cut, separator)


def pagerank(edges: DataFrame, damping: float = 0.85, most: int | None = None, tolerance: float = 1e-7, boosts: DataFrame | None = None, both: bool = False) -> DataFrame:
    """node, rank, score of edges (src, dst), with `both` in either direction: rank starts at 1/N, is multiplied by the node's boost in every
    turn, and stops when no rank moves by the tolerance times itself or 1/N, the mean, if that is more: it settles as well in a graph of any size, and a hub's rounding does not keep it going.
    Score is rank between 0 and 1, 0.5 if all are equal.
    `most` ends it after so many turns, of boosts after 20 if not told, as these need not settle. Else the second turn's ranks are extrapolated (power extrapolation), which
    leaves what they settle to and takes out the slowest errors, those that shrink by the damping a turn: of a part that no edge leaves, and between the sides of one that has two.
    No rank is handed round for nodes without outgoing edges. Degrees stand with the nodes, an edge for both directions is kept once; one join and one aggregation a turn."""
    src, dst = F.col("src"), F.col("dst")
    if both:
        turned = dst.isNull() | F.coalesce(src > dst, F.lit(False))
        edges = edges.select(F.when(turned, dst).otherwise(src).alias("src"), F.when(turned, src).otherwise(dst).alias("dst"))
    links = saved(edges.select("src", "dst").distinct())
    if both:
        links = links.union(links.select("dst", "src").filter(~src.eqNullSafe(dst)))
    ends = links.select(src.alias("node"), F.lit(1).alias("out"))
    nodes = (ends if both else ends.union(links.select("dst", F.lit(0)))).groupBy("node").agg(F.sum("out").alias("degree"))
    nodes = saved(nodes.join(boosts, "node", "left").na.fill(1.0, ["boost"]) if boosts is not None else nodes.withColumn("boost", F.lit(1.0)))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"))
    ranks = saved(nodes.withColumn("rank", F.lit(1.0 / n)))
    extrapolate = most is None and boosts is None and damping < 1
    for turn in itertools.count(1) if extrapolate else range(1, (20 if most is None else most) + 1):
        shares = ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
        given = links.join(shares, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = ranks.join(given, "node", "left").select("node", "degree", "boost", F.col("rank").alias("old"), (F.col("boost") * ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0)))).alias("rank"))
        new = saved(new)
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")) / F.greatest("rank", F.lit(1.0 / n)))).first()[0]
        ranks = new.drop("old")
        if moved < tolerance:
            break
        if extrapolate and turn == 2:
            ranks = ranks.withColumn("rank", (F.col("rank") - damping**2 / n) / (1 - damping**2))
    low, high = ranks.agg(F.min("rank"), F.max("rank")).first()
    score = (F.col("rank") - low) / (high - low) if high > low else F.lit(0.5)
    return ranks.select("node", "rank", score.alias("score"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of links (a, b), by alternating large and small stars."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def density_clusters(points: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """DBSCAN over the pairs (a, b) that are within reach: node, cluster (the smallest core point's id, -1 for noise).

    points has a column node. A core point has `least` points in reach, itself included; clusters are
    the components of core points; other points join the smallest cluster in reach.
    """
    both = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    core = saved(both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= least).select("a"))
    inside = both.join(core, "a").join(core.select(F.col("a").alias("b")), "b").select("a", "b")
    joined = components(inside)
    cluster = core.select(F.col("a").alias("node")).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    near = both.join(cluster.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
    return points.select("node").join(cluster, "node", "left").join(near, "node", "left").select("node", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def backoff_seconds(attempt: F.Column, first: float = 1.0, most: float = 60.0) -> F.Column:
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))


def hash_bucket(key: F.Column, shares: dict[str, float]) -> F.Column:
    """The variant that a key falls to, the same each time; shares are summed in their order."""
    unit = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, upto, chosen = math.fsum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share
        chosen = F.when(unit < upto / total, name) if chosen is None else chosen.when(unit < upto / total, name)
    return chosen.otherwise(next(reversed(shares)))


def crawl_order(spark: SparkSession, links: DataFrame, seeds: list[str], depth: int = 3, most: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """url, depth, place of what a breadth-first crawl over links (source, target) visits: places from 0, in the order of the visits.

    Within a depth, urls that are not in known (url) come before those that are, and else go by the place of the first page that
    links to them, then by name. A crawl ends after `most` pages: a level that would go beyond is cut before it is followed.
    """
    old = (known.select("url").distinct() if known is not None else spark.createDataFrame([], "url string")).withColumn("old", F.lit(1))
    level = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], "url string, place long").withColumn("depth", F.lit(0))
    level = level if most is None else level.filter(F.col("place") < most)
    seen, n = level, level.count()
    for d in range(1, depth + 1):
        if most is not None and n >= most:
            break
        ahead = links.join(level.select(F.col("url").alias("source"), "place"), "source").groupBy(F.col("target").alias("url")).agg(F.min("place").alias("by"))
        fresh = ahead.join(seen.select("url"), "url", "left_anti").join(old, "url", "left").select("url", F.coalesce("old", F.lit(0)).alias("old"), "by")
        level = saved(numbered(fresh, ["old", "by", "url"], n, most).select("url", "place", F.lit(d).alias("depth")))
        found = level.count()
        if not found:
            break
        n += found
        seen = saved(seen.unionByName(level))
    return seen.select("url", "depth", "place")


def numbered(rows: DataFrame, order: list[str], start: int = 0, most: int | None = None) -> DataFrame:
    """rows with place (long): their number in that order from `start`, without those from `most` on. A sort by range and counts a task, so no task sees all."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row a task.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + start).alias("shift"))
    placed = ordered.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("place", F.col("at") + F.col("shift"))
    return (placed if most is None else placed.filter(F.col("place") < most)).drop("task", "at", "shift")
