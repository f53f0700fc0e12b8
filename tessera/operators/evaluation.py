"""Measures of retrieval and of change between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(found: Column, gold: Column, k: int) -> Column:
    """Of the gold list, each entry counted, the part among the first k found; 1 for an empty gold list."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(F.slice(found, 1, k), g)))
    return F.when(F.size(gold) == 0, 1.0).otherwise(hits / F.size(gold))


def precision_at(found: Column, gold: Column, k: int) -> Column:
    """Of the first k found, as many as there are, the part that is gold; 0 for none found, 1 for an empty gold list."""
    first = F.slice(found, 1, k)
    hits = F.size(F.filter(first, lambda x: F.array_contains(gold, x)))
    return F.when(F.size(gold) == 0, 1.0).when(F.size(first) == 0, 0.0).otherwise(hits / F.size(first))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(gold) == 0, 1.0).when(F.size(places) == 0, 0.0).otherwise(1 / F.array_min(places))


def share_found(wanted: Column, text: Column) -> Column:
    """Of the wanted phrases, the part that the text holds; 1 for none wanted."""
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))) / F.size(wanted))


def drift(rows: DataFrame, current: Column, before: Column, metrics: dict[str, tuple[Column, float]]) -> DataFrame:
    """metric, before, current, change, drifted: each measure in two periods, in one pass."""
    told = rows.agg(*[x for name, (measure, _) in metrics.items() for x in (F.avg(F.when(before, measure)).alias(f"{name}_a"), F.avg(F.when(current, measure)).alias(f"{name}_b"))])
    lines = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_a").alias("before"), F.col(f"{name}_b").alias("current"), F.lit(bar).alias("bar")) for name, (_, bar) in metrics.items()])
    spread = told.select(F.explode(lines).alias("m")).select("m.*")
    change = F.when(F.col("before") != 0, (F.col("current") - F.col("before")) / F.abs("before"))
    return spread.withColumn("change", change).select("metric", "before", "current", "change", (F.abs("change") > F.col("bar")).alias("drifted"))
