"""Calculators as column expressions: interest, tax, support, ages, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interest(principal: Column, percent: Column, days: Column, places: int = 3) -> Column:
    """Simple interest over 365 days a year; 0 where an amount, a rate or a time is missing or not above 0."""
    whole = principal * (percent / 100) * (days / 365)
    return F.when((principal > 0) & (percent > 0) & (days > 0), F.round(whole, places)).otherwise(0.0)


def tax(net: Column, percent: Column) -> Column:
    """To the cent, halves up; in decimals, as halves occur."""
    return F.round(net.cast("decimal(18,2)") * percent.cast("decimal(6,2)") / 100, 2).cast("double")


def commission(amount: Column, percent: float = 1.5) -> Column:
    return F.round(amount * percent / 100, 3)


def years_between(start: Column, end: Column) -> Column:
    """Days over 365.25, cut to a tenth."""
    return F.floor(F.datediff(end, start) / 365.25 * 10) / 10


def full_years(start: Column, end: Column) -> Column:
    return F.floor(F.datediff(end, start) / 365.25)


def years_by_calendar(start: Column, end: Column) -> Column:
    """Whole years and twelfths of them by whole months."""
    months = F.floor(F.months_between(F.to_date(end), F.to_date(start)))
    return F.floor(months / 12) + F.pmod(months, F.lit(12)) / 12


def child_support(income: Column, children: Column, share: float = 0.25) -> Column:
    """Each child's part of the share of the income; null without children."""
    return F.when(children > 0, F.round(income * share / children, 3))


def half_up(x: Column, places: int) -> Column:
    """Rounded as numbers of the calculators are: halves go up."""
    return F.floor(x * 10**places + 0.5) / 10**places


def amount_due(principal: Column, owed: Column, fee: float = 40.0) -> Column:
    """Principal, its interest and the flat fee of recovery; null unless the principal is above 0."""
    return F.when(principal > 0, half_up(principal + owed + fee, 3))


def statutory_interest(principal: Column, percent: Column, days: Column) -> Column:
    """Interest as the stored procedure has it: 14.5 % where no rate is known, to the third place, null without a
    principal or a date; days before the term count below 0."""
    return F.round(principal * (F.coalesce(percent, F.lit(14.5)) / 100) * (days / 365), 3)


def compensation(years: Column, income: Column, months: float = 2.0) -> Column:
    """Months of income for each year; 0 where either is not above 0."""
    return F.when((years > 0) & (income > 0), half_up(years * months * income, 2)).otherwise(0.0)


def support_band(income: Column, children: Column, percent: float = 25.0) -> Column:
    """per_child, total, low, high: the part of the income for children, each child's part and its band of 20 to 30 %; 0 without income or children."""
    some = (income > 0) & (children > 0)
    of = lambda x: F.when(some, half_up(x, 2)).otherwise(0.0)
    n = F.when(children > 0, children)
    return F.struct(of(income * percent / 100 / n).alias("per_child"), of(income * percent / 100).alias("total"), of(income * 20 / 100 / n).alias("low"), of(income * 30 / 100 / n).alias("high"))


def minor(born: Column, day: Column) -> Column:
    return full_years(born, day) < 18


#: What each sign of a doubtful answer weighs.
SIGNS = {"low_similarity": 0.30, "single_source": 0.20, "source_conflict": 0.25, "source_outdated": 0.15, "sensitive_topic": 0.10, "citation_warning": 0.15, "quality_gate": 0.20, "cross_legal_code": 0.25}


def answer_risk(signs: dict[str, Column]) -> Column:
    """score, level: the weights of the signs that hold, at most 1; high from 0.65, medium from 0.40. An unknown sign does not hold."""
    total = sum((F.when(holds, SIGNS[name]).otherwise(0.0) for name, holds in signs.items()), F.lit(0.0))
    score = F.least(F.round(total, 2), F.lit(1.0))
    return F.struct(score.alias("score"), F.when(score >= 0.65, "high").when(score >= 0.40, "medium").otherwise("low").alias("level"))


def urgency(days_left: Column) -> Column:
    return F.when(days_left < 0, "overdue").when(days_left <= 3, "critical").when(days_left <= 7, "urgent").when(days_left <= 15, "soon").otherwise("normal")


def risk_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known; null if none is."""
    known = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return F.when(known > 0, total / known)


def calendar(spark, first: str, last: str, holidays: list[str] = (), recess: tuple[str, str] | None = None) -> DataFrame:
    """day, business (a day on which terms run) and nth, the number of business days up to it. One row a day of a span of years."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    month_day = F.date_format("day", "MM-dd")
    closed = F.dayofweek("day").isin(1, 7) | F.date_format("day", "yyyy-MM-dd").isin(*holidays, "") | month_day.isin(*holidays, "")
    closed = closed | month_day.between(*recess) if recess else closed
    from pyspark.sql import Window

    # Bounded by the span, one row a day.
    return days.withColumn("business", ~closed).withColumn("nth", F.sum(F.col("business").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("day")))


def business_deadline(rows: DataFrame, days: DataFrame, start: str, n: int, clear: bool = False) -> DataFrame:
    """rows with deadline: the n-th business day after start; clear terms neither count the first nor the last day."""
    extra = 1 if clear else 0
    at = days.select(F.col("day").alias("_day"), F.col("nth").alias("_nth"))
    to = days.filter("business").select(F.col("nth").alias("_to"), F.col("day").alias("deadline"))
    placed = rows.join(F.broadcast(at), F.to_date(start) == F.col("_day"), "left")
    return placed.join(F.broadcast(to), F.col("_to") == F.col("_nth") + n + extra, "left").drop("_day", "_nth", "_to")


def calendar_deadline(rows: DataFrame, days: DataFrame, start: str, n: int) -> DataFrame:
    """rows with deadline: n days after start, moved to the next business day."""
    at = days.select(F.col("day").alias("_day"), (F.col("nth") + F.when(F.col("business"), 0).otherwise(1)).alias("_nth"))
    to = days.filter("business").select(F.col("nth").alias("_to"), F.col("day").alias("deadline"))
    placed = rows.join(F.broadcast(at), F.date_add(F.to_date(start), n) == F.col("_day"), "left")
    return placed.join(F.broadcast(to), F.col("_to") == F.col("_nth"), "left").drop("_day", "_nth", "_to")
