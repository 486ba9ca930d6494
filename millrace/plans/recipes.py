"""Feature recipes over purchases, usage and page events, each one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def since(at: str, weeks: int, column: str = "ts") -> Column:
    """The weeks before a time, its own instant excluded."""
    return (F.col(column) >= _at(at) - F.expr(f"INTERVAL {7 * weeks} DAYS")) & (F.col(column) < _at(at))


def weekly_average_of_daily_max(spend: DataFrame, at: str, weeks: int = 12) -> DataFrame:
    """Mean over weeks of the greatest daily spend of the week; spend: entity, ts, amount."""
    day = spend.where(since(at, weeks)).groupBy("entity", F.date_trunc("day", "ts").alias("d")).agg(F.sum("amount").alias("s"))
    week = day.groupBy("entity", F.date_trunc("week", "d").alias("w")).agg(F.max("s").alias("m"))
    return week.groupBy("entity").agg(F.avg("m").alias("weekly_avg_max"))


def lapsing(spend: DataFrame, at: str, weeks: int = 6, share: float = 0.6) -> DataFrame:
    """R2: whether the last weeks' spend is under a share of that of the weeks before."""
    sums = spend.where(since(at, 2 * weeks)).groupBy("entity").agg(*(F.sum(F.when(c, F.col("amount")).otherwise(0.0)).alias(n) for n, c in (("last", since(at, weeks)), ("prior", ~since(at, weeks)))))
    return sums.select("entity", "last", "prior", (F.col("last") < share * F.col("prior")).alias("lapsing"))


def yearly(items: DataFrame, at: str) -> DataFrame:
    """Spend, items, distinct items and carts of 52 weeks; items: entity, ts, amount, sku, cart."""
    return items.where(since(at, 52)).groupBy("entity").agg(F.sum("amount").alias("spend"), F.count("sku").alias("skus"), F.count_distinct("sku").alias("distinct_skus"), F.count_distinct("cart").alias("carts"))


def spend_profile(spend: DataFrame) -> DataFrame:
    """Mean transaction, mean monthly, least weekly and greatest spend."""
    base = spend.groupBy("entity").agg(F.avg("amount").alias("avg_transaction"), F.max("amount").alias("max_spend"))
    month = spend.groupBy("entity", F.date_trunc("month", "ts").alias("p")).agg(F.sum("amount").alias("s")).groupBy("entity").agg(F.avg("s").alias("avg_monthly"))
    week = spend.groupBy("entity", F.date_trunc("week", "ts").alias("p")).agg(F.sum("amount").alias("s")).groupBy("entity").agg(F.min("s").alias("min_weekly"))
    return base.join(month, "entity").join(week, "entity")


def item_purchases(items: DataFrame) -> DataFrame:
    """Per item: purchases, mean, total and greatest amount, days between purchases, median monthly amount."""
    base = items.groupBy("sku").agg(
        F.count(F.lit(1)).alias("purchases"), F.avg("amount").alias("avg_amount"), F.sum("amount").alias("total"), F.max("amount").alias("max_amount"),
        (F.timestamp_diff("DAY", F.min("ts"), F.max("ts")) / F.count(F.lit(1))).alias("interval_days"),
    )
    month = items.groupBy("sku", F.date_trunc("month", "ts").alias("m")).agg(F.sum("amount").alias("s")).groupBy("sku").agg(F.median("s").alias("median_monthly"))
    return base.join(month, "sku")


def repeated_category(items: DataFrame, at: str, weeks: int, least: int = 2) -> DataFrame:
    """Entities and categories with at least so many purchases; items: entity, ts, category."""
    return items.where(since(at, weeks)).groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def proportions(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Totals and shares of event types; events: entity, event_type, value."""
    total = F.sum("value")
    cols = [c for k in kinds for c in (F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)).alias(f"{k}_total"), (F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)) / total).alias(f"{k}_share"))]
    return events.groupBy("entity").agg(total.alias("total"), *cols)


def gradient(events: DataFrame, start: str) -> DataFrame:
    """Slope of weekly sums; null with one week."""
    week = F.floor(F.timestamp_diff("DAY", _at(start), F.col("ts")) / 7)
    return events.groupBy("entity", week.alias("w")).agg(F.sum("value").alias("s")).groupBy("entity").agg(F.regr_slope("s", F.col("w").cast("double")).alias("slope"))


def day_parts(events: DataFrame) -> DataFrame:
    """Events, active days, morning events, and events per weekend and per weekday."""
    weekend, day = F.dayofweek("ts").isin(1, 7), F.col("ts").cast("date")
    days = lambda c: F.count_distinct(F.when(c, day))
    per = lambda c: F.when(days(c) > 0, F.count(F.when(c, 1)) / days(c))
    return events.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("active_days"), F.count(F.when(F.hour("ts").between(6, 11), 1)).alias("mornings"), per(weekend).alias("per_weekend_day"), per(~weekend).alias("per_weekday"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Events and seconds of each session; sessions: entity, session, ts."""
    return sessions.groupBy("entity", "session").agg(F.count(F.lit(1)).alias("n"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


def daily_extremes(events: DataFrame, quantile: float = 0.1) -> DataFrame:
    """Greatest daily count and a quantile of the daily counts."""
    day = events.groupBy("entity", F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return day.groupBy("entity").agg(F.max("n").alias("max_daily"), F.percentile("n", quantile).alias("low_daily"))


def days_per_month(events: DataFrame) -> DataFrame:
    """Mean number of active days of the months with events."""
    month = events.groupBy("entity", F.date_trunc("month", "ts").alias("m")).agg(F.count_distinct(F.col("ts").cast("date")).alias("n"))
    return month.groupBy("entity").agg(F.avg("n").alias("days_per_month"))


def time_since(events: DataFrame, at: str, days_of: str, weeks_of: str) -> DataFrame:
    """Days since the last event of one type, whole weeks since that of another."""
    last = lambda k: F.max(F.when((F.col("event_type") == k) & (F.col("ts") <= _at(at)), F.col("ts")))
    return events.groupBy("entity").agg(last(days_of).alias("a"), last(weeks_of).alias("b")).select("entity", F.timestamp_diff("DAY", "a", _at(at)).alias("days"), F.floor(F.timestamp_diff("DAY", "b", _at(at)) / 7).alias("weeks"))
