"""Event analytics: counts, versions, sessions, chords and interaction paths.

Events are rows with entity, event_type, ts, value, version and, to order equal times, event_id. Every function
takes the time it looks from, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _time(at) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")


def in_range(event_type: str, start, end) -> Column:
    """Events of a type in a closed range of time."""
    return (F.col("event_type") == event_type) & F.col("ts").between(_time(start), _time(end))


def look_back(event_type: str, end, interval: str) -> Column:
    """Events of a type in the interval, such as '7 days', that ends at a time."""
    return in_range(event_type, _time(end) - F.expr(f"INTERVAL {interval}"), end)


def count_events(events: DataFrame, which: Column, by: list[str] | None = None) -> DataFrame:
    return events.where(which).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"))


def count_unique(events: DataFrame, which: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct values of the events."""
    return events.where(which).groupBy(*(by or [])).agg(F.count_distinct("value").alias("n"))


def sum_values(events: DataFrame, which: Column, by: list[str] | None = None) -> DataFrame:
    """Sum of the values that are numbers; 0 without any."""
    return events.where(which).groupBy(*(by or [])).agg(F.coalesce(F.sum(F.col("value").try_cast("double")), F.lit(0.0)).alias("total"))


def days_since(events: DataFrame, event_type: str, at, latest: bool = True, by: list[str] | None = None) -> DataFrame:
    """Whole days from the latest (or earliest) event of a type up to a time; null without any."""
    pick = (F.max if latest else F.min)(F.when((F.col("event_type") == event_type) & (F.col("ts") <= _time(at)), F.col("ts")))
    return events.groupBy(*(by or [])).agg(pick.alias("t")).select(*(by or []), F.timestamp_diff("DAY", "t", _time(at)).alias("days"))


def current(events: DataFrame) -> DataFrame:
    """The latest version of each entity, type and time; ties go to the later process date, then the hash."""
    ties = [F.desc(c) for c in ("version", "process_date") if c in events.columns]
    order = W.partitionBy("entity", "event_type", "ts").orderBy(*ties, F.xxhash64(*events.columns))
    return events.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def extract_chords(events: DataFrame, event_type: str, at=None) -> DataFrame:
    """(entity, chord): the latest event of a type of each entity, null where it has none."""
    match = F.col("event_type") == event_type
    if at is not None:
        match &= F.col("ts") <= _time(at)
    return events.groupBy("entity").agg(F.max(F.when(match, F.col("ts"))).alias("chord"))


def sessionize(events: DataFrame, timeout: str) -> DataFrame:
    """Numbers each entity's sessions from 1; a gap longer than the timeout, such as '24 hours', begins one."""
    order = W.partitionBy("entity").orderBy("ts", *(["event_id"] if "event_id" in events.columns else []))
    gap = F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {timeout}")
    opened = F.coalesce(gap.cast("int"), F.lit(0))
    return current(events).withColumn("_new", opened).withColumn("session", (F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")


def _tie(events: DataFrame) -> list[str]:
    return ["event_id"] if "event_id" in events.columns else []


def previous_interactions(events: DataFrame, n: int, at) -> DataFrame:
    """The n latest events of each entity up to a time, one row each; rank 1 is the latest."""
    rows = current(events).where(F.col("ts") <= _time(at))
    order = W.partitionBy("entity").orderBy(F.desc("ts"), *(F.desc(c) for c in _tie(events)))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _up_to_chord(events: DataFrame, event_type: str, at) -> DataFrame:
    """Events up to the entity's latest event of a type, by a window over the entity: one shuffle."""
    rows = current(events).where(F.col("ts") <= _time(at))
    latest = F.max(F.when(F.col("event_type") == event_type, F.col("ts"))).over(W.partitionBy("entity"))
    return rows.withColumn("chord", latest).where("ts <= chord")


def chord_interactions(events: DataFrame, event_type: str, n: int, at) -> DataFrame:
    """(entity, path array) of the n latest events up to the chord, in order; entities without any keep []."""
    order = W.partitionBy("entity").orderBy(F.desc("ts"), *(F.desc(c) for c in _tie(events)))
    top = _up_to_chord(events, event_type, at).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    item = F.struct(F.negative("rank").alias("o"), "event_type", "ts")
    found = top.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["event_type"].alias("event_type"), x["ts"].alias("ts"))).alias("path"))
    return _with_all(events, found)


def chord_unique_interactions(events: DataFrame, event_type: str, n: int, at) -> DataFrame:
    """As chord_interactions(), with runs of one type as one item: type, its latest time and the run's length."""
    order = W.partitionBy("entity").orderBy("ts", *_tie(events))
    rows = _up_to_chord(events, event_type, at)
    turn = F.coalesce((F.col("event_type") != F.lag("event_type").over(order)).cast("int"), F.lit(1))
    rows = rows.withColumn("_t", turn).withColumn("run", F.sum("_t").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("entity", "run").agg(F.first("event_type").alias("event_type"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("count"))
    top = runs.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("run")))).where(F.col("rank") <= n)
    item = F.struct("run", "event_type", "ts", "count")
    found = top.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["event_type"].alias("event_type"), x["ts"].alias("ts"), x["count"].alias("count"))).alias("path"))
    return _with_all(events, found)


def _with_all(events: DataFrame, found: DataFrame) -> DataFrame:
    """Every entity; those without a result keep an empty path."""
    empty = F.array().cast(found.schema["path"].dataType)
    return events.select("entity").distinct().join(found, "entity", "left").withColumn("path", F.coalesce("path", empty))
