"""Feature registry, snapshot and chord pivots."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.model import Feature
from millrace.operators.events import _time


class Registry:
    """Registered features in the order of registration, each once."""

    def __init__(self, features: list[Feature] | None = None):
        self.features: list[Feature] = []
        for f in features or []:
            self.register(f)

    def register(self, feature: Feature) -> None:
        if feature not in self.features:
            self.features.append(feature)

    @property
    def active(self) -> list[str]:
        return list(dict.fromkeys(f.attribute for f in self.features if f.active))

    def save(self, path: str | Path) -> None:
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows(x.to_list() for x in self.features)

    @classmethod
    def load(cls, path: str | Path) -> Registry:
        with open(path, newline="", encoding="utf-8") as f:
            return cls([Feature.from_list(row) for row in csv.reader(f) if row])


def _latest(attribute: str):
    """Latest value of an attribute; equal times go to the higher version."""
    here = F.col("event_type") == attribute
    keys = F.struct("ts", F.coalesce("version", F.lit(0)), "value")
    return F.max_by("value", F.when(here, keys)).alias(attribute)


def _versioned(events: DataFrame) -> DataFrame:
    return events if "version" in events.columns else events.withColumn("version", F.lit(1))


def snapshot(events: DataFrame, at, store: Registry) -> DataFrame:
    """(entity, a column per active feature): latest values up to a time; one aggregation."""
    rows = _versioned(events).where(F.col("ts") <= _time(at))
    return rows.groupBy("entity").agg(*(_latest(a) for a in store.active))


def chord(events: DataFrame, attribute: str, at, store: Registry) -> DataFrame:
    """(sync, entity, features): values as of the entity's latest event of an attribute up to a time.

    Entities without such an event are left out. The window and the aggregation share one shuffle.
    """
    rows = _versioned(events).where(F.col("ts") <= _time(at))
    sync = F.max(F.when(F.col("event_type") == attribute, F.col("ts"))).over(W.partitionBy("entity"))
    rows = rows.withColumn("sync", sync).where("ts <= sync")
    return rows.groupBy("entity").agg(F.first("sync").alias("sync"), *(_latest(a) for a in store.active)).select("sync", "entity", *store.active)
