"""Optional streaming forms of batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_stream(stream: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Applies a vault load to every micro-batch."""
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_counts(events: DataFrame, timeout: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Events per entity and session window, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy("entity", F.session_window("ts", timeout).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
