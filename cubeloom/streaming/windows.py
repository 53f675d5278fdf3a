"""Calendar-free binning of streams: what temporal aggregation does where bins have a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(events: DataFrame, value: str = "value", time: str = "ts", period: str = "1 day", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Count, mean, least and greatest value of each period; a period is final once the watermark has passed it."""
    t = F.col(time).cast("timestamp")
    rows = events.withColumn(time, t)
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, period), *(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("time"), *(by or []), "n", "mean", "least", "most")
