"""Lookup of the nearest step of an axis of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import small
from ..shipping import stored

#: Buckets of the times that are looked up and those that are found.
BUCKETS = 256


def nearest_steps(asked: DataFrame, steps: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """asked_time, nearest: of each distinct time asked for (column t), the nearest of the steps (column t), of two the earlier.

    Times and steps are dealt to buckets by ranges of both, so that none holds much more than its share. In a bucket the
    last step before and the first after a time are carried along, up and down; at its ends, those of the nearest bucket that has one.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    named = asked.where("t IS NOT NULL").distinct().select(micros("t").alias("m"), "t", F.lit(False).alias("step"))
    known = steps.where("t IS NOT NULL").distinct().select(micros("t").alias("m"), "t", F.lit(True).alias("step"))
    dealt = stored(named.unionByName(known).repartitionByRange(buckets, "m").withColumn("bucket", F.spark_partition_id()), "times")
    ends = dealt.where("step").groupBy("bucket").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    every = dealt.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(ends, "bucket", "left")
    before, after = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    # over one row for each bucket
    carried = every.select("bucket", F.last("last", True).over(before).alias("earlier"), F.first("first", True).over(after).alias("later"))
    # both frames end at the current row: one that runs on to the last would be read anew for each row
    up, down = (Window.partitionBy("bucket").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("m"), F.desc("m")))
    step = F.when(F.col("step"), F.col("m"))
    near = dealt.join(F.broadcast(carried), "bucket").select(
        "t", "m", "step", F.coalesce(F.last(step, True).over(up), "earlier").alias("low"), F.coalesce(F.last(step, True).over(down), "later").alias("high")
    )
    best = F.when(F.col("low").isNull() | (F.col("high") - F.col("m") < F.col("m") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return near.where("NOT step").select(F.col("t").alias("asked_time"), F.timestamp_micros(best).cast("timestamp_ntz").alias("nearest"))


def with_nearest(rows: DataFrame, time: Column, steps: DataFrame, name: str) -> DataFrame:
    """rows with the nearest of the steps (one column of times) under a name; null times have none."""
    marked = rows.withColumn("_asked", time)
    found = nearest_steps(marked.select(F.col("_asked").alias("t")), steps.select(F.col(steps.columns[0]).cast("timestamp_ntz").alias("t")))
    return marked.join(small(found.withColumnRenamed("asked_time", "_asked").withColumnRenamed("nearest", name)), "_asked", "left").drop("_asked")
