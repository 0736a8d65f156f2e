"""Debounce as a relation: changes that follow each other within a gap are one flush."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(changes: DataFrame, gap: str = "300 milliseconds", bucket_seconds: int = 600) -> DataFrame:
    """A row for each flush. One timer serves all paths, so flushes are global; they are found in stretches of time.

    Within a stretch of bucket_seconds changes that follow each other within the gap are one
    island; only the first and last island of each stretch can go on in another, so that what
    is put in one order for all is two rows a stretch. A change that comes exactly one gap after
    the last still restarts the timer. Changes without a time are left out.
    """
    wait = F.expr(f"interval {gap}")
    rows = changes.where("ts is not null").select("path", "ts", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_seconds).alias("bucket"))
    within = Window.partitionBy("bucket").orderBy("ts")
    opens = F.coalesce(F.col("ts") > F.lag("ts").over(within) + wait, F.lit(True))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("bucket", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    last = F.max("island").over(Window.partitionBy("bucket"))
    ends = islands.withColumn("final", last).where((F.col("island") == 1) | (F.col("island") == F.col("final")))
    overall = Window.orderBy("first")
    ends = ends.withColumn("flush", F.when(F.coalesce(F.col("first") > F.lag("last").over(overall) + wait, F.lit(True)), F.col("first")))
    # A flush that began in an earlier stretch goes by its first change
    ends = ends.select("bucket", "island", F.last("flush", True).over(overall.rowsBetween(Window.unboundedPreceding, 0)).alias("flush"))
    named = islands.join(ends, ["bucket", "island"], "left").select("bucket", "island", F.coalesce("flush", "first").alias("flush"))
    return rows.join(named, ["bucket", "island"]).groupBy("flush").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("changes"), F.countDistinct(F.lower("path")).alias("paths")).drop("flush")


def latest_per_path(changes: DataFrame) -> DataFrame:
    """What a flush scans: each path once, case ignored."""
    return changes.groupBy(F.lower("path").alias("path")).agg(F.max("ts").alias("ts"), F.count("*").alias("changes"))
