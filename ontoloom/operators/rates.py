"""Rates of counters over sliding windows, with resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_rates(points: DataFrame, width_ms: int) -> DataFrame:
    """points (name, seq, timestamp, value) with `increase` and `rate` (per second) over the window of width_ms that ends at each point, its start left out.

    The increase is the sum of the steps between neighbours inside the window; where a counter falls it has begun anew, so the step is its new
    value. A window with one point has an increase of 0; nothing is extrapolated to the window's ends. Ties in time go by seq; null values are left out.

    A series is cut into chunks of time as wide as the window. A chunk holds its own points and those of the chunk before, which carry all that
    its windows need, so no group grows with a series' history.
    """
    own = F.floor(F.col("timestamp") / width_ms)
    spread = points.where("value IS NOT NULL").withColumn("_chunk", F.explode(F.array(own, own + 1)))
    forward = Window.partitionBy("name", "_chunk").orderBy("timestamp", "seq")
    before = F.lag("value").over(forward)
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    stepped = spread.withColumn("_step", step).withColumn("_total", F.sum("_step").over(forward)).drop("_step")
    # A window's first step leads into it from outside, so the total at its first point is taken off. Each own point asks for that total by a
    # second row, at the first time of its window; read backwards, the last total before the asking row is it. No window is gone through again.
    entry = F.struct(F.col("timestamp").alias("_at"), F.lit(0).alias("_asks"), F.col("_total").alias("_given"))
    asking = F.struct((F.col("timestamp") - width_ms + 1).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_given"))
    both = stepped.withColumn("_row", F.explode(F.when(own == F.col("_chunk"), F.array(entry, asking)).otherwise(F.array(entry)))).select("*", "_row.*").drop("_row")
    backward = Window.partitionBy("name", "_chunk").orderBy(F.desc("_at"), "_asks", F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_first", F.last("_given", ignorenulls=True).over(backward)).where("_asks = 1")
    out = out.withColumn("increase", F.greatest(F.lit(0.0), F.col("_total") - F.col("_first")))
    return out.withColumn("rate", F.col("increase") * 1000 / width_ms).drop("_chunk", "_total", "_at", "_asks", "_given", "_first")


def summed_rates(points: DataFrame, width_ms: int, step_ms: int) -> DataFrame:
    """(timestamp, rate): at each multiple of step_ms the sum over all series of the rate at their last point in the step before it; series without one don't count."""
    slot = (F.floor(F.col("timestamp") / step_ms) + 1) * step_ms
    rated = counter_rates(points, width_ms).groupBy("name", slot.alias("slot")).agg(F.max(F.struct("timestamp", "seq", "rate"))["rate"].alias("rate"))
    return rated.groupBy(F.col("slot").alias("timestamp")).agg(F.sum("rate").alias("rate"))
