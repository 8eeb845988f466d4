"""Time series, percentiles and anomalies over metric points (name, seq, timestamp in ms, value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut

WINDOWS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def window_ms(name: str | None) -> int:
    """Milliseconds of a window's name; an hour by default."""
    key = (name or "hour").lower()
    if key not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; expected one of {sorted(WINDOWS)}")
    return WINDOWS[key]


def tumbling(points: DataFrame, window: str | None = None) -> DataFrame:
    """Aggregates by buckets of (timestamp div width) * width: division truncates, and weeks start on Thursdays like the epoch."""
    width = window_ms(window)
    bucket = F.expr(f"(timestamp div {width}) * {width}")
    return points.groupBy("name", bucket.alias("bucket")).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value"), F.count("*").alias("n"))


#: Points of a series that one window orders: a series is cut at multiples of this in seq.
CHUNK = 1 << 16


def _in_chunks(points: DataFrame, n: int) -> DataFrame:
    """points with chunk, and carried copies of the last n points before each chunk, so that windows by (name, chunk) see across its start.

    seq is unique in a series, so a chunk has CHUNK points at most; what is carried is a list of n points for each chunk.
    """
    points = points.select("name", "seq", "timestamp", "value").withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    point = F.struct("seq", "timestamp", "value")
    if n == 1:
        tails = points.groupBy("name", "chunk").agg(F.array(F.max(point)).alias("tail"))
    else:
        from_end = F.row_number().over(Window.partitionBy("name", "chunk").orderBy(F.desc("seq")))
        tails = points.withColumn("k", from_end).where(F.col("k") <= n).groupBy("name", "chunk").agg(F.sort_array(F.collect_list(point), asc=False).alias("tail"))
    before = Window.partitionBy("name").orderBy("chunk").rowsBetween(-n, -1)
    carried = tails.withColumn("tail", F.slice(F.sort_array(F.flatten(F.collect_list("tail").over(before)), asc=False), 1, n))
    carried = carried.select("name", "chunk", F.explode("tail").alias("p")).select("name", "p.seq", "p.timestamp", "p.value", "chunk", F.lit(True).alias("carried"))
    return points.withColumn("carried", F.lit(False)).unionByName(carried)


def moving_average(points: DataFrame, n: int) -> DataFrame:
    """The mean of the last n points in arrival order, for full windows only; none for n < 1."""
    if n < 1:
        return points.select("name", "seq", F.col("value").alias("moving_avg")).limit(0)
    last = Window.partitionBy("name", "chunk").orderBy("seq").rowsBetween(1 - n, 0)
    rows = (_in_chunks(points, n - 1) if n > 1 else _in_chunks(points, 1)).withColumns({"moving_avg": F.avg("value").over(last), "n": F.count("*").over(last)})
    return rows.where((F.col("n") == n) & ~F.col("carried")).select("name", "seq", "moving_avg")


def rate_of_change(points: DataFrame) -> DataFrame:
    """Change per second against the point before; points that aren't later than it are left out."""
    order = Window.partitionBy("name", "chunk").orderBy("seq")
    step = F.col("timestamp") - F.lag("timestamp").over(order)
    change = F.col("value") - F.lag("value").over(order)
    rows = _in_chunks(points, 1).withColumns({"dt": step, "dv": change}).where((F.col("dt") > 0) & ~F.col("carried"))
    return rows.select("name", "seq", (F.col("dv") / (F.col("dt") / 1000)).alias("rate"))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """sorted[round(p / 100 * (n - 1))], halves away from zero; null for none."""
    at = F.round(F.lit(p / 100) * (F.size(sorted_values) - 1)).cast("int") + 1
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, F.greatest(at, F.lit(1))))


#: Ranges of values that are counted before the one that holds a rank is opened.
RANGES = 1024


def _values_at(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and, for each name, the value at a rank from 1 of a group's n values; ranks: from n to the rank. Null for a rank below 1.

    Values are counted, and the counts summed by RANGES equal ranges between a group's least and largest value; only the ranges that
    hold a wanted rank are put in order. So no task orders a whole group, unless nearly all its distinct values lie in one range.
    """
    number = F.col(value).cast("double")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    counts = cut(counts)
    span = cut(counts.groupBy(*keys).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.sum("c").alias("n")))  # small ones are broadcast, as their size is known
    share = F.try_divide(number - F.col("low"), F.col("high") - F.col("low"))
    placed = _with(counts, span, keys).withColumn("range", F.coalesce(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)), F.lit(0)))
    sums = placed.groupBy(*keys, "range").agg(F.sum("c").alias("inside"), F.first("n").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
    holds = reduce(lambda a, b: a | b, [(F.col("before") < r(F.col("n"))) & (r(F.col("n")) <= F.col("before") + F.col("inside")) for r in ranks.values()])
    opened = _with(placed, cut(sums.where(holds).select(*keys, "range", "before")), [*keys, "range"])
    opened = opened.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "range").orderBy(value)))
    found = opened.groupBy(*keys).agg(*[F.min(F.when((F.col("upto") >= r(F.col("n"))) & (r(F.col("n")) > 0), F.col(value))).alias(k) for k, r in ranks.items()])
    return _with(span.select(*keys), found, keys, "left")


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys, of which nulls are equal."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*[f"_{k}" for k in keys])


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles by group, sorted[round(p / 100 * (n - 1))]; see _values_at."""
    rank = lambda p: lambda n: F.round(F.lit(p / 100) * (n - 1)).cast("long") + 1
    return _values_at(rows, keys, value, {f"p{p}": rank(p) for p in ps})


def retained(rows: DataFrame, keys: list[str], cap: int = 10_000, drop: int = 1_000) -> DataFrame:
    """The rows that a buffer keeps which drops its oldest `drop` rows, by seq, whenever it holds more than `cap`; seq is unique in a group."""
    chunk, group = F.expr(f"seq div {CHUNK}"), Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, chunk.alias("chunk")).agg(F.count("*").alias("inside"))
    later = group.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"n": F.sum("inside").over(group), "later": F.coalesce(F.sum("inside").over(later), F.lit(0))})
    gone = F.when(F.col("n") > cap, F.ceil((F.col("n") - cap) / F.lit(drop)) * drop).otherwise(F.lit(0))
    # Of a group only the chunks in which its last rows lie are put in order, cap + CHUNK rows at most.
    last = sums.withColumn("left", F.col("n") - gone).where("later < left").select(*keys, "chunk", "left")
    near = _with(rows.withColumn("chunk", chunk), last, [*keys, "chunk"])
    return near.withColumn("k", F.row_number().over(group.orderBy(F.desc("seq")))).where("k <= left").drop("k", "left", "chunk")


def query_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """total, avg and percentiles of duration (retained rows), error_rate (all rows) of rows (keys, seq, duration, failed)."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.avg(F.col("failed").cast("double")).alias("error_rate"))
    each = retained(rows, keys).groupBy(*keys).agg(F.avg("duration").alias("avg_duration"), F.array_sort(F.collect_list("duration")).alias("v"))  # the buffer's cap bounds a group
    spread = each.select(*keys, "avg_duration", *[nearest_rank(F.col("v"), p).alias(f"p{p}") for p in (50, 95, 99)])
    return _with(totals, spread, keys)


def performance(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, upper median sorted[n / 2] and count by group."""
    middle = _values_at(rows, keys, value, {"median": lambda n: F.call_function("div", n, F.lit(2)) + 1})
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n"))
    return _with(stats, middle, keys, "left")


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts") -> DataFrame:
    """(keys, start, n): events that follow each other within the gap are one session."""
    w = F.session_window(F.col(time), gap)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def audit(events: DataFrame, since: Column, until: Column, kind: str, time: str = "ts") -> DataFrame:
    """(day, kind, n) of the events from since up to and without until."""
    inside = events.where((F.col(time) >= since) & (F.col(time) < until))
    return inside.groupBy(F.to_date(time).alias("day"), kind).agg(F.count("*").alias("n"))


def slow_rows(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where(F.col("duration") > threshold)


def z_score_anomalies(points: DataFrame, threshold: float = 2.0, at_least: int = 10) -> DataFrame:
    """Points more than `threshold` population deviations from their series' mean; series of fewer than at_least points or without spread have none."""
    stats = points.groupBy("name").agg(F.avg("value").alias("expected"), F.stddev_pop("value").alias("std"), F.count("*").alias("n")).where((F.col("n") >= at_least) & (F.col("std") > 0))
    z = F.abs(F.col("value") - F.col("expected")) / F.col("std")
    found = points.join(stats, "name").withColumn("z", z).where(F.col("z") > threshold)
    level = F.when(F.col("z") > 2 * threshold, "critical").when(F.col("z") > 1.5 * threshold, "high").when(F.col("z") > 1.2 * threshold, "medium").otherwise("low")
    return found.select("name", "seq", "value", "expected", "z", level.alias("severity"))


def sudden_changes(points: DataFrame, percent: float) -> DataFrame:
    """Points that differ from the point before by more than `percent` per cent; a previous value of 0 is skipped."""
    before = F.lag("value").over(Window.partitionBy("name", "chunk").orderBy("seq"))
    rows = _in_chunks(points, 1).withColumn("before", before).where((F.col("before") != 0) & ~F.col("carried"))
    rows = rows.withColumn("change", F.abs((F.col("value") - F.col("before")) / F.col("before")) * 100).where(F.col("change") > percent)
    level = F.when(F.col("change") > 2 * percent, "critical").when(F.col("change") > 1.5 * percent, "high").otherwise("medium")
    return rows.select("name", "seq", "before", "value", "change", level.alias("severity"))


def peer_outliers(rows: DataFrame, group: str, value: str, sigmas: float = 2.5) -> DataFrame:
    """Rows further than `sigmas` population deviations from the mean of their group."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).where(F.col("std") > 0)
    return rows.join(stats, group).where(F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("std"))


def sliding_rate(events: DataFrame, width: str, slide: str, time: str = "ts") -> DataFrame:
    """Events per second by sliding windows."""
    w = F.window(F.col(time), width, slide)
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))
