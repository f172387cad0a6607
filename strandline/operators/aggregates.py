"""Densities, rates, latencies, profiles of a stream, and quality figures of tables and models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .windows import bucket

GLOBAL_AREA = math.pi * 1.2**2


def latency_histogram(rows: DataFrame, value: str, *keys: str, quantiles=(0.5, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Count, extremes, mean, sample deviation and quantiles at index round(q (n - 1)) of a column.

    The exact form ranks rows within their key; ``exact=False`` uses a sketch of bounded size instead."""
    plain = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev")]
    name = lambda q: f"p{round(q * 100)}"
    if not exact:
        return rows.groupBy(*keys).agg(*plain, *(F.percentile_approx(value, q).alias(name(q)) for q in quantiles))
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    at = [F.max(F.when(F.col("_i") == F.floor(q * (F.col("_n") - 1) + 0.5), F.col(value))).alias(name(q)) for q in quantiles]
    return ranked.groupBy(*keys).agg(*plain, *at)


def per_region(hits: DataFrame, regions: DataFrame, t0: int, t1: int, ts: str = "ts_ms") -> DataFrame:
    """Events of each region between two times, both included; regions without any are kept. A missing area counts as 1."""
    n = hits.where(F.col(ts).between(t0, t1)).groupBy("region_id").agg(F.count("*").alias("n"))
    out = regions.join(n, "region_id", "left").withColumn("value", F.coalesce("n", F.lit(0)))
    return out.select("region_id", "value", (F.col("value") / F.coalesce("area", F.lit(1.0))).alias("density"))


def hotspots(densities: DataFrame, threshold: float) -> DataFrame:
    return densities.where(F.col("density") >= threshold)


def global_density(events: DataFrame) -> DataFrame:
    return events.agg((F.count("*") / GLOBAL_AREA).alias("density"))


def rate_over_time(events: DataFrame, size_ms: int, ts: str = "ts_ms") -> DataFrame:
    return events.groupBy(bucket(ts, size_ms).alias("window_start")).agg((F.count("*") / (size_ms / 1000.0)).alias("events_per_s"))


def count_between(events: DataFrame, t0: int, t1: int, ts: str = "ts_ms") -> DataFrame:
    n = F.count_if(F.col(ts).between(t0, t1))
    return events.agg(n.alias("value"), (n / max((t1 - t0) / 1000.0, 1e-9)).alias("events_per_s"))


def active_mean_speed(trajectories: DataFrame, t0: int, t1: int) -> DataFrame:
    """Unweighted mean speed of the trajectories that overlap an interval."""
    return trajectories.where((F.col("start_ms") <= t1) & (F.col("end_ms") >= t0)).agg(F.coalesce(F.avg("mean_speed"), F.lit(0.0)).alias("mean_speed"))


def arrival_gaps(events: DataFrame, key: str = "object_id", ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    by = Window.partitionBy(key).orderBy(ts, order)
    return events.select(key, order, (F.col(ts) - F.lag(ts).over(by)).alias("gap_ms")).where("gap_ms is not null")


def disorder(events: DataFrame, key: str, delay_ms: int, ts: str = "ts_ms", order: str = "seq", arrival: str = "ingest_ms") -> DataFrame:
    """By key: events, those before the largest time so far, those behind the watermark (that time less a delay), ratios, latency."""
    high = F.max(ts).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = events.select(key, ts, arrival, high.alias("high"))
    n, bad, late = F.count("*"), F.count_if(F.col(ts) < F.col("high")), F.count_if(F.col(ts) < F.col("high") - delay_ms)
    return rows.groupBy(key).agg(n.alias("events"), bad.alias("out_of_order"), late.alias("late"), (bad / n).alias("disorder_ratio"), (late / n).alias("late_ratio"), F.avg(F.col(arrival) - F.col(ts)).alias("mean_latency_ms"))


def with_high(rows: DataFrame, block: int = 1 << 16, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """The rows with ``high``, the largest time of all rows before in order of arrival: it comes from the blocks of arrival
    numbers before, of which only one row each is ordered as a whole, and from the block itself."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    tops = rows.groupBy("_block").agg(F.max(ts).alias("_top"))
    tops = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(ts).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(tops, "_block").withColumn("high", F.greatest("_before", "_inside")).drop("_block", "_inside", "_before")


def disorder_overall(events: DataFrame, delay_ms: int, block: int = 1 << 16, ts: str = "ts_ms", arrival: str = "ingest_ms", order: str = "seq") -> DataFrame:
    """As ``disorder``, for all events together. An empty table gives no row."""
    rows = with_high(events.select(ts, arrival, order), block, ts, order)
    n, bad, late = F.count("*"), F.count_if(F.col(ts) < F.col("high")), F.count_if(F.col(ts) < F.col("high") - delay_ms)
    out = rows.agg(n.alias("events"), bad.alias("out_of_order"), late.alias("late"), F.avg(F.col(arrival) - F.col(ts)).alias("mean_latency_ms")).where("events > 0")
    return out.select("events", "out_of_order", "late", (F.col("out_of_order") / F.col("events")).alias("disorder_ratio"), (F.col("late") / F.col("events")).alias("late_ratio"), "mean_latency_ms")


def moving_average(events: DataFrame, key: str, value: Column, alpha: float = 0.1, order: str = "seq") -> DataFrame:
    """Exponential moving average in arrival order; a state of zero counts as unset. One fold for each key, of values only."""
    rows = events.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), value.cast("double").alias("v")))), lambda x: x["v"]).alias("v"))
    return rows.select(key, F.aggregate("v", F.lit(0.0), lambda s, x: F.when(s == 0, x).otherwise(alpha * x + (1 - alpha) * s)).alias("ema"))


def recent_rate(events: DataFrame, span_ms: int = 5000, arrival: str = "ingest_ms") -> DataFrame:
    """Arrivals within the span that ends at each whole second, by second."""
    second = F.explode(F.sequence(F.floor(F.col(arrival) / 1000), F.floor((F.col(arrival) + span_ms - 1) / 1000)))
    return events.select(second.alias("s")).groupBy("s").agg((F.count("*") / (span_ms / 1000.0)).alias("events_per_s"))


def oscillation(decisions: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of a controlled value: decisions, changes, flips of direction from one decision to the next, bounds, and the mean step of
    ``order``. The first decision goes up from zero without being a change, one that changes nothing has no direction."""
    by = Window.partitionBy(key).orderBy(order)
    last = F.coalesce(F.lag(value).over(by), F.lit(0))
    rows = decisions.select(key, order, value, last.alias("last"), F.signum(F.col(value) - last).alias("d")).withColumn("before", F.lag("d").over(by))
    n = F.count("*")
    figures = {"decisions": n, "changes": F.count_if((F.col("last") != 0) & (F.col("d") != 0)), "flips": F.count_if(F.col("d") * F.col("before") < 0), "lowest": F.min(value), "highest": F.max(value)}
    step = F.when(n > 1, (F.max(order) - F.min(order)) / (n - 1)).otherwise(0.0)
    return rows.groupBy(key).agg(*(c.alias(k) for k, c in figures.items()), step.alias("mean_step"))


def by_experiment(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each figure; columns are named figure_statistic."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return metrics.groupBy(*keys).agg(*(f(v).alias(f"{v}_{s}") for v in values for s, f in stats.items()))


def compare_modes(metrics: DataFrame, key: str, means: list[str], maxima: list[str], digits: int = 3) -> DataFrame:
    """By mode: the means of some figures and the maxima of others, rounded, under the figures' own names."""
    figures = [F.avg(c).alias(c) for c in means] + [F.max(c).alias(c) for c in maxima]
    return metrics.groupBy(key).agg(*figures).select(key, *(F.round(c, digits).alias(c) for c in [*means, *maxima]))


# What an experiment's summary is named by, and its figures with their titles.
SUMMARY_KEYS = ["mode", "profile", "rate_pattern", "motion_mode", "window_size_ms", "watermark_delay_ms"]
SUMMARY = {
    "total_events_max": "Total Events",
    "total_interactions_max": "Total Interactions",
    "event_rate_mean": "Avg Event Rate",
    "avg_latency_ms_mean": "Avg Latency (ms)",
    "processing_latency_ms_mean": "Avg Processing (ms)",
    "ml_inference_ms_mean": "Avg ML Inference (ms)",
    "interaction_rate_mean": "Interaction Rate",
    "collision_count_max": "Collisions",
    "proximity_count_max": "Proximity Events",
    "swarm_count_max": "Swarms",
    "conflict_count_max": "Conflicts",
    "adaptation_count_max": "Adaptations",
    "window_oscillation_max": "Window Oscillations",
    "watermark_oscillation_max": "Watermark Oscillations",
    "window_change_rate_mean": "Window Change Rate",
    "watermark_change_rate_mean": "Watermark Change Rate",
}


def experiment_summary(experiments: DataFrame) -> DataFrame:
    """The keys and those figures of SUMMARY that ``by_experiment`` gave, under their titles."""
    return experiments.select(*SUMMARY_KEYS, *(F.col(c).alias(title) for c, title in SUMMARY.items() if c in experiments.columns))


def coverage(rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Share of all combinations of allowed values that occur, in percent."""
    total = math.prod(len(v) for v in columns.values())
    ok = [F.col(c).isin(v) for c, v in columns.items()]
    for x in ok:
        rows = rows.where(x)
    return rows.select(*columns).distinct().agg((100.0 * F.count("*") / total).alias("coverage"))


def table_quality(rows: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows, repeated keys, nulls and values out of range of each column."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ranges]
    bad = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_out") for c, (lo, hi) in ranges.items()]
    return rows.agg(F.count("*").alias("row_count"), (F.count("*") - F.count_distinct(*keys)).alias("repeated"), *nulls, *bad)


def regression_quality(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    error, y = F.col(truth) - F.col(guess), F.col(truth)
    mse = F.avg(error * error)
    return rows.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"), (1 - F.sum(error * error) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def parity(rows: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-7) -> DataFrame:
    """Differences of two columns, and whether all are within tolerance."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"), F.every(d <= atol + rtol * F.abs(F.col(b))).alias("all_close"))


def shares(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Each value as a percentage of the sum, largest first."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).select(name, (100.0 * F.col(value) / F.col("_total")).alias("percent")).orderBy(F.desc("percent"), name)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    return rows.where(F.col(value).between(low, high)).groupBy(*keys, F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def box_statistics(rows: DataFrame, value: str, *keys: str, reach: float = 1.5) -> DataFrame:
    """What a box plot draws: number, quartiles, the outermost values within ``reach`` quartile distances of the box, and the
    number of those beyond. Nulls are left out; quartiles are exact and interpolated."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    boxes = rows.groupBy(*keys).agg(*(F.percentile("_x", q).alias(k) for k, q in quartiles.items()))
    far = reach * (F.col("q3") - F.col("q1"))
    inside = F.col("_x").between(F.col("q1") - far, F.col("q3") + far)
    by = [*keys, *quartiles]
    joined = rows.join(boxes, list(keys)) if keys else rows.crossJoin(boxes)
    ends = [F.min(F.when(inside, F.col("_x"))).alias("low"), F.max(F.when(inside, F.col("_x"))).alias("high")]
    return joined.groupBy(*by).agg(F.count("*").alias("n"), *ends, F.count_if(~inside).alias("outliers"))


def compared(a: DataFrame, b: DataFrame, name: str, value: str) -> DataFrame:
    """Two models' percentages of each feature, side by side."""
    x, y = shares(a, name, value).withColumnRenamed("percent", "percent_a"), shares(b, name, value).withColumnRenamed("percent", "percent_b")
    return x.join(y, name, "full").na.fill(0.0)


def observed(rows: DataFrame, name: str | Observation, ts: str = "ts_ms", arrival: str = "ingest_ms", bounds: tuple[int, ...] = ()) -> DataFrame:
    """The rows, with gauges that Spark reports for each batch or action: count, latency and largest time; with ``bounds``, also
    a cumulative histogram: how many rows have a latency of each bound at most (``latency_le_<bound>``)."""
    latency = F.col(arrival) - F.col(ts)
    buckets = [F.count_if(latency <= b).alias(f"latency_le_{b}") for b in bounds]
    return rows.observe(name, F.count(F.lit(1)).alias("events"), F.avg(latency).alias("mean_latency_ms"), F.max(ts).alias("max_ts"), *buckets)
