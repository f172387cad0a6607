"""Counts by window: aligned, sliding, session, scaled by density, fired several times, or anchored at the first event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bucket(ts: Column | str, size_ms: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(size_ms))


def tumbling_count(events: DataFrame, size_ms: int, *keys: str, ts: str = "ts_ms") -> DataFrame:
    start = bucket(ts, size_ms)
    return events.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("value")).withColumn("window_end", F.col("window_start") + size_ms)


def sliding_count(events: DataFrame, size_ms: int, slide_ms: int, *keys: str, ts: str = "ts_ms") -> DataFrame:
    """Epoch-aligned windows; each event is in size/slide of them."""
    last = bucket(ts, slide_ms)
    starts = F.filter(F.sequence(last - (size_ms - 1) // slide_ms * slide_ms, last, F.lit(slide_ms)), lambda s: s + size_ms > F.col(ts))
    return events.select(*keys, F.explode(starts).alias("window_start")).groupBy(*keys, "window_start").agg(F.count("*").alias("value")).withColumn("window_end", F.col("window_start") + size_ms)


def scaled_size(base_s: float, factor: float) -> int:
    """Whole seconds, at least one, that a base size shrinks to by a density factor."""
    return max(1, int(base_s / (1 + factor)))


def session_count(events: DataFrame, gap_ms: int, *keys: str, ts: str = "ts_ms") -> DataFrame:
    """Sessions end ``gap_ms`` after their last event; an event exactly then still belongs to them."""
    by = Window.partitionBy(*keys).orderBy(ts)
    new = F.coalesce(F.col(ts) - F.lag(ts).over(by) > gap_ms, F.lit(True)).cast("int")
    marked = events.select(*keys, ts, new.alias("new")).withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "session").agg(F.min(ts).alias("window_start"), (F.max(ts) + gap_ms).alias("window_end"), F.count("*").alias("value")).drop("session")


def density_sizes(events: DataFrame, base_s: int, key: str, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """For each event of a key, in arrival order: running count, density (count by ms since the one before, 1 at least) and
    the size in seconds to which it shrinks a window."""
    by = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(by)
    gap = F.greatest(F.lit(1), F.coalesce(F.col(ts) - F.lag(ts).over(by), F.lit(1)))
    density = n / gap
    return events.select(key, order, ts, n.alias("running"), density.alias("density"), F.greatest(F.lit(1), F.floor(base_s / (1 + density))).cast("int").alias("size_s"))


def multi_trigger_count(events: DataFrame, size_ms: int, every: int, key: str, ts: str = "ingest_ms", order: str = "seq") -> DataFrame:
    """A window fires at every ``every``-th event and at its end, each time with all it holds so far."""
    start = bucket(ts, size_ms)
    by = Window.partitionBy(key, "window_start").orderBy(order)
    rows = events.select(key, order, start.alias("window_start")).withColumn("value", F.row_number().over(by)).withColumn("total", F.count("*").over(Window.partitionBy(key, "window_start")))
    return rows.where((F.col("value") % every == 0) | (F.col("value") == F.col("total"))).select(key, "window_start", (F.col("window_start") + size_ms).alias("window_end"), "value")


def relative_sliding_count(events: DataFrame, size_ms: int, slide_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Windows that start at the first event's time; empty ones are kept."""
    ends = events.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).where("lo is not null")
    starts = ends.select("lo", F.explode(F.sequence("lo", "hi", F.lit(slide_ms))).alias("window_start"))
    k = F.floor((F.col(ts) - F.col("lo")) / slide_ms)
    of = F.filter(F.sequence(F.greatest(k - (size_ms - 1) // slide_ms, F.lit(0)), k), lambda i: F.col("lo") + i * slide_ms + size_ms > F.col(ts))
    hits = events.select(ts).join(F.broadcast(ends), how="inner").select("lo", F.explode(of).alias("i")).select((F.col("lo") + F.col("i") * slide_ms).alias("window_start")).groupBy("window_start").agg(F.count("*").alias("n"))
    return starts.join(hits, "window_start", "left").select("window_start", (F.col("window_start") + size_ms).alias("window_end"), F.coalesce("n", F.lit(0)).alias("value"))


def anchored(events: DataFrame, size_ms: int, key: str, ts: str = "ts_ms", order: str = "seq", delay_ms: int = 0) -> DataFrame:
    """Buffers that open with an event and close once the watermark (largest time so far less ``delay_ms``) is ``max(1000, size)``
    after it; what arrives meanwhile is in them whatever its time, and nothing is dropped. One fold for each key."""
    size = max(1000, size_ms)

    def fold(pdf):
        pdf = pdf.sort_values(order)
        out, first, start, n, high = [], None, 0, 0, None
        for t in pdf[ts].tolist():
            high = t if high is None else max(high, t)
            if n and high - delay_ms >= first + size:
                out.append((start, first, first + size, n))
                n = 0
            if not n:
                first, start = t, start + 1
            n += 1
        if n:
            out.append((start, first, first + size, n))
        return __import__("pandas").DataFrame([(pdf[key].iloc[0], *r) for r in out], columns=[key, "number", "window_start", "window_end", "value"])

    kind = dict(events.dtypes)[key]
    return events.select(key, ts, order).groupBy(key).applyInPandas(fold, f"`{key}` {kind}, number long, window_start long, window_end long, value long")
