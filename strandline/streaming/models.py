"""Stream models and window strategies on Structured Streaming: four notions of time, four ways to cut windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import bucket, scaled_size

MODELS, STRATEGIES = ("dataflow", "microbatch", "actor", "log"), ("adaptive", "dynamic", "multitrigger", "session")


def with_time(events: DataFrame, model: str, bound_ms: int = 2000) -> DataFrame:
    """Adds ``ts``: event time with a bounded watermark (dataflow), event time of what is at most 5 s behind the wall clock
    (microbatch), or the time of arrival (actor, log)."""
    event = F.timestamp_millis("ts_ms")
    if model == "dataflow":
        return events.withColumn("ts", event).withWatermark("ts", f"{bound_ms} milliseconds")
    if model == "microbatch":
        return events.withColumn("ts", event).where(F.col("ts") >= F.current_timestamp() - F.expr("INTERVAL 5 SECONDS")).withWatermark("ts", "5 seconds")
    if model in ("actor", "log"):
        return events.withColumn("ts", F.current_timestamp()).withWatermark("ts", "0 seconds")
    raise ValueError(f"unknown model {model!r}")


def bounded_time(events: DataFrame, bound_ms: int) -> DataFrame:
    """Event times in the future count as now."""
    return events.withColumn("ts", F.least(F.timestamp_millis("ts_ms"), F.current_timestamp())).withWatermark("ts", f"{bound_ms} milliseconds")


def counts(events: DataFrame, strategy: str, key: str, size_s: int = 10, factor: float = 0.0) -> DataFrame:
    """Counts by key and window, from the output of ``with_time``. Adaptive sizes never reach window assignment, so that strategy
    equals dynamic with factor 0; multitrigger is the same aggregate in update mode with a processing-time trigger."""
    if strategy == "session":
        window = F.session_window("ts", f"{size_s} seconds")
    elif strategy in ("dynamic", "adaptive", "multitrigger"):
        window = F.window("ts", f"{scaled_size(size_s, factor if strategy == 'dynamic' else 0.0)} seconds")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = events.groupBy(key, window.alias("w")).agg(F.count("*").alias("value"))
    return out.select(key, F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), "value")


def sliding_counts(events: DataFrame, key: str, size_s: int, slide_s: int) -> DataFrame:
    """Counts by key and epoch-aligned sliding window, from the output of ``with_time``."""
    out = events.groupBy(key, F.window("ts", f"{size_s} seconds", f"{slide_s} seconds").alias("w")).agg(F.count("*").alias("value"))
    return out.select(key, F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), "value")


def counts_every(events: DataFrame, key: str, size_ms: int, every: int, delay_ms: int = 0) -> DataFrame:
    """Tumbling windows that fire at every ``every``-th event and, unless that was the last, once the watermark passes their end;
    each time with all they hold so far. State is one count a window."""

    def step(k, batches, state: GroupState):
        end, before = int(k[1]) + size_ms, state.get[0] if state.exists else 0
        n = before if state.hasTimedOut else before + sum(len(b) for b in batches)
        fired = list(range(before // every * every + every, n + 1, every))
        if state.hasTimedOut or end <= state.getCurrentWatermarkMs():
            fired += [n] if n % every else []
            if state.exists:
                state.remove()
        else:
            state.update((n,))
            state.setTimeoutTimestamp(end)
        if fired:
            yield pd.DataFrame({key: k[0], "window_start": k[1], "window_end": end, "value": fired})

    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{delay_ms} milliseconds")
    rows = timed.select(key, bucket("ts_ms", size_ms).alias("window_start"), "ts")
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key, "window_start").applyInPandasWithState(step, f"`{key}` {kind}, window_start long, window_end long, value long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def pipeline(events: DataFrame, model: str, strategy: str, key: str, **options) -> DataFrame:
    return counts(with_time(events, model), strategy, key, **options)


OUTPUT_MODE = {"adaptive": "append", "dynamic": "append", "multitrigger": "update", "session": "append"}


def anchored_windows(events: DataFrame, key: str, size_ms: int, delay_ms: int = 0) -> DataFrame:
    """Windows that open with a key's first event and close when the watermark passes the size (1 s at least) after it. All that has
    arrived by then is in them; the next event opens the next. State is a count and two times."""
    size = max(1000, size_ms)

    def step(k, batches, state: GroupState):
        first, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            yield pd.DataFrame({key: [k[0]], "window_start": [first], "window_end": [first + size], "value": [n]})
            state.remove()
            return
        for b in batches:
            for t in b["ts_ms"].tolist():
                first = t if n == 0 else first
                n += 1
        if n:
            end = first + size
            if end <= state.getCurrentWatermarkMs():
                yield pd.DataFrame({key: [k[0]], "window_start": [first], "window_end": [end], "value": [n]})
                state.remove()
            else:
                state.update((first, n))
                state.setTimeoutTimestamp(end)

    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{delay_ms} milliseconds")
    kind = dict(events.dtypes)[key]
    return timed.select(key, "ts_ms", "ts").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, window_start long, window_end long, value long", "first long, n long", "append", GroupStateTimeout.EventTimeTimeout)
