"""The feedback loop: each micro-batch is profiled and searched for interactions, and may change window and watermark."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, control, interactions as inter
from .totals import Totals, batch_totals


def profile(events: DataFrame, window_ms: int, delay_ms: int, watermark_ms: int | None = None) -> DataFrame:
    """One row: events, objects, rate, disorder, lateness, latency, events a window, the fill of windows, and how far the
    watermark (by default that of these events alone) is behind the latest event."""
    d = agg.disorder_overall(events, delay_ms)
    size = events.agg(F.count_distinct("object_id").alias("objects"), F.count_distinct(F.col("ts_ms") - F.pmod("ts_ms", F.lit(window_ms))).alias("windows"), ((F.max("ingest_ms") - F.min("ingest_ms")) / 1000.0).alias("seconds"), F.max("ts_ms").alias("max_ts"))
    rate = F.col("events") / F.greatest("seconds", F.lit(1.0))
    out = d.crossJoin(size).withColumn("event_rate", rate).withColumn("events_per_window", F.col("events") / F.greatest("windows", F.lit(1)))
    return out.withColumn("window_fill_ratio", F.col("events_per_window") / (F.col("event_rate") * window_ms / 1000.0)).withColumn("watermark_lag_ms", F.greatest(F.lit(0), F.col("max_ts") - F.coalesce(F.lit(watermark_ms), F.col("max_ts") - delay_ms)))


def interaction_counts(found: DataFrame) -> dict[str, int]:
    """How many interactions there are of each kind, and of all kinds."""
    n = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    return {f"{k.lower()}_count": n.get(k, 0) for k in ("Collision", "Proximity", "Conflict", "Swarm")} | {"interaction_count": sum(n.values())}


def metric_line(row: dict) -> str:
    """[METRIC] k=v ..., figures with up to four decimals. The running figures have their own, ``Totals.line``."""
    return "[METRIC] " + " ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.items())


@dataclass
class Loop:
    """For ``foreachBatch``. ``predict`` gives (window, delay) from a profile of the batch with the running figures of the
    stream, in which all numeric features of ``control`` are. Results go to ``sink``, one metrics row a batch to ``metrics``
    (bounded by the caller, e.g. a deque), the metrics line to ``log``."""

    predict: Callable[[dict], tuple[float, float]]
    sink: Callable[[DataFrame, int], None]
    runtime: control.Runtime = field(default_factory=control.Runtime)
    metrics: list = field(default_factory=list)
    totals: Totals = field(default_factory=Totals)
    log: Callable[[str], None] | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        began = time.perf_counter()
        found = inter.all_interactions(inter.windowed(batch, max(1000, self.runtime.window_ms))).persist()
        try:
            self._step(batch, found, number, began)
        finally:
            found.unpersist()

    def _step(self, batch: DataFrame, found: DataFrame, number: int, began: float) -> None:
        totals, width = self.totals, max(1000, self.runtime.window_ms)
        row = profile(batch, width, self.runtime.delay_ms, totals.watermark).first().asDict()
        counts = interaction_counts(found)
        of_batch = batch_totals(batch, width, totals.latest, totals.watermark).first().asDict()
        totals.add(of_batch, counts, (time.perf_counter() - began) * 1000)
        row |= totals.figures() | {f"batch_{k}": n for k, n in counts.items()} | {"interaction_count": totals.found["interaction"]}
        asked = time.perf_counter()
        window, delay = self.predict(row)
        lo, hi = control.WINDOW_BOUNDS
        window = int(min(max(window, lo), hi))
        delay = int(min(max(delay, control.DELAY_BOUNDS[0]), control.DELAY_BOUNDS[1]))
        totals.decide(window, delay, (time.perf_counter() - asked) * 1000)
        totals.watermark = max(totals.watermark or 0, totals.latest - self.runtime.delay_ms)
        changed = self.runtime.update(window, delay, row["max_ts"])
        self.metrics.append(row | totals.figures() | {"batch": number, "changed": changed, "window_ms": self.runtime.window_ms, "delay_ms": self.runtime.delay_ms})
        if self.log:
            self.log(totals.line())
        self.sink(found, number)
