"""Running figures of a stream across its micro-batches: a few numbers on the driver, fed by one aggregate row a batch."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, control

RATE_MS = 5000
KINDS = ("collision", "proximity", "swarm", "conflict")
# The keys of a metrics line, in order, each with its format.
LINE = {
    "event_rate": ".2f",
    "disorder_ratio": ".4f",
    "late_event_ratio": ".4f",
    "avg_latency_ms": ".2f",
    "window_fill_ratio": ".4f",
    "avg_events_per_window": ".2f",
    "interaction_rate": ".4f",
    "collision_rate": ".4f",
    "proximity_rate": ".4f",
    "swarm_rate": ".4f",
    "conflict_rate": ".4f",
    "watermark_lag_ms": "d",
    "ingestion_lag_ms": "d",
    "processing_latency_ms": ".2f",
    "ml_inference_ms": ".3f",
    "adaptive_window_ms": "d",
    "adaptive_watermark_ms": "d",
    "collision_count": "d",
    "proximity_count": "d",
    "swarm_count": "d",
    "conflict_count": "d",
    "total_events": "d",
    "total_interactions": "d",
    "adaptation_count": "d",
    "window_change_rate": ".4f",
    "watermark_change_rate": ".4f",
    "window_oscillation": "d",
    "watermark_oscillation": "d",
    "window_oscillation_rate": ".4f",
    "watermark_oscillation_rate": ".4f",
    "min_window_ms": "d",
    "max_window_ms": "d",
    "min_watermark_ms": "d",
    "max_watermark_ms": "d",
    "avg_adaptation_interval_ms": ".2f",
}
# The figures of a snapshot, in order.
SNAPSHOT = ["profile", "rate_pattern", "motion_mode", "event_rate", "disorder_ratio", "late_event_ratio", "avg_latency_ms", "window_fill_ratio", "interaction_rate", "collision_rate", "proximity_rate", "swarm_rate", "conflict_rate", "watermark_lag_ms", "processing_latency_ms", "ml_inference_ms", "ingestion_lag_ms", "adaptive_window_ms", "adaptive_watermark_ms", "timestamp"]


def batch_totals(events: DataFrame, window_ms: int, latest: int | None = None, watermark: int | None = None) -> DataFrame:
    """One row for (seq, ts_ms, ingest_ms) rows: events, those before the largest time so far (``latest``: of batches before),
    those behind the watermark, the sum of their latencies (none below 0), the largest time, windows. No events: no row."""
    rows = agg.with_high(events.select("ts_ms", "ingest_ms", "seq"))
    before = F.col("ts_ms") < F.greatest("high", F.lit(latest).cast("long"))
    window = F.col("ts_ms") - F.pmod("ts_ms", F.lit(window_ms))
    figures = {
        "events": F.count("*"),
        "out_of_order": F.count_if(before),
        "late": F.count_if(F.col("ts_ms") < F.lit(watermark).cast("long")),
        "latency_ms": F.sum(F.greatest(F.col("ingest_ms") - F.col("ts_ms"), F.lit(0).cast("long"))),
        "latest": F.max("ts_ms"),
        "windows": F.count_distinct(window),
    }
    return rows.agg(*(c.alias(k) for k, c in figures.items())).where("events > 0")


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


@dataclass
class Moves:
    """One controlled value over its decisions, as ``aggregates.oscillation`` has it."""

    value: int
    changes: int = 0
    flips: int = 0
    _last: int = 0
    _direction: int = 0

    def __post_init__(self) -> None:
        self.low = self.high = self.value

    def to(self, value: int) -> None:
        direction = (value > self._last) - (value < self._last)
        self.changes += bool(self._last and direction)
        self.flips += direction * self._direction < 0
        self.value = self._last = value
        self.low, self.high, self._direction = min(self.low, value), max(self.high, value), direction


@dataclass
class Totals:
    """State of the whole stream. ``clock``: milliseconds of processing time."""

    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    modes: dict = field(default_factory=lambda: {"profile": "mixed", "rate_pattern": "constant", "motion_mode": "random_walk"})
    window: Moves = field(default_factory=lambda: Moves(control.FIXED_WINDOW))
    delay: Moves = field(default_factory=lambda: Moves(control.FIXED_DELAY))
    watermark: int | None = None

    def __post_init__(self) -> None:
        self.sums = dict.fromkeys(("events", "out_of_order", "late", "latency_ms", "windows", "batches", "processing_ms", "decisions", "inference_ms"), 0)
        self.found = dict.fromkeys(("interaction", *KINDS), 0)
        self.latest: int | None = None
        self.decided: tuple[int, int] | None = None  # times of the first and the last decision
        self._recent: deque = deque()

    def add(self, batch: dict, found: dict[str, int], processing_ms: float) -> None:
        """A row of ``batch_totals``, interactions as ``loop.interaction_counts`` gives them, and how long it all took."""
        for k in ("events", "out_of_order", "late", "latency_ms", "windows"):
            self.sums[k] += batch[k]
        for k in self.found:
            self.found[k] += found.get(f"{k}_count", 0)
        self.sums["batches"] += 1
        self.sums["processing_ms"] += processing_ms
        self.latest = batch["latest"] if self.latest is None else max(self.latest, batch["latest"])
        self._recent.append((self.clock(), batch["events"]))

    def decide(self, window_ms: int, delay_ms: int, inference_ms: float) -> None:
        now = self.clock()
        self.decided = (self.decided[0] if self.decided else now, now)
        self.sums["decisions"] += 1
        self.sums["inference_ms"] += inference_ms
        self.window.to(window_ms)
        self.delay.to(delay_ms)

    def event_rate(self) -> float:
        """Events a second of the batches of the last ``RATE_MS``."""
        while self._recent and self.clock() - self._recent[0][0] > RATE_MS:
            self._recent.popleft()
        return sum(n for _, n in self._recent) * 1000 / RATE_MS

    def figures(self) -> dict:
        """All of ``LINE`` and ``SNAPSHOT``."""
        s, now, rate = self.sums, self.clock(), self.event_rate()
        each, n = _ratio(s["events"], s["windows"]), s["decisions"]
        lag = 0 if self.latest is None or self.watermark is None else max(0, self.latest - self.watermark)
        out = dict(self.modes) | {"timestamp": now, "event_rate": rate, "disorder_ratio": _ratio(s["out_of_order"], s["events"]), "late_event_ratio": _ratio(s["late"], s["events"])}
        out |= {"avg_latency_ms": _ratio(s["latency_ms"], s["events"]), "avg_events_per_window": each, "window_fill_ratio": each / (rate * self.window.value / 1000 or 1.0)}
        out |= {"watermark_lag_ms": lag, "ingestion_lag_ms": 0 if self.latest is None else max(0, now - self.latest), "total_events": s["events"]}
        out |= {"processing_latency_ms": _ratio(s["processing_ms"], s["batches"]), "ml_inference_ms": _ratio(s["inference_ms"], n), "total_interactions": self.found["interaction"], "interaction_rate": _ratio(self.found["interaction"], s["events"])}
        out |= {f"{k}_count": self.found[k] for k in KINDS} | {f"{k}_rate": _ratio(self.found[k], self.found["interaction"]) for k in KINDS}
        out |= {"adaptation_count": n, "avg_adaptation_interval_ms": _ratio(self.decided[1] - self.decided[0], n - 1) if n else 0.0}
        for name, m in (("window", self.window), ("watermark", self.delay)):
            out |= {f"adaptive_{name}_ms": m.value, f"min_{name}_ms": m.low, f"max_{name}_ms": m.high, f"{name}_oscillation": m.flips}
            out |= {f"{name}_change_rate": _ratio(m.changes, n), f"{name}_oscillation_rate": _ratio(m.flips, n)}
        return out

    def snapshot(self) -> dict:
        figures = self.figures()
        return {k: figures[k] for k in SNAPSHOT}

    def line(self) -> str:
        figures = self.figures()
        return "[METRIC] " + " ".join(f"{k}={figures[k]:{form}}" for k, form in LINE.items())
