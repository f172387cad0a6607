"""Adaptive control of window size and watermark delay: features, a learned model, bounds and decisions."""

from __future__ import annotations

import itertools
import json
import random
from dataclasses import asdict, dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

# Bounds, defaults, and the features of the control model with their categories.
WINDOW_BOUNDS, DELAY_BOUNDS, FIXED_WINDOW, FIXED_DELAY, EVERY_MS = (1000, 10_000), (500, 10_000), 5000, 3000, 2000
# Categories and figures stand in the order in which a served model takes them.
CATEGORIES = {
    "profile": ["realtime", "skewed", "late", "out_of_order", "mixed"],
    "rate_pattern": ["constant", "burst", "wave"],
    "motion_mode": ["straight", "corridor", "swarm", "collision", "random_walk"],
}
NUMERIC = ["event_rate", "disorder_ratio", "late_event_ratio", "avg_latency_ms", "window_fill_ratio", "interaction_rate", "collision_rate", "proximity_rate", "swarm_rate", "conflict_rate", "watermark_lag_ms", "processing_latency_ms"]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def arbitrate(window: Column, delay: Column) -> tuple[Column, Column]:
    """Offline bounds: the window in [1000, 30000], the delay in [0, 5000] and at most 0.3 of the window."""
    window = clamp(window, 1000, 30_000)
    return window, F.least(clamp(delay, 0, 5000), window * 0.3)


def decide(rows: DataFrame, mode: str, window: str = "window_pred", delay: str = "delay_pred") -> DataFrame:
    """Adds window_ms, delay_ms, lateness_ms and confidence. Fixed mode ignores the predictions."""
    if mode == "Fixed":
        w, d, c = F.lit(FIXED_WINDOW), F.lit(FIXED_DELAY), F.lit(1.0)
    else:
        w, d = (clamp(F.round(F.col(x)), *b).cast("int") for x, b in ((window, WINDOW_BOUNDS), (delay, DELAY_BOUNDS)))
        c = clamp(F.col("confidence"), 0, 1) if "confidence" in rows.columns else F.lit(1.0)
    return rows.withColumns({"window_ms": w.cast("int"), "delay_ms": d.cast("int"), "lateness_ms": d.cast("int"), "confidence": c.cast("double"), "strategy": F.lit(mode)})


def flags() -> list[Column]:
    """Whether a stream is highly disordered, and under high load."""
    return [((F.col("disorder_ratio") > 0.3) | (F.col("late_event_ratio") > 0.2)).alias("is_disordered"), ((F.col("event_rate") > 100) | (F.col("processing_latency_ms") > 1000)).alias("is_loaded")]


@dataclass
class Scaler:
    """Means and population deviations of the numeric features; a deviation of zero counts as one."""

    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, rows: DataFrame, columns: list[str]) -> Scaler:
        r = rows.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns)).first()
        return cls({c: r[f"{c}_m"] or 0.0 for c in columns}, {c: r[f"{c}_s"] or 1.0 for c in columns})

    def columns(self) -> list[Column]:
        return [((F.col(c) - self.mean[c]) / self.scale[c]).alias(c) for c in self.mean]

    def to_json(self) -> str:
        return json.dumps({"numeric_features": list(self.mean), "mean": list(self.mean.values()), "scale": list(self.scale.values())})

    @classmethod
    def from_json(cls, text: str) -> Scaler:
        x = json.loads(text)
        return cls(dict(zip(x["numeric_features"], x["mean"], strict=True)), dict(zip(x["numeric_features"], x["scale"], strict=True)))


def one_hot() -> list[Column]:
    """Indicators in the order of each feature's categories; an unknown category has none."""
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for c, vs in CATEGORIES.items() for v in vs]


def features(rows: DataFrame, scaler: Scaler, keep: list[str]) -> DataFrame:
    """The 25 features of the control model, as one vector."""
    flat = rows.select(*keep, *one_hot(), *scaler.columns())
    return VectorAssembler(inputCols=[c for c in flat.columns if c not in keep], outputCol="features", handleInvalid="keep").transform(flat).select(*keep, "features")


def clean(rows: DataFrame, needed: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Distinct rows without nulls in what is needed, and with all figures in range."""
    rows = rows.dropDuplicates().dropna(subset=needed)
    for c, (lo, hi) in ranges.items():
        rows = rows.where(F.col(c).between(lo, hi))
    return rows


def check(rows: DataFrame) -> None:
    """Raises ValueError unless all columns are there, all categories are known and all figures are finite."""
    missing = [c for c in [*CATEGORIES, *NUMERIC] if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    odd = rows.agg(*(F.count_if(~F.col(c).isin(v) | F.col(c).isNull()).alias(c) for c, v in CATEGORIES.items())).first().asDict()
    if any(odd.values()):
        raise ValueError(f"unknown categories: {odd}")
    bad = rows.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in NUMERIC)).first().asDict()
    if any(bad.values()):
        raise ValueError(f"figures missing or not finite: {bad}")


def split(rows: DataFrame, *keys: str, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows, 70 : 15 : 15, by a hash of the keys: the same whatever the partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(100))
    return rows.where(h < 70), rows.where((h >= 70) & (h < 85)), rows.where(h >= 85)


# What a search may choose from.
SPACES = {
    "default": {"n_estimators": [50, 100, 150, 200], "max_depth": [3, 4, 5, 6], "learning_rate": [0.05, 0.1, 0.15, 0.2], "min_child_weight": [1, 3, 5], "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.7, 0.8, 0.9], "reg_alpha": [0, 0.1, 0.2], "reg_lambda": [0.5, 1.0, 1.5]},
    "light": {"n_estimators": [50, 100], "max_depth": [3, 4], "learning_rate": [0.05, 0.1], "min_child_weight": [3, 5], "subsample": [0.8], "colsample_bytree": [0.8], "reg_alpha": [0.05, 0.1], "reg_lambda": [0.5, 1.0]},
    "reduced": {"n_estimators": [100, 150, 200], "max_depth": [4, 5, 6], "learning_rate": [0.05, 0.1, 0.15], "min_child_weight": [3, 5], "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9], "reg_alpha": [0.05, 0.1], "reg_lambda": [0.5, 1.0]},
}
#: Spark's names; its trees have no penalties on leaf weights, so a search leaves reg_alpha and reg_lambda out.
_PARAMETERS = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "min_child_weight": "minInstancesPerNode", "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy"}


@dataclass
class TreeConfig:
    """Parameters of one model of boosted trees."""

    n_estimators: int = 40
    max_depth: int = 5
    learning_rate: float = 0.1
    min_child_weight: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0

    @classmethod
    def from_dict(cls, values: dict) -> TreeConfig:
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)

    def regressor(self, label: str, **more) -> GBTRegressor:
        values = self.to_dict() | {"colsample_bytree": str(float(self.colsample_bytree))}
        return GBTRegressor(featuresCol="features", labelCol=label, seed=42, **{_PARAMETERS[k]: v for k, v in values.items()}, **more)


def grid(space: dict[str, list]) -> list[TreeConfig]:
    space = {k: v for k, v in space.items() if k in _PARAMETERS}
    return [TreeConfig(**dict(zip(space, values, strict=True))) for values in itertools.product(*space.values())]


def random_configs(space: dict[str, list], n: int = 50, seed: int = 42) -> list[TreeConfig]:
    """``n`` different combinations, or all where there are fewer."""
    every = grid(space)
    return random.Random(seed).sample(every, min(n, len(every)))


def train(rows: DataFrame, label: str, config: TreeConfig | None = None, validation: DataFrame | None = None, tolerance: float = 0.01):
    """Boosted trees on (features, label). With ``validation``, trees are added only while its error falls by ``tolerance``."""
    config = config or TreeConfig()
    if validation is None:
        return config.regressor(label).fit(rows)
    both = rows.withColumn("_check", F.lit(False)).unionByName(validation.withColumn("_check", F.lit(True)), allowMissingColumns=True)
    return config.regressor(label, validationIndicatorCol="_check", validationTol=tolerance).fit(both)


def search(rows: DataFrame, validation: DataFrame, label: str, configs: list[TreeConfig]) -> tuple[TreeConfig, object, float]:
    """The configuration with the smallest error (RMSE) on ``validation``, its model and that error; the first of those that tie."""
    if not configs:
        raise ValueError("nothing to search")
    by, best = RegressionEvaluator(labelCol=label, metricName="rmse"), None
    rows, validation = rows.persist(), validation.persist()
    try:
        for config in configs:
            model = train(rows, label, config)
            error = by.evaluate(model.transform(validation))
            if best is None or error < best[2]:
                best = (config, model, error)
    finally:
        rows.unpersist()
        validation.unpersist()
    return best


@dataclass
class Runtime:
    """Driver-side state of the loop: what is in force, and when it was last changed."""

    mode: str = "Adaptive"
    window_ms: int = FIXED_WINDOW
    delay_ms: int = FIXED_DELAY
    changed_ms: int = -(1 << 60)

    def update(self, window_ms: int, delay_ms: int, now_ms: int) -> bool:
        if self.mode == "Fixed" or now_ms - self.changed_ms < EVERY_MS:
            return False
        self.window_ms, self.delay_ms, self.changed_ms = max(1000, window_ms), max(0, delay_ms), now_ms
        return True
