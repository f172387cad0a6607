"""Configurations, random search, early stop, comparison of modes and titled summaries."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from strandline.operators import aggregates as agg, control


def test_configurations(spark):
    assert control.TreeConfig.from_dict({"max_depth": 3}).to_dict()["max_depth"] == 3
    light = control.grid(control.SPACES["light"])
    assert len(light) == 16 and {c.subsample for c in light} == {0.8}
    some = control.random_configs(control.SPACES["default"], 5)
    assert len({str(c) for c in some}) == 5 and some == control.random_configs(control.SPACES["default"], 5) != control.random_configs(control.SPACES["default"], 5, seed=1)
    assert len(control.random_configs(control.SPACES["light"], 99)) == 16
    tree = control.TreeConfig(7, 2, 0.3, 4, 0.8, 0.9).regressor("y")
    assert (tree.getMaxIter(), tree.getMaxDepth(), tree.getStepSize(), tree.getMinInstancesPerNode(), tree.getSubsamplingRate(), tree.getFeatureSubsetStrategy()) == (7, 2, 0.3, 4, 0.8, "0.9")


def test_search_and_early_stop(spark):
    rows = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"), ((F.col("id") % 20) * 3.0).alias("y"), "id")
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    fit, check = data.where("id < 150"), data.where("id >= 150")
    good, bad = control.TreeConfig(8, 4, 0.5), control.TreeConfig(1, 1, 0.1)
    config, model, error = control.search(fit, check, "y", [bad, good])
    assert config == good and error < 2 and model.getNumTrees == 8
    assert control.train(fit, "y", control.TreeConfig(30, 5, 0.5), validation=check).getNumTrees < 30
    with pytest.raises(ValueError):
        control.search(fit, check, "y", [])


def test_modes_and_summary(spark):
    rows = [("Fixed", "late", "wave", "swarm", 1000, 10, 1.0, 5), ("Fixed", "late", "wave", "swarm", 1000, 10, 2.00049, 7)]
    m = spark.createDataFrame(rows, "mode string, profile string, rate_pattern string, motion_mode string, window_size_ms int, watermark_delay_ms int, event_rate double, total_events int")
    assert agg.compare_modes(m, "mode", ["event_rate"], ["total_events"]).collect() == [("Fixed", 1.5, 7)]
    assert agg.compare_modes(m.limit(0), "mode", ["event_rate"], ["total_events"]).count() == 0
    s = agg.experiment_summary(agg.by_experiment(m, agg.SUMMARY_KEYS, ["event_rate", "total_events"]))
    assert s.columns == [*agg.SUMMARY_KEYS, "Total Events", "Avg Event Rate"] and s.first()["Total Events"] == 7
