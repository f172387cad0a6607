import pytest
from strandline.streaming import models as m


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


@pytest.fixture
def source(spark, tmp_path):
    def make(*batches):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "object_id string, ts_ms long").coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        return spark.readStream.schema("object_id string, ts_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))

    return make


def test_event_time_counts(spark, source):
    s = source([("a", 1000), ("a", 2000), ("b", 9000)], [("a", 40_000)], [("a", 90_000)])
    got = {(r.object_id, r.window_start, r.value) for r in run(spark, m.pipeline(s, "dataflow", "dynamic", "object_id"), "append", "tumbling")}
    assert ("a", 0, 2) in got and ("b", 0, 1) in got


def test_sessions(spark, source):
    s = source([("a", 1000), ("a", 11_000)], [("a", 90_000)], [("a", 190_000)])
    got = {(r.window_start, r.window_end, r.value) for r in run(spark, m.pipeline(s, "dataflow", "session", "object_id"), "append", "sessions")}
    assert (1000, 21_000, 2) in got


@pytest.mark.parametrize("model", ["microbatch", "actor", "log"])
def test_other_models_run(spark, source, model):
    run(spark, m.pipeline(source([("a", 1000)]), model, "multitrigger", "object_id"), "update", f"m_{model}")


def test_anchored_windows(spark, source):
    s = source([("a", 100), ("a", 50)], [("a", 3000)], [("a", 9000)], [("a", 30_000)])
    got = [(r.window_start, r.value) for r in run(spark, m.anchored_windows(s, "object_id", 1000), "append", "anchored")]
    assert got and got[0][0] == 100 and got[0][1] >= 2


def test_unknown_names(spark, source):
    with pytest.raises(ValueError):
        m.pipeline(source([("a", 1)]), "nope", "dynamic", "object_id")


def test_feedback_loop(spark):
    from strandline.sources.fixture import geo_events
    from strandline.streaming.loop import Loop, metric_line

    out = []
    loop = Loop(lambda row: (20_000, row["mean_latency_ms"]), lambda df, n: out.append((n, df.count())))
    e = geo_events(spark, "/root/testdata/sf0.001").where("seq < 300")
    loop(e, 0)
    loop(e.limit(0), 1)
    assert out[0][1] > 0 and len(out) == 1 and loop.runtime.window_ms == 10_000 and loop.runtime.delay_ms >= 500
    assert metric_line({"a": 1, "b": 0.5}) == "[METRIC] a=1 b=0.5000"
