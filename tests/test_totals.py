"""Running figures across batches, records of several lines, and what a box plot draws."""

import re

import pytest
from pyspark.sql import Observation
from strandline.functions import logs
from strandline.operators import aggregates as agg, control, interactions as inter
from strandline.sources import readers
from strandline.sources.fixture import geo_events
from strandline.streaming.loop import Loop
from strandline.streaming.totals import LINE, SNAPSHOT, Moves, Totals, batch_totals


def test_batches_add_up(spark):
    e = geo_events(spark, "/root/testdata/sf0.001").where("seq < 600").cache()
    wm = e.agg({"ts_ms": "avg"}).first()[0] // 1
    whole = batch_totals(e, 5000, None, int(wm)).first().asDict()
    totals = Totals()
    for lo in (0, 100, 350):
        hi = {0: 100, 100: 350, 350: 600}[lo]
        part = batch_totals(e.where(f"seq >= {lo} AND seq < {hi}"), 5000, totals.latest, int(wm)).first().asDict()
        totals.add(part, {"interaction_count": 2, "swarm_count": 2}, 10.0)
    rows = e.orderBy("seq").collect()
    high = [max(r.ts_ms for r in rows[:k]) if k else None for k in range(len(rows))]
    assert whole["out_of_order"] == sum(h is not None and r.ts_ms < h for r, h in zip(rows, high, strict=True))
    assert {k: totals.sums[k] for k in ("events", "out_of_order", "late", "latency_ms")} == {k: whole[k] for k in ("events", "out_of_order", "late", "latency_ms")}
    f = totals.figures()
    assert (f["swarm_rate"], f["collision_rate"], f["interaction_rate"], f["processing_latency_ms"]) == (1.0, 0.0, 6 / 600, 10.0)
    assert batch_totals(e.limit(0), 5000).count() == 0


def test_figures_at_fixed_times():
    now = [0]
    t = Totals(clock=lambda: now[0], window=Moves(5000), delay=Moves(3000))
    assert set(SNAPSHOT) | set(LINE) == set(t.figures())
    assert t.figures()["event_rate"] == t.figures()["watermark_lag_ms"] == t.figures()["window_fill_ratio"] == 0
    t.add({"events": 50, "out_of_order": 5, "late": 1, "latency_ms": 100, "latest": 9000, "windows": 2}, {}, 4.0)
    t.watermark = 6000
    for at, w, d in ((1000, 4000, 3000), (3000, 6000, 3000), (6000, 5000, 2000)):
        now[0] = at
        t.decide(w, d, 1.5)
    f = t.figures()
    assert (f["event_rate"], f["window_fill_ratio"], f["avg_events_per_window"]) == (0, 25.0, 25.0)  # older than five seconds
    assert (f["window_oscillation"], f["min_window_ms"], f["max_window_ms"], f["avg_adaptation_interval_ms"]) == (1, 4000, 6000, 2500)
    assert (f["watermark_oscillation"], f["min_watermark_ms"], f["watermark_lag_ms"], f["ingestion_lag_ms"]) == (0, 2000, 3000, 0)
    assert (f["window_change_rate"], f["watermark_change_rate"]) == pytest.approx((2 / 3, 1 / 3))
    line = t.line()
    assert line.startswith("[METRIC] event_rate=0.00 disorder_ratio=0.1000 late_event_ratio=0.0200 avg_latency_ms=2.00 ")
    assert re.findall(r"(\w+)=", line) == list(LINE)


@pytest.mark.parametrize("values", [[5, 7, 6, 6, 7], [3], [4, 4, 2, 9, 1], [0, 2, 1]])
def test_moves_equal_oscillation(spark, values):
    m = Moves(values[0])
    for v in values:
        m.to(v)
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "k string, i long, v long")
    r = agg.oscillation(df, "k", "v", "i").first()
    assert (r.changes, r.flips, r.lowest, r.highest) == (m.changes, m.flips, m.low, m.high)
    assert r.mean_step == (1.0 if len(values) > 1 else 0.0)


def test_flat_decisions_end_a_direction():
    m = Moves(5)
    for v in (5, 7, 7, 6):
        m.to(v)
    assert (m.changes, m.flips) == (2, 0)


def test_loop_carries_figures(spark):
    lines, seen = [], []
    loop = Loop(lambda row: seen.append(row) or (5000, 1000), lambda df, n: None, log=lines.append)
    e = geo_events(spark, "/root/testdata/sf0.001")
    for n, where in enumerate(("seq < 150", "seq >= 150 AND seq < 300")):
        loop(e.where(where), n)
    assert [r["total_events"] for r in seen] == [150, 300]
    assert set(control.NUMERIC) <= set(seen[1])
    assert [re.search(r"adaptation_count=(\d+)", x)[1] for x in lines] == ["1", "2"]
    n = [inter.proximity(inter.windowed(e.where(w), control.FIXED_WINDOW)).count() for w in ("seq < 150", "seq >= 150 AND seq < 300")]
    assert seen[1]["proximity_count"] == sum(n)


LOG = """start
[WATERMARK] currentTime=20
  watermark=15

tail watermark=99
[WINDOW RESULT]
windowEnd=5
emitTime=-7
[WATERMARK]
watermark=30
[WINDOW RESULT] emitTime=8"""


def test_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text("")
    texts = readers.log_texts(spark, str(tmp_path))
    for tag in ("WATERMARK", "WINDOW RESULT", "NONE"):
        want = re.findall(rf"\[{tag}\]\s*(.*?)(?=\n\s*\n|\n\[|\Z)", LOG, re.DOTALL)
        got = texts.where("file LIKE '%a.log'").select(logs.blocks(texts["text"], tag).alias("b")).first().b
        assert got == want
    rows = logs.block_table(texts, "WINDOW RESULT", "windowEnd", "emitTime").orderBy("n").collect()
    assert [(r.n, r.windowEnd, r.emitTime) for r in rows] == [(0, 5, -7), (1, None, 8)]


def test_box_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    r = agg.box_statistics(df, "x").first()
    assert (r.q1, r.median, r.q3, r.low, r.high, r.n, r.outliers) == (2, 3, 4, 1, 4, 5, 1)
    assert agg.box_statistics(df.limit(0), "x").where("n > 0").count() == 0


def test_histogram_gauge(spark):
    df = spark.createDataFrame([(0, x) for x in (1, 5, 5, 20, None)], "ts_ms long, ingest_ms long")
    gauges = Observation("latency")
    agg.observed(df, gauges, bounds=(0, 5, 100)).collect()
    got = gauges.get
    assert [got[f"latency_le_{b}"] for b in (0, 5, 100)] == [0, 3, 4] and got["events"] == 5
