from strandline.operators import control, interactions as inter
from strandline.sources.fixture import geo_events
from strandline.streaming.loop import Loop


def test_loop_counts_interactions_and_time(spark):
    seen, out = [], []
    loop = Loop(lambda row: seen.append(row) or (5000, 1000), lambda df, n: out.append(df.groupBy("kind").count().collect()))
    e = geo_events(spark, "/root/testdata/sf0.001").where("seq < 300")
    loop(e, 0)
    assert set(control.NUMERIC) <= set(seen[0]) and seen[0]["processing_latency_ms"] > 0
    assert {f"{r.kind.lower()}_count": r["count"] for r in out[0]}.items() <= seen[0].items()
    assert seen[0]["proximity_count"] == inter.proximity(inter.windowed(e, control.FIXED_WINDOW)).count() > 0
    assert seen[0]["interaction_count"] == sum(seen[0][f"{k}_count"] for k in ("collision", "proximity", "conflict", "swarm"))
