"""The registered query against a plain search over every way; rounds run until nothing changes."""

import heapq
import math

import pytest
from strandline.operators import interactions as inter
from strandline.operators.graph import DEGREE_M, shortest_paths
from strandline.plans.queries import QUERIES
from strandline.sources.fixture import geo_events

KINDS = (50 / 3.6, 1.4, 8.3, 4.2)


def plain(ways, places, source):
    legs, out = {}, {source: 0.0}
    for i, c in ways:
        nodes = [i % 500, i * 7 % 500, i * 13 % 500]
        line = [places[n] for n in nodes if n in places]
        speed = (50 / 3.6, 30 * 0.44704, KINDS[c % 4])[i % 3]
        seconds = sum(map(math.dist, line, line[1:])) * DEGREE_M / speed
        legs.setdefault(nodes[0], []).append((nodes[2], seconds))
        if c % 2:
            legs.setdefault(nodes[2], []).append((nodes[0], seconds))
    heap = [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        for m, s in legs.get(n, []) if d == out[n] else []:
            if d + s < out.get(m, math.inf):
                out[m] = d + s
                heapq.heappush(heap, (d + s, m))
    return out


def test_query_uses_every_way(spark, tmp_path):
    ways = [(1, 0), (2501, 1), (3501, 2), (3013, 0), (3513, 3), (4169, 1), (5197, 2), (9007, 0), (12001, 5)]
    spark.createDataFrame(ways, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    places = {r.seq: (r.lat, r.lon) for r in geo_events(spark, str(tmp_path)).where("seq < 500").collect()}
    got = {r.node: (r.seconds, r.path) for r in QUERIES["graph_shortest_paths"](spark, str(tmp_path)).collect()}
    want = plain(ways, places, 1)
    assert len(want) > 3 and {n: round(s, 5) for n, s in want.items()} == {n: round(s, 5) for n, (s, _) in got.items()}


def test_limits_do_not_cut_silently(spark):
    edges = spark.createDataFrame([(f"e{k}", k, k + 1, 1.0) for k in range(4)], "id string, `from` long, `to` long, seconds double")
    with pytest.raises(RuntimeError):
        shortest_paths(edges, 0, max_rounds=2)
    assert {r.node: r.seconds for r in shortest_paths(edges, 0).collect()} == {k: k for k in range(5)}


def test_swarms_do_not_stop_early(spark):
    rows = [(k, f"o{k}", 0, 0.0, k * 2 / 111_195) for k in range(40)]
    e = inter.windowed(spark.createDataFrame(rows, "seq long, object_id string, ts_ms long, lon double, lat double"))
    assert {r.cluster for r in inter.swarm_members(e).collect()} == {0}
