"""Road tables, graph files, start nodes and rovers against steps taken one by one."""

import math
import struct

import pytest
from strandline.operators import graph
from strandline.sources import readers, writers

ROADS = "rover_way_id long, osm_id long, geom_wkb binary, highway string, name string, surface string, lanes int, oneway boolean, foot_access string, bicycle_access string, indoor boolean, service_type string, extra int"


def line(*points, order="<"):
    return bytearray(struct.pack(f"{order}BII{2 * len(points)}d", order == "<", 2, len(points), *(x for p in points for x in p)))


@pytest.fixture
def tables(spark):
    rows = [
        (7, 1, line((30.0, 60.0), (30.001, 60.0), (30.001, 60.002)), "footway", None, "asphalt", 0, None, None, None, None, None, 1),
        (8, 2, line((1.0, 2.0), (3.0, 4.0), order=">"), "residential", "x", None, 2, True, "yes", None, True, "alley", 1),
        (9, 3, None, "road", None, None, None, None, None, None, None, None, 1),
        (None, 4, line((1.0, 2.0), (3.0, 4.0)), "road", None, None, None, None, None, None, None, None, 1),
        (10, 5, bytearray(struct.pack("<BI2d", 1, 1, 1.0, 2.0)), "road", None, None, None, None, None, None, None, None, 1),
    ]
    return readers.roads(spark.createDataFrame(rows, ROADS))


def test_road_tables(tables):
    ways = {w.id: w for w in tables[0].collect()}
    assert set(ways) == {7, 8} and ways[7].node_ids == [7000, 7001, 7002]
    assert ways[7].tags == {"highway": "footway", "surface": "asphalt", "oneway": "false", "indoor": "false"}
    assert ways[8].tags == {"highway": "residential", "name": "x", "lanes": "2", "oneway": "true", "foot_access": "yes", "indoor": "true", "service": "alley"}
    assert {(n.id, n.lat, n.lon) for n in tables[1].collect()} == {(7000, 60.0, 30.0), (7001, 60.0, 30.001), (7002, 60.002, 30.001), (8000, 2.0, 1.0), (8001, 4.0, 3.0)}
    assert "ST_AsBinary(geom) AS geom_wkb" in readers.road_query()


def test_too_long_a_way_is_an_error(spark):
    rows = [(1, 1, line(*[(0.0, float(k)) for k in range(1001)]), *[None] * 10)]
    with pytest.raises(Exception, match="too many nodes in way 1"):
        readers.roads(spark.createDataFrame(rows, ROADS))[1].collect()


def test_graph_files(spark, tables, tmp_path):
    edges = graph.build_edges(*tables)
    nodes, boxes = graph.outgoing(edges, tables[1]), graph.envelopes(edges)
    writers.write_graph(nodes, edges, boxes, str(tmp_path))
    for got, want in zip(readers.graph_tables(spark, str(tmp_path)), (nodes, edges, boxes), strict=True):
        assert got.columns == want.columns and got.count() == want.count()


def test_start_nodes(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "from long, to long")
    one = {r.route: r.node for r in graph.start_nodes(edges, 12).collect()}
    assert sorted(one) == list(range(1, 13)) and set(one.values()) == set(range(5)) and all(one[k] == one[k + 5] for k in range(1, 8))
    assert len(set(r.node for r in graph.start_nodes(edges, 3).collect())) == 3
    assert graph.start_nodes(edges, 0).count() == 0 == graph.start_nodes(edges.limit(0), 3).count()


def drive(route, edges, ticks):
    """Steps one by one: (edge, lat, lon, heading) after each."""
    k, travelled, out = 0, 0.0, []
    for _ in range(ticks):
        g, v = edges[route[k]]
        length = sum(math.dist(a, b) for a, b in zip(g, g[1:])) * 111_000
        travelled += v
        share = travelled / length if length else 1.0
        if share >= 1:
            k, travelled, share = (k + 1) % len(route), 0.0, 0.0
        g = edges[route[k]][0]
        i = min(int(share * (len(g) - 1)), len(g) - 2)
        t = share * (len(g) - 1) - i
        (a, b), (c, d) = g[i], g[i + 1]
        out.append((route[k], a + (c - a) * t, b + (d - b) * t, math.degrees(math.atan2(c - a, d - b)) % 360))
    return out


def test_rovers_against_single_steps(spark):
    shapes = {"a-f": ([(60.0, 30.0), (60.0001, 30.0), (60.0001, 30.0002)], 7.0), "b-f": ([(60.0, 30.0), (59.9999, 29.9999)], 3.0), "c-f": ([(1.0, 1.0), (1.0, 1.0)], 5.0)}
    rows = [(k, 1, 2, [{"lat": a, "lon": b} for a, b in g], v) for k, (g, v) in shapes.items()]
    edges = spark.createDataFrame(rows, "id string, from long, to long, geometry array<struct<lat:double,lon:double>>, speed_mps double")
    routes = {1: ["a-f", "b-f", "c-f"], 2: ["b-f"], 3: []}
    got = graph.rover_telemetry(edges, spark.createDataFrame(list(routes.items()), "route long, hops array<string>"), 40, start_ms=100).orderBy("roverId", "ts").collect()
    assert {r.roverId for r in got} == {"rover-1", "rover-2"}
    for k in (1, 2):
        mine = [r for r in got if r.roverId == f"rover-{k}"]
        assert [r.ts for r in mine] == [1100 + 1000 * t for t in range(40)] and {r.routeId for r in mine} == {"-".join(routes[k])}
        for r, (edge, lat, lon, facing) in zip(mine, drive(routes[k], shapes, 40), strict=True):
            assert r.edgeId == edge and r.speed == shapes[edge][1]
            assert (r.lat, r.lon, r.heading) == pytest.approx((lat, lon, facing))


def test_simulation(spark, tables):
    rows = graph.simulate(graph.build_edges(*tables), rovers=3, length=4, ticks=10).collect()
    assert len(rows) == 30 and {r.roverId for r in rows} == {"rover-1", "rover-2", "rover-3"}
