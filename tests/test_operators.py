import math
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from strandline.functions import geo, logs
from strandline.operators import control, generators, graph, interactions as inter, joins, trajectories as traj, windows as win
from strandline.plans import queries
from strandline.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def events(spark, rows):
    return spark.createDataFrame(rows, "seq long, object_id string, ts_ms long, lon double, lat double")


def test_geometry(spark):
    square = geo.parse_wkt(F.lit("POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))"))
    place = lambda lon, lat, shape=square: geo.contains(shape["rings"], F.lit(lon), F.lit(lat))
    r = one(spark, place(1.0, 1.0), place(0.0, 1.0), place(4.0, 2.0), place(5.0, 1.0), geo.centroid(square), geo.bounding_box(square["points"]), geo.geohash(F.lit(57.64911), F.lit(10.40744), 11))
    assert tuple(r[:4]) == (True, False, False, False)
    assert (r[4].lon, r[4].lat) == (2.0, 1.0) and tuple(r[5]) == (0, 0, 4, 2) and r[6] == "u4pruydqqvj"
    r = one(spark, geo.haversine(0.0, 0.0, 0.0, 1.0), geo.normal_heading(-90.0), *geo.midpoint(0.0, 2.0, 2.0, 4.0), geo.short_cell(F.lit(-90.0), F.lit(-180.0), 6))
    assert r[0] == pytest.approx(math.radians(1) * geo.R) and r[1] == 270 and tuple(r[2:4]) == (1, 3) and r[4] == "0"


def test_holes_and_several_parts(spark):
    holed = geo.parse_wkt(F.lit("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"))
    parts = geo.parse_wkt(F.lit("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((4 0, 5 0, 5 1, 4 1, 4 0)), ((8 0, 9 0, 9 1, 8 1, 8 0), (8.2 0.2, 8.8 0.2, 8.8 0.8, 8.2 0.8)))"))
    place = lambda shape, lon, lat: geo.contains(shape["rings"], F.lit(lon), F.lit(lat))
    r = one(spark, place(holed, 2.0, 2.0), place(holed, 5.0, 5.0), place(holed, 4.0, 5.0), place(parts, 0.5, 0.5), place(parts, 4.5, 0.5), place(parts, 2.5, 0.5), place(parts, 8.5, 0.5), place(parts, 8.1, 0.5), holed["holes"], parts["holes"])
    assert tuple(r[:8]) == (True, False, False, True, True, False, False, True)
    assert r[8] == [False, True] and r[9] == [False, False, False, True]
    r = one(spark, geo.centroid(geo.parse_wkt(F.lit("LINESTRING(0 0, 4 0, 4 4)"))), geo.centroid(geo.parse_wkt(F.lit("POINT(3 4)"))), geo.centroid(geo.parse_wkt(F.lit("POLYGON((0 0, 2 0, 0 0))"))), geo.parse_wkt(F.lit(None).cast("string"))["rings"])
    assert tuple(r[0]) == (3.0, 1.0) and tuple(r[1]) == (3.0, 4.0) and tuple(r[2]) == (1.0, 0.0) and not r[3]


def test_regions_beside_an_edge_as_in_sql(spark, tmp_path):
    """All places that objects can have in the fixture; two of them are all but on an edge of the triangle."""
    places = "SELECT e + 3000 * u AS event_id, u AS user_id FROM range(3000) t(e), range(50) s(u)"
    duckdb.sql(f"COPY ({places}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in queries.QUERIES["join_regions"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
        assert got == set(db.sql(queries.ORACLE_SQL["join_regions"]).fetchall()) and {("triangle", 121149), ("triangle", 121851)} <= got
    shape = geo.parse_wkt(F.lit("POLYGON((30.3140 59.9380, 30.3180 59.9380, 30.3160 59.9400))"))
    turned = geo.parse_wkt(F.lit("POLYGON((30.3160 59.9400, 30.3180 59.9380, 30.3140 59.9380))"))
    assert all(one(spark, *(geo.contains(x["rings"], F.lit(30.3163446), F.lit(59.9396554)) for x in (shape, turned))))


def test_speeds(spark):
    """Posted speeds first, then the kind of way, of service, of slow road."""
    cases = [({"maxspeed": "50"}, 50 / 3.6), ({"maxspeed": "30 mph"}, 30 * 0.44704), ({"maxspeed": "20km/h", "highway": "steps"}, 20 / 3.6), ({"highway": "steps"}, 1.0), ({"highway": "service", "indoor": "true"}, 1.2), ({"highway": "service", "service_type": "alley"}, 2.0), ({"highway": "service"}, 20 / 3.6), ({"highway": "road"}, 30 / 3.6), ({"highway": "primary", "maxspeed": "walk"}, 50 / 3.6), ({}, 50 / 3.6)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = [r.v for r in rows.select("i", graph.resolved_speed(F.col("tags")).alias("v")).sort("i").collect()]
    assert got == pytest.approx([v for _, v in cases])


def test_validity(spark):
    rows = [(90.0, 0.0, "P"), (90.1, 0.0, "P"), (0.0, 180.0, "P"), (0.0, -180.1, "P"), (0.0, 0.0, ""), (0.0, 0.0, None)]
    assert spark.createDataFrame(rows, "lat double, lon double, wkt string").where(geo.valid_event()).count() == 2


def test_trajectory_gaps(spark):
    rows = [(1, "a", 0, 0.0, 0.0), (2, "a", 5000, 0.0, 0.0), (3, "a", 10001, 0.0, 0.0), (4, "a", 10001, 0.0, 0.0), (5, "a", 10000, 0.0, 0.0), (6, "a", 14999, 0.0, 0.0)]
    kept = lambda n: [r.seq for r in traj.current(events(spark, rows[:n])).orderBy("seq").collect()]
    assert [kept(n) for n in (1, 2, 3, 4, 5, 6)] == [[1], [1, 2], [3], [3, 4], [5], [5, 6]]
    far = [*rows, (7, "a", 20_001, 0.0, 0.0)]
    assert traj.segments(events(spark, far)).select("segment").distinct().count() == 2


def test_sessions(spark):
    rows = [(1, "a", 0, 0.0, 0.0), (2, "a", 1000, 0.0, 0.0), (3, "a", 2001, 0.0, 0.0)]
    got = sorted((r.window_start, r.window_end, r.value) for r in win.session_count(events(spark, rows), 1000, "object_id").collect())
    assert got == [(0, 2000, 2), (2001, 3001, 1)]


def test_triggers_and_anchors(spark):
    rows = [(i, "a", 10 * i, 0.0, 0.0) for i in range(250)]
    e = events(spark, rows)
    assert sorted(r.value for r in win.multi_trigger_count(e, 10_000, 100, "object_id", ts="ts_ms").collect()) == [100, 200, 250]
    e = events(spark, [(1, "a", 100, 0.0, 0.0), (2, "a", 50, 0.0, 0.0), (3, "a", 1099, 0.0, 0.0), (4, "a", 1100, 0.0, 0.0), (5, "a", 10, 0.0, 0.0)])
    assert [(r.number, r.window_start, r.value) for r in win.anchored(e, 10, "object_id").orderBy("number").collect()] == [(1, 100, 3), (2, 1100, 2)]


@pytest.mark.parametrize("lat", [0.0, 59.9, -75.0])
def test_radius_join_is_exact(spark, lat):
    rows = [(i, f"o{i % 7}", 0, 179.0 + (i * 37 % 101) * 1e-6 / math.cos(math.radians(lat)) * 9, lat + (i * 53 % 97) * 9e-6) for i in range(200)]
    e = events(spark, rows).withColumn("w", F.lit(0))
    got = {(r.a_seq, r.b_seq) for r in joins.radius_pairs(e, 20.0, "w").collect()}

    def metres(p, q):
        a = math.sin(math.radians(q[4] - p[4]) / 2) ** 2 + math.cos(math.radians(p[4])) * math.cos(math.radians(q[4])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * geo.R * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    assert got == {(p[0], q[0]) for p in rows for q in rows if p[1] != q[1] and metres(p, q) <= 20.0} and got


def test_same_place_same_object_and_parallel_motion(spark):
    d = 3 / 111_195
    rows = [(1, "a", 0, 0.0, 0.0), (2, "b", 0, 0.0, 0.0), (3, "a", 500, 0.0, d)]
    e = inter.windowed(events(spark, rows))
    assert [(r.obj_a, r.obj_b) for r in inter.proximity(e).collect()] == [("a", "b")]
    still = [(1, "a", 0, 0.0, 0.0), (2, "b", 0, 0.0, d), (3, "a", 1000, 0.0, d), (4, "b", 1000, 0.0, 2 * d)]
    e = inter.windowed(events(spark, still))
    assert inter.conflicts(e).count() == 0
    head_on = [(1, "a", 0, 0.0, 0.0), (2, "b", 0, 0.0, 3 * d), (3, "a", 1000, 0.0, d / 2), (4, "b", 1000, 0.0, 2 * d)]
    e = inter.windowed(events(spark, head_on))
    assert inter.collisions(e).count() == 1 and inter.conflicts(e).count() == 1 and inter.conflicts_sampled(e).count() == 1


def test_swarm_border_event_joins_both(spark):
    m = 1 / 111_195
    rows, n = [], 0
    for centre in (0, 28):
        for k in range(4):
            rows.append((n, f"{centre}-{k}", 0, 0.0, (centre + k * 0.1) * m))
            n += 1
    rows.append((n, "border", 0, 0.0, 14.15 * m))
    e = inter.windowed(events(spark, rows))
    assert sorted(r["size"] for r in inter.swarms(e).collect()) in ([5, 5], [9])
    assert inter.swarms_by_object(e).count() >= 1


def test_graph(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 2.0)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(10, [1, 9, 2], {"oneway": "yes", "maxspeed": "36"}), (11, [2, 3], {"maxspeed": "30 mph"}), (12, [3], {}), (13, [1, 3], None)], "id long, node_ids array<long>, tags map<string,string>")
    e = graph.build_edges(ways, nodes)
    got = {r.id: r for r in e.collect()}
    assert set(got) == {"10-f", "11-f", "11-b", "13-f", "13-b"} and len(got["10-f"].geometry) == 2
    assert got["10-f"].speed_mps == pytest.approx(10) and got["11-f"].speed_mps == pytest.approx(13.4112) and got["13-f"].speed_mps == pytest.approx(50 / 3.6)
    paths = {r.node: (r.path, r.seconds) for r in graph.shortest_paths(graph.weighted(e), 1).collect()}
    assert paths[3][0] == ["13-f"] and paths[2][0] == ["10-f"] and paths[1] == ([], 0.0)
    starts = spark.createDataFrame([(1, 1), (2, 99)], "route long, node long")
    hops = {r.route: r.hops for r in graph.random_routes(e, starts, 4).collect()}
    assert len(hops[1]) == 4 and hops[2] == []
    assert graph.edges_near(graph.envelopes(e), 0.0, 0.5, 0.1).count() == 3
    route = spark.createDataFrame([("r", 0, "x", 2.0), ("r", 1, "y", 1.0)], "roverId string, pos int, edge_id string, seconds double")
    assert [r.edge_id for r in graph.rover_ticks(route, 6).orderBy("ts").collect()] == ["x", "x", "y"] * 2


def test_speed_texts(spark):
    rows = spark.createDataFrame([("50",), (" 50 KM/H ",), ("30 mph",), ("walk",), (None,)], "t string")
    assert [None if r[0] is None else round(r[0], 3) for r in rows.select(graph.max_speed(F.col("t"))).collect()] == [13.889, 13.889, 13.411, None, None]


def test_control(spark):
    x = spark.createDataFrame([(500.0, 20_000.0), (7000.4, 700.0)], "window_pred double, delay_pred double")
    assert [(r.window_ms, r.delay_ms) for r in control.decide(x, "Adaptive").collect()] == [(1000, 10_000), (7000, 700)]
    assert {(r.window_ms, r.delay_ms) for r in control.decide(x, "Fixed").collect()} == {(5000, 3000)}
    r = control.Runtime()
    assert r.update(8000, 100, 0) and not r.update(9000, 1, 1999) and r.update(10, 5, 2000) and (r.window_ms, r.delay_ms) == (1000, 5)
    rows = spark.range(60).select(*(F.lit(v[0]).alias(c) for c, v in control.CATEGORIES.items()), *((F.col("id") * (k + 1)).cast("double").alias(c) for k, c in enumerate(control.NUMERIC)), (F.col("id") * 3.0).alias("y"))
    control.check(rows)
    scaler = control.Scaler.from_json(control.Scaler.fit(rows, control.NUMERIC).to_json())
    data = control.features(rows, scaler, ["y"])
    assert len(data.first().features) == 25
    model = control.train(data, "y")
    assert model.transform(data).selectExpr("max(abs(prediction - y))").first()[0] < 20
    a, b, c = control.split(rows, "event_rate")
    assert a.count() + b.count() + c.count() == 60
    with pytest.raises(ValueError):
        control.check(rows.drop("event_rate"))


def test_generators(spark):
    for mode in ("straight", "random_walk", "swarm", "collision"):
        assert generators.stream(spark, 500, "mixed", "burst", mode).where(geo.valid_event()).count() == 500
    for place in ("random", "clustered", "disk", "hub", "corridor"):
        assert generators.with_place(generators.numbers(spark, 100), place).where("lat between -90 and 90").count() == 100
    x = generators.with_rate(generators.numbers(spark, 25_000), "wave").orderBy("seq").select("off_ms").toPandas().off_ms
    assert x.is_monotonic_increasing


def test_sources(spark):
    ok = '{"id":"1","objectId":"o","timestamp":5,"lon":1.0,"lat":2.0,"wkt":"POINT(1 2)"}'
    rows = spark.createDataFrame([(ok,), ("{bad",), (ok.replace("2.0", "95.0"),), (None,)], "value string")
    assert [(r.id, r.ts_ms) for r in readers.parsed_events(rows).collect()] == [("1", 5)]
    assert readers.parsed_events(rows, dead_letters=True).count() == 3
    good = spark.createDataFrame([('{"id":"1","wkt":"P","timestamp":5}',), (None,)], "value string")
    assert [tuple(r) for r in readers.raw_events(good).collect()] == [("1", "P", 5, "")]
    with pytest.raises(Exception, match="event without wkt"):
        readers.raw_events(spark.createDataFrame([('{"id":"1","timestamp":5}',)], "value string")).collect()
    wkb = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    assert readers.wkb_points(wkb) == [(1.0, 2.0), (3.0, 4.0)]
    fallback = readers.first_that_works(lambda: spark.read.parquet("/nowhere"), lambda: spark.range(2))
    assert fallback.count() == 2


def _v(x):
    out = b""
    while True:
        out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
        x >>= 7
        if not x:
            return out


def _f(k, v):
    return _v(k << 3) + _v(v) if isinstance(v, int) else _v(k << 3 | 2) + _v(len(v)) + v


def test_osm_pbf(spark, tmp_path):
    zig = lambda x: _v(x << 1 if x >= 0 else (-x << 1) - 1)
    dense = _f(1, zig(100) + zig(1)) + _f(8, zig(10**7) + zig(-5)) + _f(9, zig(2 * 10**7) + zig(5))
    way = _f(1, 7) + _f(2, _v(1)) + _f(3, _v(2)) + _f(8, zig(100) + zig(1))
    strings = b"".join(_f(1, s) for s in (b"", b"highway", b"primary"))
    block = _f(1, strings) + _f(2, _f(2, dense)) + _f(2, _f(3, way))
    blob = _f(2, len(block)) + _f(3, zlib.compress(block))
    head = _f(1, b"OSMData") + _f(3, len(blob))
    (tmp_path / "x.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    nodes, ways = readers.osm_pbf(spark, str(tmp_path / "x.pbf"))
    assert sorted((r.id, round(r.lat, 7), round(r.lon, 7)) for r in nodes.collect()) == [(100, 1.0, 2.0), (101, 0.9999995, 2.0000005)]
    assert [(r.id, r.node_ids, r.tags) for r in ways.collect()] == [(7, [100, 101], {"highway": "primary"})]


def test_logs(spark):
    r = one(spark, logs.stream_run(F.lit("dataflow_session_skewed_constant_hub_20260323_101500.log")), logs.adaptive_run(F.lit("/x/adaptive_late_wave_random_walk_5000_3000_20260101_000000.log")), logs.spatial_run(F.lit("realtime_wave_random_walk_hub_20260101_000000.log")), logs.key_values(F.lit("[METRIC] a=1 b=x a=2.5")))
    assert (r[0].model, r[0].strategy, r[0].geometry) == ("dataflow", "session", "hub") and (r[1].mode, r[1].motion) == ("adaptive", "random_walk")
    assert r[2].motion == "random_walk" and r[3] == {"b": "x", "a": "2.5"}
    lines = spark.createDataFrame([("f", 1, "[TIMESTAMP] eventTime=1 lag=10"), ("f", 2, "lag=-5"), ("f", 3, "windowEnd=100 emitTime=150"), ("f", 4, "windowEnd=200 emitTime=1150")], "file string, n int, line string")
    r = logs.stream_figures(lines).first()
    assert (r.event_latency_ms, r.window_latency_ms, r.windows, r.windows_per_s) == (10, 500, 2, 2.0)
