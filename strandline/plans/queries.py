"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, logs
from ..operators import aggregates as agg, control, generators, graph, interactions as inter, joins, trajectories as traj, windows as win
from ..runtime import Scratch
from ..sources.fixture import ORACLE, geo_events
from ..streaming import models, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WIN = 10_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def hav(a: str, b: str) -> str:
    x = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(12742000.0 * atan2(sqrt({x}), sqrt(1 - {x})))"


W = f"WITH {ORACLE}, g AS (SELECT *, ts_ms - ts_ms % {WIN} AS w FROM geo)"


def _pairs(metres: float) -> str:
    return f", near AS (SELECT a.w, a.seq AS s1, b.seq AS s2, a.object_id AS o1, b.object_id AS o2, a.ts_ms AS t1, b.ts_ms AS t2, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, {hav('a', 'b')} AS d, least(a.object_id, b.object_id) AS obj_a, greatest(a.object_id, b.object_id) AS obj_b FROM g a JOIN g b ON a.w = b.w AND a.object_id <> b.object_id WHERE abs(a.lat - b.lat) < {metres * 1.01 / 111194} AND {hav('a', 'b')} <= {metres})"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- windows ---------------------------------------------------------------------------------------------------------


@query("window_tumbling_count", f"{W} SELECT object_id, w AS window_start, w + {WIN} AS window_end, count(*) AS value FROM g GROUP BY ALL")
def _(s, d):
    return win.tumbling_count(geo_events(s, d), WIN, "object_id")


@query("window_cell_count", f"{W} SELECT substring(lower(to_hex(xor(CAST(floor((lat + 90) * 10000) AS INT), CAST(floor((lon + 180) * 10000) AS INT)))), 1, 5) AS cell, ingest_ms - ingest_ms % 30000 AS window_start, ingest_ms - ingest_ms % 30000 + 30000 AS window_end, count(*) AS value FROM g GROUP BY ALL")
def _(s, d):
    return win.tumbling_count(geo_events(s, d).withColumn("cell", geo.short_cell("lat", "lon", 5)), 30_000, "cell", ts="ingest_ms")


@query("window_sliding_count", f"{W}, x AS (SELECT object_id, ts_ms, unnest(range(0, 4)) AS k FROM g), y AS (SELECT object_id, ts_ms, ts_ms - ts_ms % 5000 - 5000 * k AS window_start FROM x) SELECT object_id, window_start, window_start + 20000 AS window_end, count(*) AS value FROM y WHERE window_start + 20000 > ts_ms GROUP BY ALL")
def _(s, d):
    return win.sliding_count(geo_events(s, d), 20_000, 5000, "object_id")


@query("window_dynamic_count", f"{W} SELECT object_id, ts_ms - ts_ms % 6000 AS window_start, ts_ms - ts_ms % 6000 + 6000 AS window_end, count(*) AS value FROM g GROUP BY ALL")
def _(s, d):
    return win.tumbling_count(geo_events(s, d), 1000 * win.scaled_size(10, 0.5), "object_id")


@query("window_session_count", f"{W}, x AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY object_id ORDER BY ts_ms) <= 2000 THEN 0 ELSE 1 END AS new FROM g), y AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT object_id, min(ts_ms) AS window_start, max(ts_ms) + 2000 AS window_end, count(*) AS value FROM y GROUP BY object_id, session")
def _(s, d):
    return win.session_count(geo_events(s, d), 2000, "object_id")


@query("window_adaptive_sizes", f"{W}, x AS (SELECT object_id, seq, ts_ms, row_number() OVER o AS running, greatest(1, coalesce(ts_ms - lag(ts_ms) OVER o, 1)) AS gap FROM g WINDOW o AS (PARTITION BY object_id ORDER BY seq)) SELECT object_id, seq, ts_ms, running, CAST(greatest(1, floor(10 / (1 + running / gap))) AS INT) AS size_s FROM x")
def _(s, d):
    return win.density_sizes(geo_events(s, d), 10, "object_id").drop("density")


@query("window_multi_trigger", f"{W}, x AS (SELECT object_id, ingest_ms - ingest_ms % {WIN} AS window_start, row_number() OVER (PARTITION BY object_id, ingest_ms - ingest_ms % {WIN} ORDER BY seq) AS value, count(*) OVER (PARTITION BY object_id, ingest_ms - ingest_ms % {WIN}) AS total FROM g) SELECT object_id, window_start, window_start + {WIN} AS window_end, value FROM x WHERE value % 5 = 0 OR value = total")
def _(s, d):
    return win.multi_trigger_count(geo_events(s, d), WIN, 5, "object_id")


@query("window_relative_sliding", f"{W}, m AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM g), x AS (SELECT unnest(range(lo, hi + 1, 4000)) AS window_start FROM m) SELECT window_start, window_start + 10000 AS window_end, (SELECT count(*) FROM g WHERE ts_ms >= window_start AND ts_ms < window_start + 10000) AS value FROM x")
def _(s, d):
    return win.relative_sliding_count(geo_events(s, d), 10_000, 4000)


@query("window_anchored")
def _(s, d):
    return win.anchored(geo_events(s, d), 5000, "object_id", delay_ms=3000)


# --- joins -----------------------------------------------------------------------------------------------------------


@query("join_radius", f"{W}{_pairs(20.0)} SELECT w, s1 AS a_seq, s2 AS b_seq, round(d, 6) AS distance FROM near")
def _(s, d):
    return joins.radius_pairs(inter.windowed(geo_events(s, d)), 20.0, "w").select("w", "a_seq", "b_seq", *r6("distance"))


@query("join_nearest", f"{W}{_pairs(5.0)}, k AS (SELECT *, row_number() OVER (PARTITION BY w, s1 ORDER BY d, s2) AS rank FROM near WHERE lat1 <> lat2 OR lon1 <> lon2) SELECT w, s1 AS a_seq, s2 AS b_seq, rank, round(d, 6) AS distance FROM k WHERE rank <= 5")
def _(s, d):
    pairs = joins.radius_pairs(inter.windowed(geo_events(s, d)), 5.0, "w")
    return joins.nearest_pairs(pairs, 5, "w").select("w", "a_seq", "b_seq", "rank", *r6("distance"))


_REGIONS = [("square", "POLYGON((30.3150 59.9385, 30.3165 59.9385, 30.3165 59.9395, 30.3150 59.9395, 30.3150 59.9385))", 2.0), ("triangle", "POLYGON((30.3140 59.9380, 30.3180 59.9380, 30.3160 59.9400))", None), ("far", "POLYGON((10 10, 11 10, 11 11, 10 11, 10 10))", 1.0)]


def _regions(s):
    return s.createDataFrame(_REGIONS, "region_id string, wkt string, area double")


_IN = "(SELECT 'square' AS region_id, seq FROM geo WHERE lon > 30.3150 AND lon < 30.3165 AND lat > 59.9385 AND lat < 59.9395 UNION ALL SELECT 'triangle', seq FROM geo WHERE lat > 59.9380 AND (lon - 30.3140) * (59.9400 - 59.9380) > (lat - 59.9380) * (30.3160 - 30.3140) AND (30.3180 - lon) * (59.9400 - 59.9380) > (lat - 59.9380) * (30.3180 - 30.3160))"


@query("join_regions", f"WITH {ORACLE} SELECT region_id, seq FROM {_IN}")
def _(s, d):
    return joins.events_in_regions(geo_events(s, d), _regions(s)).select("region_id", "seq")


@query("region_density", f"WITH {ORACLE}, r AS (SELECT 'square' AS region_id, 2.0 AS area UNION ALL SELECT 'triangle', NULL UNION ALL SELECT 'far', 1.0), h AS (SELECT region_id, count(*) AS n FROM {_IN} x JOIN geo USING (seq) WHERE ts_ms BETWEEN 1704067200000 AND 1704067260000 GROUP BY 1) SELECT region_id, coalesce(n, 0) AS value, coalesce(n, 0) / coalesce(CAST(area AS DOUBLE), 1.0) AS density FROM r LEFT JOIN h USING (region_id)")
def _(s, d):
    hits = joins.events_in_regions(geo_events(s, d), _regions(s))
    return agg.per_region(hits, _regions(s), 1704067200000, 1704067260000)


# --- trajectories ----------------------------------------------------------------------------------------------------

_CURRENT = ", c1 AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY w, object_id ORDER BY seq) AS gap FROM g), c2 AS (SELECT *, sum(CASE WHEN gap < 0 OR gap > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY w, object_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg FROM c1), cur AS (SELECT * FROM c2 QUALIFY seg = max(seg) OVER (PARTITION BY w, object_id))"
_TWO = ", last AS (SELECT w, object_id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms FROM cur GROUP BY ALL), prev AS (SELECT w, object_id, arg_max(cur.lat, cur.seq) AS lat, arg_max(cur.lon, cur.seq) AS lon, arg_max(cur.ts_ms, cur.seq) AS ts_ms FROM cur JOIN (SELECT w, object_id, seq AS top FROM last) l USING (w, object_id) WHERE cur.seq < top GROUP BY ALL)"
_PLANE = _CURRENT + _TWO + ", vel AS (SELECT l.*, coalesce(CASE WHEN l.ts_ms > p.ts_ms THEN radians(l.lon - p.lon) * cos(radians((p.lat + l.lat) / 2)) * 6371000.0 / ((l.ts_ms - p.ts_ms) / 1000.0) END, 0.0) AS vx, coalesce(CASE WHEN l.ts_ms > p.ts_ms THEN radians(l.lat - p.lat) * 6371000.0 / ((l.ts_ms - p.ts_ms) / 1000.0) END, 0.0) AS vy FROM last l LEFT JOIN prev p USING (w, object_id))"


@query("trajectory_current", f"{W}{_CURRENT} SELECT w, object_id, count(*) AS size, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM cur GROUP BY ALL")
def _(s, d):
    return traj.current(inter.windowed(geo_events(s, d)), "w").groupBy("w", "object_id").agg(F.count("*").alias("size"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


@query("trajectory_velocity", f"{W}{_PLANE} SELECT w, object_id, round(vx, 6) AS vx, round(vy, 6) AS vy FROM vel")
def _(s, d):
    return traj.velocities(inter.windowed(geo_events(s, d)), "w", plane=True).select("w", "object_id", *r6("vx", "vy"))


@query("trajectory_segments", f"{W}, x AS (SELECT object_id, ts_ms, seq, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY object_id ORDER BY ts_ms, seq) > 5000 THEN 1 ELSE 0 END AS cut FROM g), y AS (SELECT *, sum(cut) OVER (PARTITION BY object_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS segment FROM x) SELECT object_id, CAST(segment AS BIGINT) AS segment, count(*) AS size FROM y GROUP BY ALL")
def _(s, d):
    return traj.segments(geo_events(s, d)).groupBy("object_id", "segment").agg(F.count("*").alias("size"))


@query("trajectory_summary", f"{W}, x AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM g WINDOW o AS (PARTITION BY object_id ORDER BY ts_ms, seq)), p AS (SELECT seq, plat AS lat, plon AS lon FROM x), y AS (SELECT x.object_id, x.ts_ms, x.lat, x.lon, coalesce({hav('p', 'x')}, 0) AS step FROM x JOIN p USING (seq)), z AS (SELECT object_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS size, sum(step) AS metres, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM y GROUP BY 1) SELECT * REPLACE (round(metres, 4) AS metres), round(CASE WHEN end_ms > start_ms THEN metres / ((end_ms - start_ms) / 1000.0) ELSE 0 END, 6) AS mean_speed FROM z")
def _(s, d):
    return traj.summary(geo_events(s, d)).withColumn("metres", F.round("metres", 4)).withColumn("mean_speed", F.round("mean_speed", 6))


@query("trajectory_lines", f"{W} SELECT object_id AS \"roverId\", count(*) AS points, round(sum(lon * 1.0), 4) AS lon_sum FROM g GROUP BY 1")
def _(s, d):
    t = geo_events(s, d).select(F.col("object_id").alias("roverId"), F.col("ts_ms").alias("ts"), "lat", "lon")
    x = traj.lines(t)
    return x.select("roverId", F.size("coords").cast("long").alias("points"), F.round(F.aggregate("coords", F.lit(0.0), lambda a, p: a + p[0]), 4).alias("lon_sum"))


# --- interactions ----------------------------------------------------------------------------------------------------

_AXIS = _CURRENT + _TWO + ", vel AS (SELECT l.w, l.object_id, coalesce(CASE WHEN l.ts_ms > p.ts_ms THEN (CASE WHEN l.lon > p.lon THEN 1 ELSE -1 END) * 12742000.0 * atan2(sqrt(pow(cos(radians(p.lat)), 2) * pow(sin(radians(l.lon - p.lon) / 2), 2)), sqrt(1 - pow(cos(radians(p.lat)), 2) * pow(sin(radians(l.lon - p.lon) / 2), 2))) / ((l.ts_ms - p.ts_ms) / 1000.0) END, 0.0) AS vx, coalesce(CASE WHEN l.ts_ms > p.ts_ms THEN (CASE WHEN l.lat > p.lat THEN 1 ELSE -1 END) * 12742000.0 * atan2(sqrt(pow(sin(radians(l.lat - p.lat) / 2), 2)), sqrt(1 - pow(sin(radians(l.lat - p.lat) / 2), 2))) / ((l.ts_ms - p.ts_ms) / 1000.0) END, 0.0) AS vy FROM last l LEFT JOIN prev p USING (w, object_id))"


@query("interaction_collision", f"{W}{_pairs(5.0)}{_AXIS}, k AS (SELECT *, row_number() OVER (PARTITION BY w, s1 ORDER BY d, s2) AS rank FROM near WHERE lat1 <> lat2 OR lon1 <> lon2), c AS (SELECT k.*, sqrt(pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2)) AS rs FROM k JOIN vel a ON a.w = k.w AND a.object_id = o1 JOIN vel b ON b.w = k.w AND b.object_id = o2 WHERE rank <= 5), f AS (SELECT *, row_number() OVER (PARTITION BY w, obj_a, obj_b ORDER BY s1, d, s2) AS n FROM c WHERE rs > 1e-6 AND d / rs <= 5) SELECT w, obj_a, obj_b, greatest(t1, t2) AS ts_ms, round(d, 4) AS distance, round(rs, 4) AS relative_speed, round(d / rs, 4) AS ttc FROM f WHERE n = 1")
def _(s, d):
    x = inter.collisions(inter.windowed(geo_events(s, d)))
    return x.select("w", "obj_a", "obj_b", "ts_ms", *(F.round(c, 4).alias(c) for c in ("distance", "relative_speed", "ttc")))


@query("interaction_proximity", f"{W}{_pairs(20.0)}, c AS (SELECT *, CAST(trunc(radians(lon1) * cos(radians(lat1)) * 6371000.0 / 100) AS INT) AS ax, CAST(trunc(radians(lon2) * cos(radians(lat2)) * 6371000.0 / 100) AS INT) AS bx, CAST(trunc(radians(lat1) * 6371000.0 / 100) AS INT) AS ay, CAST(trunc(radians(lat2) * 6371000.0 / 100) AS INT) AS cby FROM near WHERE d > 1e-6), f AS (SELECT *, row_number() OVER (PARTITION BY w, obj_a, obj_b ORDER BY s1, bx - ax, cby - ay, s2) AS n FROM c) SELECT w, obj_a, obj_b, greatest(t1, t2) AS ts_ms, round(d, 6) AS distance FROM f WHERE n = 1")
def _(s, d):
    return inter.proximity(inter.windowed(geo_events(s, d))).select("w", "obj_a", "obj_b", "ts_ms", *r6("distance"))


@query("interaction_proximity_first", f"{W}{_pairs(20.0)}, c AS (SELECT *, CAST(trunc(radians(lon1) * cos(radians(lat1)) * 6371000.0 / 100) AS INT) AS ax, CAST(trunc(radians(lon2) * cos(radians(lat2)) * 6371000.0 / 100) AS INT) AS bx, CAST(trunc(radians(lat1) * 6371000.0 / 100) AS INT) AS ay, CAST(trunc(radians(lat2) * 6371000.0 / 100) AS INT) AS cby FROM near), f AS (SELECT *, row_number() OVER (PARTITION BY w, obj_a, obj_b ORDER BY s1, bx - ax, cby - ay, s2) AS n FROM c), sp AS (SELECT w, max(ts_ms) - min(ts_ms) AS span FROM g GROUP BY 1) SELECT w, obj_a, obj_b, greatest(t1, t2) AS ts_ms, round(d, 6) AS distance, abs(t1 - t2) AS time_gap_ms FROM f JOIN sp USING (w) WHERE n = 1 AND abs(t1 - t2) <= greatest(5000, span / 2) AND d > 1e-6")
def _(s, d):
    return inter.proximity_first_only(inter.windowed(geo_events(s, d))).select("w", "obj_a", "obj_b", "ts_ms", *r6("distance"), "time_gap_ms")


@query("interaction_conflict", f"{W}{_PLANE}, p AS (SELECT a.w, a.object_id AS obj_a, b.object_id AS obj_b, greatest(a.ts_ms, b.ts_ms) AS ts_ms, b.vx - a.vx AS vx, b.vy - a.vy AS vy, radians(b.lon - a.lon) * cos(radians(a.lat)) * 6371000.0 AS dx, radians(b.lat - a.lat) * 6371000.0 AS dy FROM vel a JOIN vel b ON a.w = b.w AND a.object_id < b.object_id), t AS (SELECT *, -(dx * vx + dy * vy) / (vx * vx + vy * vy) AS ttc FROM p WHERE vx * vx + vy * vy > 1e-6), u AS (SELECT *, sqrt(pow(dx + vx * ttc, 2) + pow(dy + vy * ttc, 2)) AS distance FROM t WHERE ttc BETWEEN 0 AND 5) SELECT w, obj_a, obj_b, ts_ms, round(ttc, 4) AS ttc, round(distance, 4) AS distance FROM u WHERE distance <= 10")
def _(s, d):
    return inter.conflicts(inter.windowed(geo_events(s, d))).select("w", "obj_a", "obj_b", "ts_ms", F.round("ttc", 4).alias("ttc"), F.round("distance", 4).alias("distance"))


@query("interaction_conflict_sampled", f"{W}{_PLANE}, p AS (SELECT a.w, a.object_id AS obj_a, b.object_id AS obj_b, greatest(a.ts_ms, b.ts_ms) AS ts_ms, a.lat AS lat1, a.lon AS lon1, a.vx AS vx1, a.vy AS vy1, b.lat AS lat2, b.lon AS lon2, b.vx AS vx2, b.vy AS vy2 FROM vel a JOIN vel b ON a.w = b.w AND a.object_id < b.object_id WHERE sqrt(pow(b.vx - a.vx, 2) + pow(b.vy - a.vy, 2)) > 1e-6), q AS (SELECT *, unnest(range(0, 21)) * 0.25 AS t FROM p), a AS (SELECT w, obj_a, obj_b, ts_ms, CAST(t AS DOUBLE) AS t, lat1 + degrees(vy1 * t / 6371000.0) AS lat, lon1 + degrees(vx1 * t / (cos(radians(lat1)) * 6371000.0)) AS lon, lat2 + degrees(vy2 * t / 6371000.0) AS blat, lon2 + degrees(vx2 * t / (cos(radians(lat2)) * 6371000.0)) AS blon FROM q), h AS (SELECT w, obj_a, obj_b, ts_ms, t, {hav('a', 'b').replace('b.lat', 'a.blat').replace('b.lon', 'a.blon')} AS d FROM a) SELECT w, obj_a, obj_b, ts_ms, min(t) AS ttc FROM h WHERE d <= 10 GROUP BY ALL")
def _(s, d):
    return inter.conflicts_sampled(inter.windowed(geo_events(s, d))).select("w", "obj_a", "obj_b", "ts_ms", "ttc")


# clusters are named by the smallest core event that can be reached
_SWARM = ", core AS (SELECT w, s1 AS seq FROM near15 GROUP BY ALL HAVING count(*) >= 3), hop AS (SELECT n.w, s1, s2 FROM near15 n JOIN core a ON a.seq = s1 JOIN core b ON b.seq = s2), reach AS (SELECT w, seq, seq AS root FROM core UNION SELECT hop.w, s2, root FROM reach JOIN hop ON s1 = seq), label AS (SELECT w, seq, min(root) AS cluster FROM reach GROUP BY ALL), member AS (SELECT w, seq, cluster FROM label UNION SELECT n.w, s2, cluster FROM near15 n JOIN label ON label.seq = s1), swarm AS (SELECT m.w, cluster, count(*) AS size, count(DISTINCT object_id) AS objects FROM member m JOIN g USING (seq) GROUP BY ALL)"
_RECURSIVE = W.replace("WITH ", "WITH RECURSIVE ", 1)


@query("interaction_swarm", f"{_RECURSIVE}{_pairs(15.0).replace('near AS', 'near15 AS')}{_SWARM} SELECT * FROM swarm")
def _(s, d):
    return inter.swarms(inter.windowed(geo_events(s, d))).select("w", "cluster", "size", "objects")


@query("interaction_swarm_core", f"{W}{_pairs(15.0)}, core AS (SELECT w, s1 AS seq FROM near GROUP BY ALL HAVING count(*) >= 3), mem AS (SELECT w, seq FROM core UNION SELECT near.w, s2 FROM near JOIN core ON core.seq = s1) SELECT w, count(*) AS members FROM mem GROUP BY 1")
def _(s, d):
    return inter.swarm_members(inter.windowed(geo_events(s, d))).select("w", "seq").distinct().groupBy("w").agg(F.count("*").alias("members"))


@query("interaction_swarm_by_object")
def _(s, d):
    return inter.swarms_by_object(inter.windowed(geo_events(s, d)))


@query("interaction_all")
def _(s, d):
    return inter.all_interactions(inter.windowed(geo_events(s, d)))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("aggregate_latency", f"{W}, x AS (SELECT object_id, ingest_ms - ts_ms AS v FROM g), y AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n0 FROM x) SELECT object_id, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, max(CASE WHEN i = floor(0.5 * (n0 - 1) + 0.5) THEN v END) AS p50, max(CASE WHEN i = floor(0.95 * (n0 - 1) + 0.5) THEN v END) AS p95, max(CASE WHEN i = floor(0.99 * (n0 - 1) + 0.5) THEN v END) AS p99 FROM y GROUP BY 1")
def _(s, d):
    return agg.latency_histogram(geo_events(s, d).withColumn("v", F.col("ingest_ms") - F.col("ts_ms")), "v", "object_id").withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query("aggregate_global_density", f"{W} SELECT round(count(*) / (pi() * 1.44), 6) AS density FROM g")
def _(s, d):
    return agg.global_density(geo_events(s, d)).select(*r6("density"))


@query("aggregate_rate_over_time", f"{W} SELECT w AS window_start, count(*) / 10.0 AS events_per_s FROM g GROUP BY 1")
def _(s, d):
    return agg.rate_over_time(geo_events(s, d), WIN)


@query("aggregate_count_between", f"{W} SELECT count(*) AS value, round(count(*) / 30.0, 6) AS events_per_s FROM g WHERE ts_ms BETWEEN 1704067200000 AND 1704067230000")
def _(s, d):
    return agg.count_between(geo_events(s, d), 1704067200000, 1704067230000).select("value", *r6("events_per_s"))


@query("aggregate_arrival_gaps", f"{W}, x AS (SELECT object_id, seq, ts_ms - lag(ts_ms) OVER (PARTITION BY object_id ORDER BY ts_ms, seq) AS gap_ms FROM g) SELECT * FROM x WHERE gap_ms IS NOT NULL")
def _(s, d):
    return agg.arrival_gaps(geo_events(s, d))


@query("aggregate_disorder", f"{W}, x AS (SELECT *, max(ts_ms) OVER (PARTITION BY object_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM g) SELECT object_id, count(*) AS events, count(*) FILTER (ts_ms < high) AS out_of_order, count(*) FILTER (ts_ms < high - 1000) AS late, round(count(*) FILTER (ts_ms < high) / count(*), 6) AS disorder_ratio, round(count(*) FILTER (ts_ms < high - 1000) / count(*), 6) AS late_ratio, round(avg(ingest_ms - ts_ms), 6) AS mean_latency_ms FROM x GROUP BY 1")
def _(s, d):
    x = agg.disorder(geo_events(s, d), "object_id", 1000)
    return x.select("object_id", "events", "out_of_order", "late", *r6("disorder_ratio", "late_ratio", "mean_latency_ms"))


@query("aggregate_moving_average", f"{W}, x AS (SELECT object_id, list(CAST(ingest_ms - ts_ms AS DOUBLE) ORDER BY seq) AS v FROM g GROUP BY 1) SELECT object_id, round(list_reduce(list_concat([0.0::DOUBLE], v), lambda s, y: CASE WHEN s = 0 THEN y ELSE 0.1 * y + 0.9 * s END), 6) AS ema FROM x")
def _(s, d):
    return agg.moving_average(geo_events(s, d), "object_id", F.col("ingest_ms") - F.col("ts_ms")).select("object_id", *r6("ema"))


@query("aggregate_recent_rate", f"{W}, x AS (SELECT unnest(range(CAST(floor(ingest_ms / 1000) AS BIGINT), CAST(floor((ingest_ms + 4999) / 1000) AS BIGINT) + 1)) AS s FROM g) SELECT s, count(*) / 5.0 AS events_per_s FROM x GROUP BY 1")
def _(s, d):
    return agg.recent_rate(geo_events(s, d))


@query("aggregate_oscillation", f"{W}, v AS (SELECT object_id, seq, CAST(floor(lat * 1000) AS BIGINT) % 7 AS v FROM g), x AS (SELECT *, coalesce(lag(v) OVER k, 0) AS last FROM v WINDOW k AS (PARTITION BY object_id ORDER BY seq)), y AS (SELECT *, sign(v - last) AS d, lag(sign(v - last)) OVER (PARTITION BY object_id ORDER BY seq) AS b FROM x) SELECT object_id, count(*) AS decisions, count(*) FILTER (last <> 0 AND d <> 0) AS changes, count(*) FILTER (d * b < 0) AS flips, min(v) AS lowest, max(v) AS highest, round(CASE WHEN count(*) > 1 THEN (max(seq) - min(seq)) / (count(*) - 1) ELSE 0.0 END, 6) AS mean_step FROM y GROUP BY 1")
def _(s, d):
    return agg.oscillation(geo_events(s, d).withColumn("v", F.floor(F.col("lat") * 1000) % 7), "object_id", "v", "seq").withColumn("mean_step", F.round("mean_step", 6))


@query("aggregate_by_experiment", f"{W} SELECT object_id, round(avg(speed), 6) AS speed_mean, round(stddev_samp(speed), 6) AS speed_std, min(speed) AS speed_min, max(speed) AS speed_max, round(avg(lat), 6) AS lat_mean, round(stddev_samp(lat), 6) AS lat_std, min(lat) AS lat_min, max(lat) AS lat_max FROM g GROUP BY 1")
def _(s, d):
    x = agg.by_experiment(geo_events(s, d), ["object_id"], ["speed", "lat"])
    return x.select("object_id", *(F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else c for c in x.columns[1:]))


@query("aggregate_table_quality", "SELECT count(*) AS row_count, count(*) - count(DISTINCT event_id) AS repeated, count(*) FILTER (value IS NULL) AS value_nulls, count(*) FILTER (value < 0 OR value > 50) AS value_out FROM events")
def _(s, d):
    return agg.table_quality(s.read.parquet(f"{d}/events.parquet"), ["event_id"], {"value": (0, 50)})


@query("aggregate_regression_quality", "SELECT round(avg((l_extendedprice - l_quantity * 1500) ** 2) / 1e6, 4) AS mse, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def _(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity") * 1500.0).cast("double").alias("p"))
    return agg.regression_quality(x, "y", "p").select(F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), *r6("r2"))


@query("aggregate_shares", "SELECT event_type, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1")
def _(s, d):
    x = s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    return agg.shares(x, "event_type", "n").select("event_type", *r6("percent"))


@query("aggregate_histogram", "SELECT event_type, CAST(least(floor(value / 2), 49) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")
def _(s, d):
    return agg.histogram(s.read.parquet(f"{d}/events.parquet"), "value", 0, 100, 50, "event_type")


# --- scalar functions, graphs, control -----------------------------------------------------------------------------------


@query("function_distances", f"{W}, a AS (SELECT seq, lat, lon FROM g), b AS (SELECT seq, 59.9391 AS lat, 30.3158 AS lon FROM g) SELECT seq, round({hav('a', 'b')}, 6) AS metres FROM a JOIN b USING (seq)")
def _(s, d):
    return geo_events(s, d).select("seq", F.round(geo.haversine("lat", "lon", 59.9391, 30.3158), 6).alias("metres"))


@query("function_move", f"{W} SELECT seq, round(lat + degrees(10 * cos(radians(seq % 360)) / 6371000.0), 9) AS lat2, round(lon + degrees(10 * sin(radians(seq % 360)) / (6371000.0 * cos(radians(lat)))), 9) AS lon2 FROM g")
def _(s, d):
    lat, lon = geo.move("lat", "lon", F.col("seq") % 360, 10.0)
    return geo_events(s, d).select("seq", F.round(lat, 9).alias("lat2"), F.round(lon, 9).alias("lon2"))


@query("function_wkt", f"{W} SELECT seq, printf('POINT(%.6f %.6f)', round(lon, 5), round(lat, 5)) AS wkt FROM g")
def _(s, d):
    return geo_events(s, d).select("seq", geo.point_wkt(F.round("lon", 5), F.round("lat", 5)).alias("wkt"))


def _roads(s, d):
    nodes = geo_events(s, d).select(F.col("seq").alias("id"), "lat", "lon")
    k = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    tag = F.when(F.col("id") % 3 == 0, "50").when(F.col("id") % 3 == 1, "30 mph").otherwise("walk")
    way = F.element_at(F.array(*map(F.lit, ("primary", "footway", "residential", "service"))), (F.col("c") % 4 + 1).cast("int"))
    ways = k.select("id", F.array((F.col("id") % 500).alias("a"), (F.col("id") * 7 % 500), (F.col("id") * 13 % 500)).alias("node_ids"), F.create_map(F.lit("highway"), way, F.lit("maxspeed"), tag, F.lit("oneway"), F.when(F.col("c") % 2 == 0, "yes").otherwise("no")).alias("tags"))
    return ways, nodes


@query("graph_edges", "WITH w AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders), e AS (SELECT id, id % 500 AS a, id * 13 % 500 AS b, c, CASE WHEN id % 3 = 0 THEN 50 / 3.6 WHEN id % 3 = 1 THEN 30 * 0.44704 ELSE [50 / 3.6, 1.4, 40 / 3.6, 20 / 3.6][c % 4 + 1] END AS v FROM w), d AS (SELECT CAST(id AS VARCHAR) || '-f' AS id, a AS \"from\", b AS \"to\", v FROM e UNION ALL SELECT CAST(id AS VARCHAR) || '-b', b, a, v FROM e WHERE c % 2 = 1) SELECT id, \"from\", \"to\", round(CAST(v AS DOUBLE), 6) AS speed_mps FROM d")
def _(s, d):
    return graph.build_edges(*_roads(s, d)).select("id", "from", "to", *r6("speed_mps"))


@query("graph_envelopes", f"WITH {ORACLE}, w AS (SELECT o_orderkey AS id, unnest([o_orderkey % 500, o_orderkey * 7 % 500, o_orderkey * 13 % 500]) AS node FROM orders) SELECT CAST(w.id AS VARCHAR) || '-f' AS edge_id, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM w JOIN geo ON geo.seq = node GROUP BY w.id HAVING count(*) >= 2")
def _(s, d):
    return graph.envelopes(graph.build_edges(*_roads(s, d)).where(F.col("id").endswith("-f")))


@query("graph_shortest_paths")
def _(s, d):
    ways, nodes = _roads(s, d)
    return graph.shortest_paths(graph.weighted(graph.build_edges(ways, nodes)), 1).select("node", *r6("seconds"), "path")


_SHAPES = [
    ("holed", "POLYGON((30.3140 59.9380, 30.3180 59.9380, 30.3180 59.9400, 30.3140 59.9400, 30.3140 59.9380), (30.3150 59.9385, 30.3165 59.9385, 30.3165 59.9395, 30.3150 59.9395, 30.3150 59.9385))"),
    ("two", "MULTIPOLYGON(((30.3150 59.9385, 30.3156 59.9385, 30.3156 59.9395, 30.3150 59.9395, 30.3150 59.9385)), ((30.3160 59.9385, 30.3165 59.9385, 30.3165 59.9395, 30.3160 59.9395)))"),
    ("block", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 2, 4 4, 6 4, 6 2, 4 2))"),
    ("apart", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((4 0, 5 0, 5 1, 4 1, 4 0)))"),
    ("line", "LINESTRING (0 0, 4 0, 4 2)"),
    ("point", "POINT (3 4)"),
]


@query("function_contains", f"WITH {ORACLE} SELECT 'holed' AS region_id, seq FROM geo WHERE lon > 30.3140 AND lon < 30.3180 AND lat > 59.9380 AND lat < 59.9400 AND NOT (lon BETWEEN 30.3150 AND 30.3165 AND lat BETWEEN 59.9385 AND 59.9395) UNION ALL SELECT 'two', seq FROM geo WHERE lat > 59.9385 AND lat < 59.9395 AND ((lon > 30.3150 AND lon < 30.3156) OR (lon > 30.3160 AND lon < 30.3165))")
def _(s, d):
    return joins.events_in_regions(geo_events(s, d), s.createDataFrame(_SHAPES[:2], "region_id string, wkt string")).select("region_id", "seq")


@query("function_centroid", "SELECT name, round(lon, 9) AS lon, round(lat, 9) AS lat, min_lon, min_lat, max_lon, max_lat FROM (VALUES ('block', 5.0::DOUBLE, 488 / 96.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE), ('apart', 1.7, 0.9, 0.0, 0.0, 5.0, 2.0), ('line', 16 / 6.0, 2 / 6.0, 0.0, 0.0, 4.0, 2.0), ('point', 3.0, 4.0, 3.0, 4.0, 3.0, 4.0)) t(name, lon, lat, min_lon, min_lat, max_lon, max_lat)")
def _(s, d):
    shape = geo.parse_wkt("wkt")
    return s.createDataFrame(_SHAPES[2:], "name string, wkt string").select("name", geo.centroid(shape).alias("c"), geo.bounding_box(shape["points"]).alias("b")).select("name", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"), "b.*")


_ONE_HOT = {"profile": "realtime skewed late out_of_order mixed", "rate_pattern": "constant burst wave", "motion_mode": "straight corridor swarm collision random_walk"}


@query("control_features", f"{W}, x AS (SELECT w, ['late', 'mixed', 'odd'][CAST(w // {WIN} % 3 AS INT) + 1] AS profile, ['wave', 'burst'][CAST(w // {WIN} % 2 AS INT) + 1] AS rate_pattern, 'swarm' AS motion_mode, CAST(count(*) AS DOUBLE) AS event_rate FROM g GROUP BY w) SELECT w, " + ", ".join(f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS {c}_{v}" for c, vs in _ONE_HOT.items() for v in vs.split()) + ", round((event_rate - avg(event_rate) OVER ()) / stddev_pop(event_rate) OVER (), 6) AS event_rate FROM x")
def _(s, d):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("w") / WIN) % len(v) + 1).cast("int"))
    x = inter.windowed(geo_events(s, d)).groupBy("w").agg(F.count("*").cast("double").alias("event_rate"))
    x = x.select("w", pick("late", "mixed", "odd").alias("profile"), pick("wave", "burst").alias("rate_pattern"), F.lit("swarm").alias("motion_mode"), "event_rate")
    scaled = control.Scaler.fit(x, ["event_rate"]).columns()
    return x.select("w", *control.one_hot(), *(F.round(c, 6).alias("event_rate") for c in scaled))


@query("control_decisions", f"{W}, x AS (SELECT w, count(*) AS n FROM g GROUP BY 1) SELECT w, CAST(least(greatest(n * 40, 1000), 10000) AS INT) AS window_ms, CAST(least(greatest(n * 9, 500), 10000) AS INT) AS delay_ms FROM x")
def _(s, d):
    x = inter.windowed(geo_events(s, d)).groupBy("w").agg(F.count("*").alias("n"))
    x = x.select("w", (F.col("n") * 40).alias("window_pred"), (F.col("n") * 9).alias("delay_pred"))
    return control.decide(x, "Adaptive").select("w", "window_ms", "delay_ms")


@query("generate_stream")
def _(s, d):
    return generators.stream(s, 20_000, "mixed", "wave", "swarm").select("id", "object_id", "ts_ms", "lat", "lon", "heading", "speed")


@query("function_key_values", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def _(s, d):
    line = F.concat(F.lit("[METRIC] kind="), "event_type", F.lit(" who="), "user_id", F.lit(" x=1.5"))
    m = logs.key_values(line)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.try_element_at(m, F.lit("kind")).alias("kind"), F.try_element_at(m, F.lit("who")).alias("who"))


@query("trajectory_steps", f"{W}, x AS (SELECT object_id, seq, lat - lag(lat) OVER (PARTITION BY object_id ORDER BY ts_ms, seq) AS change FROM g) SELECT object_id, seq, round(change, 7) AS change, round(abs(change), 7) AS size FROM x WHERE change IS NOT NULL")
def _(s, d):
    x = traj.steps(geo_events(s, d), "lat")
    return x.where("change is not null").select("object_id", "seq", F.round("change", 7).alias("change"), F.round("size", 7).alias("size"))


@query("trajectory_merged", f"{W} SELECT object_id, count(*) AS n, min(ts_ms) AS first_ms FROM g GROUP BY 1")
def _(s, d):
    e = geo_events(s, d)
    x = traj.merged(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))
    return x.select("object_id", F.size("events").cast("long").alias("n"), F.col("events")[0]["ts_ms"].alias("first_ms"))


@query("aggregate_coverage", "SELECT 100.0 * count(DISTINCT event_type) / 6 AS coverage FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    return agg.coverage(e, {"event_type": [*kinds, "other"]})


@query("aggregate_active_speed", f"{W}, x AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM g WINDOW o AS (PARTITION BY object_id ORDER BY ts_ms, seq)), p AS (SELECT seq, plat AS lat, plon AS lon FROM x), y AS (SELECT x.object_id, x.ts_ms, coalesce({hav('p', 'x')}, 0) AS step FROM x JOIN p USING (seq)), z AS (SELECT object_id, min(ts_ms) AS a, max(ts_ms) AS b, sum(step) AS metres FROM y GROUP BY 1) SELECT round(coalesce(avg(CASE WHEN b > a THEN metres / ((b - a) / 1000.0) ELSE 0 END), 0), 6) AS mean_speed FROM z WHERE a <= 1704067230000 AND b >= 1704067200000")
def _(s, d):
    return agg.active_mean_speed(traj.summary(geo_events(s, d)), 1704067200000, 1704067230000).select(*r6("mean_speed"))


@query("stream_profile", f"{W}, h AS (SELECT *, max(ts_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM g), a AS (SELECT count(*) AS events, count(*) FILTER (ts_ms < high) AS out_of_order, count(*) FILTER (ts_ms < high - 3000) AS late, avg(ingest_ms - ts_ms) AS latency, count(DISTINCT object_id) AS objects, count(DISTINCT ts_ms - ts_ms % 5000) AS windows, (max(ingest_ms) - min(ingest_ms)) / 1000.0 AS seconds, max(ts_ms) AS max_ts FROM h) SELECT events, out_of_order, late, objects, windows, max_ts, round(late / events, 6) AS late_ratio, round(out_of_order / events, 6) AS disorder_ratio, round(latency, 6) AS mean_latency_ms, round(events / greatest(seconds, 1.0), 6) AS event_rate, round(events / windows, 6) AS events_per_window, round((events / windows) / (events / greatest(seconds, 1.0) * 5), 6) AS window_fill_ratio, CAST(3000 AS BIGINT) AS watermark_lag_ms FROM a")
def _(s, d):
    from ..streaming.loop import profile

    x = profile(geo_events(s, d), 5000, 3000)
    return x.select("events", "out_of_order", "late", "objects", "windows", "max_ts", "watermark_lag_ms", *r6("late_ratio", "disorder_ratio", "mean_latency_ms", "event_rate", "events_per_window", "window_fill_ratio"))


@query("aggregate_compare_modes", "SELECT event_type AS mode, round(avg(value), 3) AS value, round(max(user_id), 3) AS user_id FROM (SELECT event_type, CAST(value AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id FROM events) GROUP BY 1")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("mode"), F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user_id"))
    return agg.compare_modes(e, "mode", ["value"], ["user_id"])


@query("graph_rovers")
def _(s, d):
    return graph.simulate(graph.build_edges(*_roads(s, d)), ticks=600)


def _streamed(s, d, build):
    """What a stream over the events writes until its input ends; windows that the watermark has not passed stay open."""
    scratch = Scratch(s)
    files = scratch.save(geo_events(s, d).select("object_id", "ts_ms"), "in")
    source = s.readStream.schema(files.schema).parquet(f"{scratch.root}/in")
    write = lambda: build(source).writeStream.format("parquet").option("path", f"{scratch.root}/out").outputMode("append").trigger(availableNow=True)
    run.supervised(write, f"{scratch.root}/checkpoint", restarts=1, pause_s=1.0)
    return s.read.schema("object_id string, window_start long, window_end long, value long").parquet(f"{scratch.root}/out")


_CLOSED = "window_end <= (SELECT max(ts_ms) - 4000 FROM g)"


@query("stream_window_count", f"{W} SELECT object_id, w AS window_start, w + 10000 AS window_end, count(*) AS value FROM g GROUP BY object_id, w HAVING w + 10000 <= (SELECT max(ts_ms) - 4000 FROM g)")
def _(s, d):
    return _streamed(s, d, lambda e: models.counts(models.with_time(e, "dataflow", 4000), "dynamic", "object_id", 10))


@query("stream_sliding_count", f"{W}, x AS (SELECT object_id, ts_ms - ts_ms % 5000 - 5000 * unnest([0, 1]) AS window_start FROM g) SELECT object_id, window_start, window_start + 10000 AS window_end, count(*) AS value FROM x GROUP BY ALL HAVING {_CLOSED}")
def _(s, d):
    return _streamed(s, d, lambda e: models.sliding_counts(models.with_time(e, "dataflow", 4000), "object_id", 10, 5))


@query("stream_count_trigger", f"{W}, x AS (SELECT object_id, ts_ms - ts_ms % 10000 AS window_start, ts_ms - ts_ms % 10000 + 10000 AS window_end, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT *, unnest(range(4, n + 1, 4)) AS value FROM x UNION ALL SELECT *, n FROM x WHERE n % 4 <> 0 AND {_CLOSED}) SELECT object_id, window_start, window_end, value FROM f")
def _(s, d):
    return _streamed(s, d, lambda e: models.counts_every(e, "object_id", 10_000, 4, 4000))


from . import more_queries  # noqa: E402, F401  (adds its own)
