"""More queries over the driver's tables: functions, graph steps, logs made of events, model figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, logs
from ..operators import aggregates as agg, control, graph
from ..sources.fixture import ORACLE, geo_events
from ..streaming.totals import batch_totals
from .queries import W, _roads, hav, query, r6

_LINE = "(SELECT o_orderkey AS id, o_orderkey % 500 AS n1, o_orderkey * 7 % 500 AS n2, o_orderkey * 13 % 500 AS n3, o_custkey AS c FROM orders)"
_SHAPED = f"WITH {ORACLE}, e AS (SELECT CAST(o.id AS VARCHAR) || '-f' AS id, o.id AS k, c, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, z.lat AS lat3, z.lon AS lon3 FROM {_LINE} o JOIN geo a ON a.seq = n1 JOIN geo b ON b.seq = n2 JOIN geo z ON z.seq = n3)"


def _forward(s, d):
    return graph.build_edges(*_roads(s, d)).where(F.col("id").endswith("-f"))


@query("function_near", f"{W}, c AS (SELECT 59.9391 AS lat, 30.3158 AS lon) SELECT seq, {hav('g', 'c')} <= 80 AS near, round((g.lat + c.lat) / 2, 9) AS mid_lat, round((g.lon + c.lon) / 2, 9) AS mid_lon, round(50 / 111320.0, 12) AS d_lat, round(50 / (111320.0 * cos(radians(g.lat))), 9) AS d_lon, CAST(((seq * 7 - 400) % 360 + 360) % 360 AS DOUBLE) AS heading FROM g, c")
def _(s, d):
    lat, lon = geo.midpoint("lat", "lon", 59.9391, 30.3158)
    near = geo.within("lat", "lon", 59.9391, 30.3158, 80.0)
    return geo_events(s, d).select("seq", near.alias("near"), F.round(lat, 9).alias("mid_lat"), F.round(lon, 9).alias("mid_lon"), F.round(geo.lat_degrees(50.0), 12).alias("d_lat"), F.round(geo.lon_degrees(50.0, "lat"), 9).alias("d_lon"), geo.normal_heading(F.col("seq") * 7 - 400).alias("heading"))


@query("function_valid", f"{W} SELECT seq FROM g WHERE lon + seq % 4 * 60 <= 180 AND lat + seq % 3 * 20 <= 90 AND seq % 5 <> 0 AND seq % 7 <> 0")
def _(s, d):
    wkt = F.when(F.col("seq") % 5 == 0, None).when(F.col("seq") % 7 == 0, "").otherwise("POINT(1 1)")
    e = geo_events(s, d).select("seq", (F.col("lon") + F.col("seq") % 4 * 60).alias("lon"), (F.col("lat") + F.col("seq") % 3 * 20).alias("lat"), wkt.alias("wkt"))
    return e.where(geo.valid_event()).select("seq")


@query("graph_weights", f"{_SHAPED} SELECT id, round((sqrt(pow(lat1 - lat2, 2) + pow(lon1 - lon2, 2)) + sqrt(pow(lat2 - lat3, 2) + pow(lon2 - lon3, 2))) * 111000 / CAST(CASE WHEN k % 3 = 0 THEN 50 / 3.6 WHEN k % 3 = 1 THEN 30 * 0.44704 ELSE [50 / 3.6, 1.4, 40 / 3.6, 20 / 3.6][c % 4 + 1] END AS DOUBLE), 6) AS seconds FROM e")
def _(s, d):
    return graph.weighted(_forward(s, d)).select("id", *r6("seconds"))


@query("graph_adjacency", f"WITH {ORACLE}, e AS (SELECT CAST(id AS VARCHAR) || '-f' AS id, n1 AS node FROM {_LINE} UNION ALL SELECT CAST(id AS VARCHAR) || '-b', n3 FROM {_LINE} WHERE c % 2 = 1) SELECT geo.seq AS id, coalesce(string_agg(e.id, ',' ORDER BY e.id), '') AS edges FROM geo LEFT JOIN e ON e.node = geo.seq GROUP BY geo.seq")
def _(s, d):
    ways, nodes = _roads(s, d)
    return graph.outgoing(graph.build_edges(ways, nodes), nodes).select("id", F.array_join("outgoing_edges", ",").alias("edges"))


@query("graph_edges_near", f"{_SHAPED} SELECT id AS edge_id FROM e WHERE least(lat1, lat2, lat3) <= 59.9393 AND greatest(lat1, lat2, lat3) >= 59.9389 AND least(lon1, lon2, lon3) <= 30.316 AND greatest(lon1, lon2, lon3) >= 30.3156")
def _(s, d):
    return graph.edges_near(graph.envelopes(_forward(s, d)), 59.9391, 30.3158, 0.0002).select("edge_id")


@query("graph_places", f"{_SHAPED} SELECT id, round(lat1 + (lat2 - lat1) * 0.5, 9) AS lat, round(lon1 + (lon2 - lon1) * 0.5, 9) AS lon, round((degrees(atan2(lat2 - lat1, lon2 - lon1)) % 360 + 360) % 360, 6) AS heading FROM e")
def _(s, d):
    g = F.col("geometry")
    return _forward(s, d).select("id", graph.place_on(g, F.lit(0.25)).alias("p"), graph.heading(g[0], g[1]).alias("heading")).select("id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"), *r6("heading"))


@query("aggregate_hotspots", f"{W}, x AS (SELECT w AS window_start, count(*) / 10.0 AS density FROM g GROUP BY w) SELECT window_start, CAST(density AS DOUBLE) AS density FROM x WHERE density >= 45")
def _(s, d):
    return agg.hotspots(agg.rate_over_time(geo_events(s, d), 10_000).withColumnRenamed("events_per_s", "density"), 45.0)


@query("aggregate_compared", "WITH x AS (SELECT event_type, CAST(sum(value) AS DOUBLE) AS a, count(*) AS b FROM events GROUP BY 1) SELECT event_type, round(100 * a / sum(a) OVER (), 6) AS percent_a, round(100.0 * CASE WHEN event_type = 'error' THEN 0 ELSE b END / sum(b) FILTER (event_type <> 'error') OVER (), 6) AS percent_b FROM x")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").groupBy("event_type")
    a, b = e.agg(F.sum("value").alias("v")), e.agg(F.count("*").alias("v")).where("event_type <> 'error'")
    return agg.compared(a, b, "event_type", "v").select("event_type", *r6("percent_a", "percent_b"))


@query("aggregate_parity", "SELECT round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff, bool_and(d <= 1e-7 + 1e-5 * abs(b)) AS all_close FROM (SELECT abs(value - b) AS d, b FROM (SELECT value, value + event_id % 3 AS b FROM events))")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("value", (F.col("value") + F.col("event_id") % 3).alias("b"))
    return agg.parity(e, "value", "b").select(*r6("max_diff", "mean_diff", "std_diff"), "all_close")


def _log(s, d):
    stamp = F.format_string("[TIMESTAMP] eventTime=%d processingTime=%d lag=%d objectId=%s", "ts_ms", "ingest_ms", F.col("ingest_ms") - F.col("ts_ms"), "object_id")
    swarm = lambda what: F.format_string(f"[SWARM] {what}=%s neighbors=%d", "object_id", F.col("seq") % 9)
    line = F.when(F.col("seq") % 3 == 0, stamp).when(F.col("seq") % 3 == 1, swarm("seed")).otherwise(swarm("expand current"))
    return geo_events(s, d).select("seq", line.alias("line"))


@query("log_timestamps", f"{W} SELECT seq, CAST(ts_ms AS VARCHAR) AS \"eventTime\", CAST(ingest_ms AS VARCHAR) AS \"processingTime\", CAST(ingest_ms - ts_ms AS VARCHAR) AS lag, object_id AS \"objectId\" FROM g WHERE seq % 3 = 0")
def _(s, d):
    return logs.metric_table(_log(s, d), "timestamp")


@query("log_swarm_sizes", f"{W} SELECT object_id, count(*) FILTER (seq % 3 = 2) + 1 AS size FROM g GROUP BY object_id HAVING count(*) FILTER (seq % 3 = 1) > 0")
def _(s, d):
    return logs.swarm_sizes(_log(s, d))


@query("log_stream_figures", f"{W}, x AS (SELECT object_id AS file, avg(ingest_ms - ts_ms) AS event_latency_ms, avg(ingest_ms - (ts_ms - 2000)) AS watermark_lag_ms, avg(ingest_ms - w) FILTER (seq % 2 = 0) AS window_latency_ms, count(*) FILTER (seq % 2 = 0) AS windows, min_by(ingest_ms, seq) FILTER (seq % 2 = 0) AS a, max_by(ingest_ms, seq) FILTER (seq % 2 = 0) AS b FROM g GROUP BY object_id) SELECT file, round(event_latency_ms, 6) AS event_latency_ms, round(watermark_lag_ms, 6) AS watermark_lag_ms, round(window_latency_ms, 6) AS window_latency_ms, windows, round(CASE WHEN b > a THEN windows * 1000.0 / (b - a) END, 6) AS windows_per_s FROM x")
def _(s, d):
    start = F.col("ts_ms") - F.col("ts_ms") % 10_000
    emit = F.when(F.col("seq") % 2 == 0, F.format_string(" windowEnd=%d emitTime=%d", start, "ingest_ms")).otherwise("")
    line = F.concat(F.format_string("lag=%d watermark=%d currentTime=%d", F.col("ingest_ms") - F.col("ts_ms"), F.col("ts_ms") - 2000, "ingest_ms"), emit)
    rows = geo_events(s, d).select(F.col("object_id").alias("file"), F.col("seq").alias("n"), line.alias("line"))
    return logs.stream_figures(rows).select("file", "windows", *r6("event_latency_ms", "watermark_lag_ms", "window_latency_ms", "windows_per_s"))


@query("log_runs", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'dataflow' END AS model, CASE WHEN event_id % 5 > 0 THEN ['adaptive', 'session'][event_id % 2 + 1] END AS strategy, CASE WHEN event_id % 5 > 0 THEN 'wave' END AS rate, CASE WHEN event_id % 5 > 0 THEN '2024-03-0' || (event_id % 9 + 1) || ' 04:05:06' END AS at FROM events")
def _(s, d):
    strategy = F.when(F.col("event_id") % 2 == 1, "session").otherwise("adaptive")
    day = F.concat(F.lit("2024030"), (F.col("event_id") % 9 + 1).cast("string"))
    name = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("/logs/dataflow_"), strategy, F.lit("_late_wave_disk_"), day, F.lit("_040506.log"))).otherwise("/logs/other.log")
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", logs.stream_run(name).alias("r"))
    return rows.select("event_id", "r.model", "r.strategy", "r.rate", F.date_format(logs.run_time(F.col("r.day"), F.col("r.time")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("control_arbitrate", "SELECT event_id, least(greatest(event_id * 90.0::DOUBLE, 1000), 30000) AS window_ms, least(least(greatest(value * 40 - 100, 0), 5000), least(greatest(event_id * 90.0::DOUBLE, 1000), 30000) * 0.3::DOUBLE) AS delay_ms FROM events")
def _(s, d):
    window, delay = control.arbitrate(F.col("event_id") * 90.0, F.col("value") * 40 - 100)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", window.alias("window_ms"), delay.alias("delay_ms"))


@query("control_clean", "SELECT DISTINCT event_type, user_id, CASE WHEN event_id % 4 > 0 THEN value END AS value FROM events WHERE event_id % 4 > 0 AND value BETWEEN 20 AND 120")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", "user_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"))
    return control.clean(e.unionAll(e), ["value"], {"value": (20.0, 120.0)})


@query("stream_totals", f"{W}, h AS (SELECT *, max(ts_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, (SELECT CAST(floor(avg(ts_ms)) AS BIGINT) FROM geo) AS wm FROM g) SELECT count(*) AS events, count(*) FILTER (ts_ms < high) AS out_of_order, count(*) FILTER (ts_ms < wm) AS late, CAST(sum(greatest(ingest_ms - ts_ms, 0)) AS BIGINT) AS latency_ms, max(ts_ms) AS latest, count(DISTINCT ts_ms - ts_ms % 5000) AS windows FROM h")
def _(s, d):
    e = geo_events(s, d)
    return batch_totals(e, 5000, watermark=e.agg(F.floor(F.avg("ts_ms"))).first()[0])


@query("aggregate_box_statistics", "WITH b AS (SELECT event_type, quantile_cont(CAST(value AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median, quantile_cont(CAST(value AS DOUBLE), 0.75) AS q3 FROM events GROUP BY 1), x AS (SELECT b.*, CAST(value AS DOUBLE) AS v, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN b USING (event_type) WHERE value IS NOT NULL) SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, round(min(v) FILTER (inside), 6) AS low, round(max(v) FILTER (inside), 6) AS high, count(*) FILTER (NOT inside) AS outliers FROM x GROUP BY ALL")
def _(s, d):
    x = agg.box_statistics(s.read.parquet(f"{d}/events.parquet"), "value", "event_type")
    return x.select("event_type", "n", "outliers", *r6("q1", "median", "q3", "low", "high"))
