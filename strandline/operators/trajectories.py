"""Trajectories of objects: segments by gaps, kinematics, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo

MAX_GAP_MS = 5000


def current(events: DataFrame, *keys: str, max_gap_ms: int = MAX_GAP_MS, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """The events of each object's last trajectory: one that goes back in time or comes too late starts it anew."""
    by = Window.partitionBy(*keys, "object_id").orderBy(order)
    gap = F.col(ts) - F.lag(ts).over(by)
    broken = F.when((gap < 0) | (gap > max_gap_ms), 1).otherwise(0)
    rows = events.withColumn("_broken", broken).withColumn("_segment", F.sum("_broken").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("_segment").over(Window.partitionBy(*keys, "object_id"))
    return rows.withColumn("_last", last).where("_segment = _last").drop("_broken", "_segment", "_last")


def segments(events: DataFrame, max_gap_ms: int = MAX_GAP_MS, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Events with the number of their segment: by time, cut where the gap is too long."""
    by = Window.partitionBy("object_id").orderBy(ts, order)
    cut = F.when(F.col(ts) - F.lag(ts).over(by) > max_gap_ms, 1).otherwise(0)
    return events.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def velocities(events: DataFrame, *keys: str, plane: bool = False, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """(keys, object_id, vx, vy, lon, lat, ts_ms, seq) from the last two events of each object's current trajectory."""
    by = Window.partitionBy(*keys, "object_id").orderBy(ts, order)
    rows = current(events, *keys, ts=ts, order=order)
    back = {f"_{c}": F.lag(c).over(by) for c in ("lat", "lon", ts)}
    last = rows.withColumns(back | {"_left": F.lead(order).over(by)}).where("_left is null")
    vx, vy = (geo.plane_velocity if plane else geo.velocity)(F.col("_lat"), F.col("_lon"), F.col(f"_{ts}"), F.col("lat"), F.col("lon"), F.col(ts))
    return last.select(*keys, "object_id", vx.alias("vx"), vy.alias("vy"), "lon", "lat", F.col(ts).alias("ts_ms"), F.col(order).alias("seq"))


def summary(events: DataFrame, *keys: str, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Start, end, size, length in metres, mean speed and box of each object's events, in order of time."""
    by = Window.partitionBy(*keys, "object_id").orderBy(ts, order)
    step = geo.haversine(F.lag("lat").over(by), F.lag("lon").over(by), "lat", "lon")
    rows = events.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    out = rows.groupBy(*keys, "object_id").agg(F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count("*").alias("size"), F.sum("_step").alias("metres"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    return out.withColumn("mean_speed", F.when(seconds > 0, F.col("metres") / seconds).otherwise(0.0))


def lines(telemetry: DataFrame) -> DataFrame:
    """(roverId, coords): [lon, lat] places of each rover in order of time."""
    rows = telemetry.groupBy("roverId").agg(F.sort_array(F.collect_list(F.struct("ts", F.array("lon", "lat").alias("c")))).alias("x"))
    return rows.select("roverId", F.transform("x", lambda p: p["c"]).alias("coords"))


def geojson_line(rover: str, coords: str):
    """A GeoJSON feature of a line."""
    properties = F.struct(F.col(rover).alias("roverId"), F.size(coords).alias("points"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col(coords).alias("coordinates")).alias("geometry"), properties.alias("properties")))


def merged(a: DataFrame, b: DataFrame, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """(object_id, events): the events of both sides for each object, in order of time."""
    row = F.struct(F.col(ts), F.col(order), "lon", "lat")
    return a.unionByName(b).groupBy("object_id").agg(F.sort_array(F.collect_list(row)).alias("events"))


def steps(events: DataFrame, value: str, ts: str = "ts_ms", order: str = "seq") -> DataFrame:
    """Each object's change of a value since its event before, its size, and its size by second."""
    by = Window.partitionBy("object_id").orderBy(ts, order)
    change = F.col(value) - F.lag(value).over(by)
    gap = (F.col(ts) - F.lag(ts).over(by)) / 1000.0
    return events.select("object_id", order, change.alias("change"), F.abs(change).alias("size"), F.when(gap > 0, F.abs(change) / gap).alias("per_s"))
