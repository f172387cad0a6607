"""Seeded synthetic streams: rates, times, disorder, places and motion as column expressions over a range of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geo

HUB = (59.9391, 30.3158)


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "seq")


def with_rate(rows: DataFrame, pattern: str, per_s: float = 50.0, low: float = 10.0, period_s: float = 60.0, burst: int = 100, pause_ms: int = 5000, seed: int = 1) -> DataFrame:
    """Adds off_ms, the time of arrival: constant, burst (then pause) or wave. The wave's gaps are summed along the sequence in
    two levels, so that no single task orders all rows."""
    if pattern == "constant":
        return rows.withColumn("off_ms", (F.col("seq") * (1000.0 / per_s)).cast("long"))
    if pattern == "burst":
        return rows.withColumn("off_ms", (F.col("seq") * (1000.0 / per_s) + F.floor(F.col("seq") / burst) * pause_ms).cast("long"))
    if pattern != "wave":
        raise ValueError(f"unknown rate pattern {pattern!r}")
    phase = F.col("seq") / (per_s * period_s) * 2 * math.pi
    gap = 1000.0 / (low + (per_s - low) * F.abs(F.sin(phase))) * (0.9 + 0.2 * uniform(seed, "seq"))
    rows = rows.withColumn("_gap", gap).withColumn("_block", F.floor(F.col("seq") / 10_000))
    blocks = rows.groupBy("_block").agg(F.sum("_gap").alias("n"))
    blocks = blocks.select("_block", (F.sum("n").over(Window.orderBy("_block")) - F.col("n")).alias("_base"))
    inner = F.sum("_gap").over(Window.partitionBy("_block").orderBy("seq"))
    return rows.join(blocks, "_block").withColumn("off_ms", (F.col("_base") + inner).cast("long")).drop("_gap", "_block", "_base")


def with_time(rows: DataFrame, pattern: str, most_ms: int = 2000, start_ms: int = 1704067200000, seed: int = 2) -> DataFrame:
    shift = {"realtime": F.lit(0), "skewed": (uniform(seed, "seq") * 2 - 1) * most_ms, "late": -uniform(seed, "seq") * most_ms}[pattern]
    return rows.withColumn("ingest_ms", F.col("off_ms") + start_ms).withColumn("ts_ms", (F.col("ingest_ms") + F.round(shift)).cast("long"))


def with_disorder(rows: DataFrame, delay_p=0.2, delay_ms=3000, burst_p=0.05, burst_ms=10_000, jitter_ms=500, dropout_p=0.0, seed: int = 3) -> DataFrame:
    """Rows that drop out go; then a delay, a burst delay and jitter are taken from the event time."""
    rows = rows.where(uniform(seed, "seq") >= dropout_p)
    delay = F.when(uniform(seed + 1, "seq") < delay_p, uniform(seed + 2, "seq") * delay_ms).otherwise(0)
    burst = F.when(uniform(seed + 3, "seq") < burst_p, burst_ms).otherwise(0)
    jitter = (uniform(seed + 4, "seq") * 2 - 1) * jitter_ms
    return rows.withColumn("ts_ms", (F.col("ts_ms") - F.round(delay + burst - jitter)).cast("long"))


def with_skew(rows: DataFrame, kind: str, p: float = 0.2, most_ms: int = 2000, seed: int = 9) -> DataFrame:
    u = uniform(seed + 1, "seq") * most_ms
    sign = {"positive": F.lit(1), "negative": F.lit(-1), "bidirectional": F.when(uniform(seed + 2, "seq") < 0.5, 1).otherwise(-1)}[kind]
    return rows.withColumn("ts_ms", F.when(uniform(seed, "seq") < p, F.col("ts_ms") + F.round(u * sign)).otherwise(F.col("ts_ms")).cast("long"))


def with_place(rows: DataFrame, pattern: str, seed: int = 20, radius_m: float = 500.0) -> DataFrame:
    """random box, clustered (normal), disk (uniform in area), hub (several disks) or corridor around the hub."""
    u, v = uniform(seed, "seq"), uniform(seed + 1, "seq")
    if pattern == "random":
        return rows.withColumn("lat", 50 + u * 10).withColumn("lon", 30 + v * 20)
    if pattern == "clustered":
        north, east = normal(seed, "seq") * radius_m, normal(seed + 2, "seq") * radius_m
    elif pattern == "disk":
        north, east = radius_m * F.sqrt(u) * F.cos(2 * math.pi * v), radius_m * F.sqrt(u) * F.sin(2 * math.pi * v)
    elif pattern == "hub":
        k = F.floor(uniform(seed + 2, "seq") * 5)
        north = F.cos(k * 1.2566) * radius_m + 50 * F.sqrt(u) * F.cos(2 * math.pi * v)
        east = F.sin(k * 1.2566) * radius_m + 50 * F.sqrt(u) * F.sin(2 * math.pi * v)
    elif pattern == "corridor":
        north, east = (u * 2 - 1) * radius_m, (v * 2 - 1) * 10
    else:
        raise ValueError(f"unknown place pattern {pattern!r}")
    return rows.withColumn("lat", HUB[0] + geo.lat_degrees(north)).withColumn("lon", HUB[1] + geo.lon_degrees(east, HUB[0]))


def with_motion(rows: DataFrame, mode: str, objects: int = 50, speed: float = 1.5, seed: int = 30) -> DataFrame:
    """object_id, heading and place of objects: straight, random_walk (sums of steps by object), swarm (one heading) or collision
    (pairs that start 3 m apart, head-on). Any other mode is straight."""
    rows = rows.withColumn("obj", F.pmod("seq", F.lit(objects))).withColumn("object_id", F.concat(F.lit("obj-"), "obj"))
    t = F.col("off_ms") / 1000.0
    home_n, home_e = (uniform(seed, "obj") * 2 - 1) * 100, (uniform(seed + 1, "obj") * 2 - 1) * 100
    if mode == "collision":
        pair = F.floor(F.col("obj") / 2)
        home_n, home_e = (uniform(seed, pair) * 2 - 1) * 100, (uniform(seed + 1, pair) * 2 - 1) * 100 + F.pmod("obj", F.lit(2)) * 3.0
        heading = F.when(F.pmod("obj", F.lit(2)) == 0, 90.0).otherwise(270.0)
        t = F.pmod(t, F.lit(4.0))
    elif mode == "swarm":
        heading = F.lit(45.0)
        home_n, home_e = home_n / 10, home_e / 10
    else:
        heading = uniform(seed + 2, "obj") * 360
    if mode == "random_walk":
        turn = uniform(seed + 3, "seq") * 2 * math.pi
        by = Window.partitionBy("obj").orderBy("seq")
        rows = rows.withColumn("_n", F.sum(F.cos(turn) * speed).over(by)).withColumn("_e", F.sum(F.sin(turn) * speed).over(by))
        north, east, heading = home_n + F.col("_n"), home_e + F.col("_e"), F.degrees(turn)
    else:
        back = F.abs(F.pmod(t, F.lit(60.0)) - 30)
        north, east = home_n + speed * back * F.cos(F.radians(heading)), home_e + speed * back * F.sin(F.radians(heading))
    out = rows.withColumn("heading", geo.normal_heading(heading)).withColumn("speed", F.lit(speed))
    out = out.withColumn("lat", HUB[0] + geo.lat_degrees(north)).withColumn("lon", HUB[1] + geo.lon_degrees(east, HUB[0]))
    return out.withColumn("id", F.concat(F.lit("e-"), "seq")).withColumn("wkt", geo.point_wkt("lon", "lat")).drop("_n", "_e")


# Which disturbances each profile switches on.
PROFILES = {"realtime": (), "skewed": ("skew",), "late": ("late",), "out_of_order": ("disorder",), "mixed": ("disorder", "skew")}


def stream(spark: SparkSession, n: int, profile: str = "realtime", rate: str = "constant", motion: str = "straight") -> DataFrame:
    rows = with_time(with_rate(numbers(spark, n), rate), "late" if profile == "late" else "realtime")
    on = PROFILES[profile]
    rows = with_disorder(rows) if "disorder" in on else rows
    rows = with_skew(rows, "bidirectional") if "skew" in on else rows
    return with_motion(rows, motion)
