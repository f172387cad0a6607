"""Interactions of moving objects within a window: collisions, proximity, predicted conflicts, swarms.

Every detector works on all windows at once, with the window as a key. Arrival order is the column seq.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo
from ..runtime import Scratch
from .components import components
from .joins import nearest_pairs, radius_pairs
from .trajectories import velocities
from .windows import bucket

COLLISION_M, PROXIMITY_M, CONFLICT_M, SWARM_M = 5.0, 20.0, 10.0, 15.0
HORIZON_S, TTC_S, NEIGHBOURS, SWARM_MIN, STILL, FAR_M = 5.0, 5.0, 5, 3, 1e-6, 1e6


def windowed(events: DataFrame, size_ms: int = 10_000) -> DataFrame:
    return events.withColumn("w", bucket("ts_ms", size_ms))


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("obj_a", F.least("a_object_id", "b_object_id")).withColumn("obj_b", F.greatest("a_object_id", "b_object_id"))


def _first(df: DataFrame, *order) -> DataFrame:
    by = Window.partitionBy("w", "obj_a", "obj_b").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def near_pairs(events: DataFrame, metres: float, known: DataFrame | None) -> DataFrame:
    """Pairs of a window within reach, from a table of pairs of a larger reach if there is one."""
    return radius_pairs(events, metres, "w") if known is None else known.where(F.col("distance") <= metres)


def collisions(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Of each pair of objects in a window the first near pass (nearest events first) that would end in a collision soon."""
    near = nearest_pairs(near_pairs(events, COLLISION_M, pairs), NEIGHBOURS, "w")
    v = velocities(events, "w").select("w", "object_id", "vx", "vy")
    near = near.join(v.toDF("w", "a_object_id", "avx", "avy"), ["w", "a_object_id"]).join(v.toDF("w", "b_object_id", "bvx", "bvy"), ["w", "b_object_id"])
    speed = F.sqrt(F.pow(F.col("avx") - F.col("bvx"), 2) + F.pow(F.col("avy") - F.col("bvy"), 2))
    near = near.withColumn("relative_speed", speed).where(F.col("relative_speed") > STILL).withColumn("ttc", F.col("distance") / F.col("relative_speed")).where(F.col("ttc") <= TTC_S)
    lat, lon = geo.midpoint("a_lat", "a_lon", "b_lat", "b_lon")
    return _first(_pair(near), "a_seq", "distance", "b_seq").select("w", "obj_a", "obj_b", F.greatest("a_ts_ms", "b_ts_ms").alias("ts_ms"), lat.alias("lat"), lon.alias("lon"), (1 / (F.col("ttc") + 1e-6)).alias("severity"), "distance", "ttc", "relative_speed")


def _scan_order():
    """Neighbours come cell by cell of a 100 m grid (column offset, row offset), then in arrival order."""
    ax, ay = geo.grid_cell("a_lat", "a_lon")
    bx, by = geo.grid_cell("b_lat", "b_lon")
    return ["a_seq", bx - ax, by - ay, "b_seq"]


def proximity(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Of each pair of objects in a window the first two events within reach, not at the same place."""
    near = near_pairs(events, PROXIMITY_M, pairs).where(F.col("distance") > STILL)
    return _first(_pair(near), *_scan_order()).select("w", "obj_a", "obj_b", F.greatest("a_ts_ms", "b_ts_ms").alias("ts_ms"), "distance", *(x.alias(n) for x, n in zip(geo.midpoint("a_lat", "a_lon", "b_lat", "b_lon"), ("lat", "lon"), strict=True)))


def proximity_first_only(events: DataFrame) -> DataFrame:
    """As ``proximity``, but only the first candidate pair of two objects is looked at, and must also be close in time:
    within 5 s or half of the window's span of times, whichever is more."""
    span = events.groupBy("w").agg((F.max("ts_ms") - F.min("ts_ms")).alias("span"))
    first = _first(_pair(radius_pairs(events, PROXIMITY_M, "w")), *_scan_order()).join(span, "w")
    gap = F.abs(F.col("a_ts_ms") - F.col("b_ts_ms"))
    ok = (gap <= F.greatest(F.lit(5000), F.col("span") / 2)) & (F.col("distance") > STILL)
    return first.where(ok).select("w", "obj_a", "obj_b", F.greatest("a_ts_ms", "b_ts_ms").alias("ts_ms"), "distance", gap.alias("time_gap_ms"))


def _object_pairs(events: DataFrame) -> DataFrame:
    """Pairs of objects of a window that can meet within the horizon, with place and velocity at the end of their current
    trajectories: those no farther apart than what the fastest two can cover, found by cells."""
    v = Scratch(events.sparkSession).save(velocities(events, "w", plane=True), "velocities")
    fastest = v.agg(F.max(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))).first()[0] or 0.0
    reach = 1.1 * (CONFLICT_M + 2 * fastest * HORIZON_S)  # places are taken as plane; a tenth covers that
    columns = ("seq", "object_id", "vx", "vy", "lon", "lat", "ts_ms")
    if reach < FAR_M:
        pairs = radius_pairs(v, reach, "w", columns=columns).where("a_object_id < b_object_id").drop("distance")
    else:  # a speed that no place on earth is out of reach of
        side = lambda p: v.select("w", *(F.col(c).alias(f"{p}_{c}") for c in columns))
        pairs = side("a").join(side("b"), "w").where("a_object_id < b_object_id")
    return pairs.withColumn("rvx", F.col("b_vx") - F.col("a_vx")).withColumn("rvy", F.col("b_vy") - F.col("a_vy"))


def conflicts_sampled(events: DataFrame, samples: int = 20) -> DataFrame:
    """Pairs whose predicted places, at evenly spaced moments up to the horizon, first come within reach."""
    pairs = _object_pairs(events).where(F.sqrt(F.pow("rvx", 2) + F.pow("rvy", 2)) > STILL)
    ahead = lambda p, t: geo_ahead(F.col(f"{p}_lat"), F.col(f"{p}_lon"), F.col(f"{p}_vx"), F.col(f"{p}_vy"), t)

    def gap(t):
        (lat1, lon1), (lat2, lon2) = ahead("a", t), ahead("b", t)
        return geo.haversine(lat1, lon1, lat2, lon2)

    times = F.transform(geo.at_offsets(HORIZON_S, samples), lambda t: F.struct(t.alias("t"), gap(t).alias("d")))
    first = F.element_at(F.filter(times, lambda x: x["d"] <= CONFLICT_M), 1)
    return pairs.withColumn("hit", F.when(F.exists(times, lambda x: x["d"] <= CONFLICT_M), first)).where("hit is not null").select("w", F.col("a_object_id").alias("obj_a"), F.col("b_object_id").alias("obj_b"), F.greatest("a_ts_ms", "b_ts_ms").alias("ts_ms"), F.col("hit.t").alias("ttc"), F.col("hit.d").alias("distance"), (1 / (F.col("hit.t") + 1e-6)).alias("severity"))


def geo_ahead(lat, lon, vx, vy, t):
    return lat + F.degrees(vy * t / geo.R), lon + F.degrees(vx * t / (F.cos(F.radians(lat)) * geo.R))


def conflicts(events: DataFrame) -> DataFrame:
    """Pairs whose closest approach lies within the horizon and within reach."""
    pairs = _object_pairs(events).where(F.col("rvx") * F.col("rvx") + F.col("rvy") * F.col("rvy") > STILL)
    dx = F.radians(F.col("b_lon") - F.col("a_lon")) * F.cos(F.radians("a_lat")) * geo.R
    dy = F.radians(F.col("b_lat") - F.col("a_lat")) * geo.R
    t, d = geo.closest_approach(dx, dy, "rvx", "rvy")
    pairs = pairs.withColumn("ttc", t).withColumn("distance", d).where(F.col("ttc").between(0, HORIZON_S) & (F.col("distance") <= CONFLICT_M))
    severity = F.least(F.greatest(1 - F.col("ttc") / HORIZON_S, F.lit(0.0)), F.lit(1.0))
    return pairs.select("w", F.col("a_object_id").alias("obj_a"), F.col("b_object_id").alias("obj_b"), F.greatest("a_ts_ms", "b_ts_ms").alias("ts_ms"), "ttc", "distance", severity.alias("severity"))


def swarm_members(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(w, seq, cluster): members of density clusters of events. Core events have SWARM_MIN neighbours of other objects
    within reach; clusters are the components of core events, named by their first, plus all neighbours of those. seq
    must be unique."""
    scratch = Scratch(events.sparkSession)
    near = scratch.save(near_pairs(events, SWARM_M, pairs).select("w", "a_seq", "b_seq"), "near")
    core = scratch.save(near.groupBy("w", "a_seq").agg(F.count("*").alias("n")).where(F.col("n") >= SWARM_MIN).select("w", F.col("a_seq").alias("seq")), "core")
    links = near.join(core.toDF("w", "a_seq"), ["w", "a_seq"])
    inner = links.join(core.toDF("w", "b_seq"), ["w", "b_seq"]).where("a_seq < b_seq")
    parts = components(inner.select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b")), scratch)
    labels = core.join(parts.toDF("seq", "cluster"), "seq", "left").select("w", "seq", F.coalesce("cluster", "seq").alias("cluster"))
    labels = scratch.save(labels, "labels")
    around = links.join(labels.withColumnRenamed("seq", "a_seq"), ["w", "a_seq"]).select("w", F.col("b_seq").alias("seq"), "cluster")
    return labels.unionByName(around).distinct()


def swarms(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(w, cluster, size, objects, lat, lon) of each swarm; size counts its events."""
    members = swarm_members(events, pairs).join(events.select("w", "seq", "object_id", "lat", "lon"), ["w", "seq"])
    return members.groupBy("w", "cluster").agg(F.count("*").alias("size"), F.count_distinct("object_id").alias("objects"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def swarms_by_object(events: DataFrame) -> DataFrame:
    """The variant that expands each object once: seeds in arrival order, an event is core with SWARM_MIN - 1 neighbours, a
    swarm has SWARM_MIN objects at least. It depends on order, so each window is one group of a grouped map."""
    import pandas as pd

    def walk(pdf):
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        lat, lon, obj = pdf.lat.tolist(), pdf.lon.tolist(), pdf.object_id.tolist()
        cell, size = {}, math.degrees(2 * SWARM_M / geo.R)
        squeeze = math.cos(math.radians(sum(lat) / len(lat)))
        for i in range(len(pdf)):
            cell.setdefault((int(lon[i] * squeeze // size), int(lat[i] // size)), []).append(i)

        def metres(i, j):
            a = math.sin(math.radians(lat[j] - lat[i]) / 2) ** 2 + math.cos(math.radians(lat[i])) * math.cos(math.radians(lat[j])) * math.sin(math.radians(lon[j] - lon[i]) / 2) ** 2
            return 2 * geo.R * math.atan2(math.sqrt(a), math.sqrt(1 - a))

        def around(i):
            x, y = int(lon[i] * squeeze // size), int(lat[i] // size)
            return [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cell.get((x + dx, y + dy), ()) if obj[j] != obj[i] and metres(i, j) <= SWARM_M]

        seen, out = set(), []
        for i in range(len(pdf)):
            if obj[i] in seen:
                continue
            seen.add(obj[i])
            near = around(i)
            if len(near) < SWARM_MIN - 1:
                continue
            swarm, todo = {obj[i]}, sorted(near)
            while todo:
                j = todo.pop(0)
                if obj[j] in seen:
                    continue
                seen.add(obj[j])
                swarm.add(obj[j])
                more = around(j)
                if len(more) >= SWARM_MIN - 1:
                    todo += sorted(more)
            if len(swarm) >= SWARM_MIN:
                out.append((int(pdf.w[0]), int(pdf.seq[i]), len(swarm), ",".join(sorted(swarm))))
        return pd.DataFrame(out, columns=["w", "first_seq", "size", "objects"])

    return events.select("w", "seq", "object_id", "lat", "lon").groupBy("w").applyInPandas(walk, "w long, first_seq long, size long, objects string")


def all_interactions(events: DataFrame) -> DataFrame:
    """One row for each interaction of any kind: w, kind, obj_a, obj_b (null for swarms), ts_ms, severity."""
    part = lambda df, kind, severity: df.select("w", F.lit(kind).alias("kind"), "obj_a", "obj_b", "ts_ms", severity.cast("double").alias("severity"))
    last = events.groupBy("w").agg(F.max("ts_ms").alias("ts_ms"))
    pairs = Scratch(events.sparkSession).save(radius_pairs(events, PROXIMITY_M, "w"), "pairs")  # the widest reach serves all
    swarm = swarms(events, pairs).join(last, "w").select("w", F.lit("Swarm").alias("kind"), F.lit(None).cast("string").alias("obj_a"), F.lit(None).cast("string").alias("obj_b"), "ts_ms", F.col("size").cast("double").alias("severity"))
    return part(collisions(events, pairs), "Collision", F.col("severity")).unionByName(part(proximity(events, pairs), "Proximity", F.lit(None))).unionByName(part(conflicts(events), "Conflict", F.col("severity"))).unionByName(swarm)
