"""Joins by distance: an equi-join on grid cells finds candidates, an exact distance decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo

NARROW = ("seq", "object_id", "ts_ms", "lon", "lat")




def radius_pairs(events: DataFrame, metres: float, *keys: str, columns: tuple[str, ...] = NARROW) -> DataFrame:
    """Ordered pairs (a_*, b_*, distance) of events of different objects with equal ``keys`` within a distance.

    Candidates share a cell of twice the radius, once one side is repeated into the cells that its radius touches (at
    most four); longitude cells follow the latitude row, so the result is exact at any place but across the antimeridian.
    Both sides are dealt by key and cell, neither is broadcast; each pair is found once and then mirrored. ``columns``
    must have seq and object_id, which tell events apart.
    """
    size = 2 * metres
    deg = math.degrees(size / geo.R)
    row = lambda lat: F.floor(lat / deg).cast("long")
    # in a row of latitude cells all points use one width, that of the row's edge nearest to a pole
    wide = lambda r: F.lit(deg) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(r * deg), F.abs((r + 1) * deg)), F.lit(89.9)))), F.lit(1e-3))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in columns]
    reach = math.degrees(metres / geo.R) * (1 + 1e-9)
    events = events.select(*keys, *columns)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = events.select(*keys, *side("a"), F.explode(F.sequence(row(F.col("lat") - reach), row(F.col("lat") + reach))).alias("cy"))
    span = F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs("a_lat") + reach, F.lit(89.9)))), F.lit(1e-3))
    width = wide(F.col("cy"))
    a = a.withColumn("cx", F.explode(F.sequence(F.floor((F.col("a_lon") - span) / width).cast("long"), F.floor((F.col("a_lon") + span) / width).cast("long"))))
    b = events.select(*keys, *side("b"), row(F.col("lat")).alias("cy"))
    b = b.withColumn("cx", F.floor(F.col("b_lon") / wide(F.col("cy"))).cast("long"))
    cell = [*keys, "cy", "cx"]
    a, b = a.repartition(n, *cell), b.repartition(n, *cell).hint("shuffle_hash")
    before = (F.col("a_seq") < F.col("b_seq")) | ((F.col("a_seq") == F.col("b_seq")) & (F.col("a_object_id") < F.col("b_object_id")))
    near = (F.abs(F.col("a_lat") - F.col("b_lat")) <= reach) & (F.col("a_object_id") != F.col("b_object_id")) & before
    pairs = a.join(b, cell).where(near).withColumn("distance", geo.haversine("a_lat", "a_lon", "b_lat", "b_lon")).where(F.col("distance") <= metres)
    turned = lambda p, q: F.struct(*(F.col(f"{x}_{c}").alias(f"{y}_{c}") for x, y in ((p, "a"), (q, "b")) for c in columns))
    return pairs.select(*keys, F.explode(F.array(turned("a", "b"), turned("b", "a"))).alias("p"), "distance").select(*keys, "p.*", "distance")


def nearest_pairs(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    """For each event a, its k nearest partners; those at the very same place are skipped."""
    by = Window.partitionBy(*keys, "a_seq").orderBy("distance", "b_seq")
    apart = (F.col("a_lon") != F.col("b_lon")) | (F.col("a_lat") != F.col("b_lat"))
    return pairs.where(apart).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def events_in_regions(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Inner join of events (lon, lat) with the regions (region_id, wkt) that hold them, by cells: a region is in the at most
    four cells that its box touches, of a size (a power of two of a degree) that follows from the box; an event is in one
    cell of each size that occurs. No side is broadcast unless Spark finds it small."""
    shaped = regions.select("region_id", geo.parse_wkt("wkt").alias("shape")).where(F.size("shape.points") > 0)
    shaped = shaped.withColumn("box", geo.bounding_box(F.col("shape.points"))).select("region_id", geo.sides(F.col("shape.rings")).alias("sides"), "box")
    side = F.greatest(F.col("box.max_lon") - F.col("box.min_lon"), F.col("box.max_lat") - F.col("box.min_lat"), F.lit(2.0**-20))
    shaped = shaped.withColumn("level", F.ceil(F.log2(side)).cast("int"))
    levels = sorted(r.level for r in shaped.select("level").distinct().collect())  # from -20 to 9
    at = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    cells = shaped.withColumn("cx", F.explode(F.sequence(at("box.min_lon"), at("box.max_lon")))).withColumn("cy", F.explode(F.sequence(at("box.min_lat"), at("box.max_lat"))))
    inside: Column = F.col("lon").between(F.col("box.min_lon"), F.col("box.max_lon")) & F.col("lat").between(F.col("box.min_lat"), F.col("box.max_lat"))
    placed = events.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cx", at("lon")).withColumn("cy", at("lat"))
    found = placed.join(cells, ["level", "cx", "cy"]).drop("level", "cx", "cy").where(inside)
    return found.where(geo.within(F.col("sides"), "lon", "lat")).drop("sides", "box")
