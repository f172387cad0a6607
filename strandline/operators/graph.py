"""Road graphs: edges from ways, speeds, envelopes, shortest paths, seeded walks and rover motion."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..runtime import Scratch

# Speeds by kind of way (m/s), by kind of service (m/s), of slow roads (km/h).
PEDESTRIAN = {"footway": 1.4, "path": 1.4, "pedestrian": 1.4, "corridor": 1.3, "steps": 1.0, "indoor": 1.2, "cycleway": 4.0, "track": 2.0, "living_street": 2.0}
SERVICE = {"alley": 2.0, "driveway": 3.0, "laneway": 2.0, "parking_aisle": 3.0, "parking road": 3.0, "yard": 2.0, "footway": 1.4, "مدخل الجامع": 1.2}
SLOW_KMH = {"residential": 40, "service": 20, "unclassified": 30, "road": 30}
DEFAULT_SPEED, EDGE_SPEED, DEGREE_M = 50 / 3.6, 13.9, 111_000.0


def max_speed(tag: Column) -> Column:
    """m/s of a tag like 50, 50 km/h or 30 mph; null for anything else."""
    x = F.lower(F.trim(tag))
    n = F.regexp_extract(x, r"^(\d+)", 1).cast("double")
    return F.when(x.rlike(r"^\d+$") | x.rlike(r"^\d+\s*km/h$"), n / 3.6).when(x.rlike(r"^\d+\s*mph$"), n * 0.44704)


def resolved_speed(tags: Column) -> Column:
    """The posted speed, else a default by the kind of way, of service, or of slow road."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    pick = lambda k, table: F.coalesce(*[F.when(tag(k) == x, v) for x, v in table.items()])
    indoor = F.when(tag("indoor") == "true", PEDESTRIAN["indoor"])
    slow = {k: v / 3.6 for k, v in SLOW_KMH.items()}
    return F.coalesce(max_speed(tag("maxspeed")), pick("highway", PEDESTRIAN), indoor, pick("service_type", SERVICE), pick("highway", slow), F.lit(DEFAULT_SPEED))


def build_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One directed edge a way, from its first to its last node, and one back unless it is one-way. Nodes that do not exist
    are left out of the geometry; ways of less than two nodes are skipped."""
    ways = ways.where(F.size("node_ids") >= 2)
    places = ways.select("id", F.posexplode("node_ids").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
    shape = places.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("lat", "lon").alias("p")))), lambda x: x["p"]).alias("geometry"))
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    base = ways.join(shape, "id", "left").select(F.col("id").cast("string").alias("way"), F.element_at("node_ids", 1).alias("from"), F.element_at("node_ids", -1).alias("to"), F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>")).alias("geometry"), tags.alias("tags"))
    there = base.select(F.concat("way", F.lit("-f")).alias("id"), "from", "to", "geometry", "tags")
    oneway = F.coalesce(F.try_element_at("tags", F.lit("oneway")), F.lit("")).isin("true", "yes")
    back = base.where(~oneway).select(F.concat("way", F.lit("-b")).alias("id"), F.col("to").alias("from"), F.col("from").alias("to"), F.reverse("geometry").alias("geometry"), "tags")
    return there.unionByName(back).withColumn("speed_mps", resolved_speed(F.col("tags")))


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the sorted ids of the edges that leave them."""
    out = edges.groupBy(F.col("from").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("outgoing_edges"))
    return nodes.join(out, "id", "left").withColumn("outgoing_edges", F.coalesce("outgoing_edges", F.array().cast("array<string>")))


def envelopes(edges: DataFrame) -> DataFrame:
    box = lambda f, k: f(F.transform("geometry", lambda p: p[k]))
    return edges.where(F.size("geometry") >= 2).select(F.col("id").alias("edge_id"), box(F.array_min, "lat").alias("min_lat"), box(F.array_min, "lon").alias("min_lon"), box(F.array_max, "lat").alias("max_lat"), box(F.array_max, "lon").alias("max_lon"))


def edges_near(boxes: DataFrame, lat: float, lon: float, radius_deg: float) -> DataFrame:
    """Edges whose envelope meets a box of some degrees around a place."""
    return boxes.where((F.col("min_lat") <= lat + radius_deg) & (F.col("max_lat") >= lat - radius_deg) & (F.col("min_lon") <= lon + radius_deg) & (F.col("max_lon") >= lon - radius_deg))


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with seconds of travel; without geometry there is no way through."""
    n = F.size("geometry")
    legs = F.zip_with(F.slice("geometry", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("geometry", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(a["lat"] - b["lat"], 2) + F.pow(a["lon"] - b["lon"], 2)))
    length = F.aggregate(legs, F.lit(0.0), lambda s, x: s + x) * DEGREE_M
    return edges.withColumn("seconds", F.when(n >= 2, length / F.coalesce("speed_mps", F.lit(EDGE_SPEED))).otherwise(float("inf")))


def shortest_paths(edges: DataFrame, source, max_rounds: int | None = None) -> DataFrame:
    """(node, seconds, path) of the quickest way from a node to every node that can be reached: frontiers are relaxed with
    joins, a round at a time, and only nodes that became cheaper go on, until there are none. Raises RuntimeError if
    ``max_rounds`` is given and not enough."""
    spark = edges.sparkSession
    scratch = Scratch(spark)
    kind = dict(edges.dtypes)["from"]
    legs = scratch.save(edges.where(F.col("seconds") < float("inf")).groupBy("from", "to").agg(F.min_by("id", F.struct("seconds", "id")).alias("edge"), F.min("seconds").alias("leg")), "legs")
    best = spark.createDataFrame([(source, 0.0, [])], f"node {kind}, seconds double, path array<string>")
    frontier = best = scratch.save(best, "best_0")
    for k in itertools.count(1):
        step = frontier.join(legs, frontier["node"] == legs["from"]).select(F.col("to").alias("node"), (F.col("seconds") + F.col("leg")).alias("seconds"), F.concat("path", F.array("edge")).alias("path"))
        step = step.groupBy("node").agg(F.min_by("path", F.struct("seconds", F.size("path"), "path")).alias("path"), F.min("seconds").alias("seconds")).select("node", "seconds", "path")
        known = best.select("node", F.col("seconds").alias("known"))
        frontier = scratch.save(step.join(known, "node", "left").where("known is null or seconds < known").select("node", "seconds", "path"), f"frontier_{k}")
        if frontier.isEmpty():
            return best
        if k == max_rounds:
            raise RuntimeError(f"paths still change after {max_rounds} rounds")
        best = scratch.save(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier), f"best_{k}")
        scratch.drop(f"best_{k - 1}", f"frontier_{k - 1}")


def random_routes(edges: DataFrame, starts: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """(route, node, hops): from each (route, node), ``length`` seeded choices among outgoing edges, less at a dead end."""
    choices = edges.groupBy("from").agg(F.sort_array(F.collect_list(F.struct("id", "to"))).alias("out"))
    now = starts.select("route", "node", F.array().cast("array<string>").alias("hops"))
    for k in range(length):
        pick = F.element_at("out", (F.pmod(F.xxhash64(F.lit(seed), "route", F.lit(k)), F.size("out")) + 1).cast("int"))
        now = now.join(choices, now["node"] == choices["from"], "left").withColumn("pick", F.when(F.col("out").isNotNull(), pick))
        now = now.select("route", F.coalesce("pick.to", "node").alias("node"), F.when(F.col("pick").isNotNull(), F.concat("hops", F.array("pick.id"))).otherwise(F.col("hops")).alias("hops"))
    return now


def place_on(geometry: Column, progress: Column) -> Column:
    """The place at a share of an edge's points, linear between neighbours."""
    n = F.size(geometry)
    i = F.least(F.floor(progress * (n - 1)).cast("int"), n - 2)
    t = progress * (n - 1) - i
    a, b = F.get(geometry, i), F.get(geometry, i + 1)
    return F.when(n == 1, F.get(geometry, F.lit(0))).otherwise(F.struct((a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon")))


def heading(a: Column, b: Column) -> Column:
    """Degrees from east, anticlockwise."""
    return geo.normal_heading(F.degrees(F.atan2(b["lat"] - a["lat"], b["lon"] - a["lon"])))


def rover_ticks(routes: DataFrame, ticks: int, dt_s: float = 1.0) -> DataFrame:
    """Telemetry (roverId, ts, edge, lap place) of rovers that drive their routes round and round.

    ``routes`` is (roverId, pos, edge_id, seconds). A leg's rest is not carried over: entering an edge starts it anew, so an
    edge takes ceil(seconds / dt) ticks, and the tick's edge follows from sums of those."""
    by = Window.partitionBy("roverId").orderBy("pos")
    steps = routes.withColumn("ticks", F.greatest(F.ceil(F.col("seconds") / dt_s), F.lit(1)).cast("long"))
    steps = steps.withColumn("until", F.sum("ticks").over(by)).withColumn("lap", F.sum("ticks").over(Window.partitionBy("roverId")))
    times = steps.select("roverId", "lap").distinct().select("roverId", "lap", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick"))
    at = times.withColumn("within", F.pmod(F.col("tick").cast("long"), F.col("lap")))
    hit = at.join(steps.drop("lap"), "roverId").where((F.col("within") < F.col("until")) & (F.col("within") >= F.col("until") - F.col("ticks")))
    progress = F.coalesce(F.try_divide((F.col("within") - F.col("until") + F.col("ticks")) * dt_s, F.col("seconds")), F.lit(0.0))
    return hit.select("roverId", (F.col("tick") * int(dt_s * 1000)).alias("ts"), "edge_id", progress.alias("progress"))


def start_nodes(edges: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(route, node) for routes 1 to ``count``: nodes with outgoing edges in the order of a seeded hash, from the start again
    where there are fewer nodes than routes."""
    spark = edges.sparkSession
    some = edges.select(F.col("from").alias("node")).where("node is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(count)
    some = some.withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "node"), "node")) - 1)  # of ``count`` rows at most
    size = some.withColumn("size", F.count("*").over(Window.partitionBy()))
    every = size.withColumn("route", F.explode(F.sequence(F.col("k") + 1, F.lit(max(count, 1)), F.col("size")))).where(F.col("route") <= count)
    return every.select(F.col("route").cast("long").alias("route"), "node") if count > 0 else spark.createDataFrame([], every.select(F.col("route").cast("long"), "node").schema)


def rover_routes(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """(roverId, pos, edge_id, seconds, routeId) of (route, hops), for ``rover_ticks``; edges without length take no time, routes
    without edges have no rover."""
    legs = routes.select(F.concat(F.lit("rover-"), "route").alias("roverId"), F.array_join("hops", "-").alias("routeId"), F.posexplode("hops").alias("pos", "edge_id"))
    times = weighted(edges).select(F.col("id").alias("edge_id"), F.when(F.col("seconds") < float("inf"), F.col("seconds")).otherwise(0.0).alias("seconds"))
    return legs.join(times, "edge_id").select("roverId", "pos", "edge_id", "seconds", "routeId")


def rover_telemetry(edges: DataFrame, routes: DataFrame, ticks: int, dt_s: float = 1.0, start_ms: int = 0) -> DataFrame:
    """Telemetry after each of ``ticks`` steps of the rovers of (route, hops): place, speed and heading on the edge."""
    legs = rover_routes(edges, routes)
    at = rover_ticks(legs.drop("routeId"), ticks + 1, dt_s).where("ts > 0").join(legs.where("pos = 0").select("roverId", "routeId"), "roverId")
    shapes = edges.select(F.col("id").alias("edge_id"), "geometry", F.coalesce("speed_mps", F.lit(EDGE_SPEED)).alias("speed"))
    n, g = F.size("geometry"), F.col("geometry")
    i = F.least(F.floor(F.col("progress") * (n - 1)).cast("int"), n - 2)
    facing = F.when(n >= 2, heading(F.get(g, i), F.get(g, i + 1))).otherwise(0.0)
    rows = at.join(shapes, "edge_id").withColumn("place", F.when(n >= 1, place_on(g, F.col("progress"))))
    return rows.select("roverId", (F.col("ts") + start_ms).alias("ts"), "place.lat", "place.lon", "speed", facing.alias("heading"), F.col("edge_id").alias("edgeId"), "routeId")


def simulate(edges: DataFrame, rovers: int = 50, length: int = 20, ticks: int = 1800, dt_s: float = 1.0, start_ms: int = 0, seed: int = 1) -> DataFrame:
    """Telemetry of rovers on seeded random routes of ``length`` edges, one rover for each route."""
    return rover_telemetry(edges, random_routes(edges, start_nodes(edges, rovers, seed), length, seed), ticks, dt_s, start_ms)
