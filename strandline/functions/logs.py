"""Figures from log lines and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_values(line: Column) -> Column:
    """map of all key=value pairs of a line."""
    pairs = F.regexp_extract_all(line, F.lit(r"(\w+=[^\s]+)"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r"^\w+=(.*)$", 1).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def typed(value: Column) -> Column:
    """struct(kind, number): int, float (with a point) or string, as a metric's text reads."""
    return F.struct(F.when(value.rlike(r"^[+-]?\d+$"), "int").when(value.contains(".") & value.try_cast("double").isNotNull(), "float").otherwise("string").alias("kind"), value.try_cast("double").alias("number"))


def blocks(text: Column, tag: str) -> Column:
    """array of the records of several lines of a whole log: each from [tag] to an empty line, a line that begins with [, or the end."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)\[{tag}\]\s*(.*?)(?=\n\s*\n|\n\[|\z)"), F.lit(1))


def block_table(texts: DataFrame, tag: str, *fields: str, file: str = "file", text: str = "text") -> DataFrame:
    """(file, n, fields): the numbers after field= in each block of a tag, in order within its file; null where it has none."""
    rows = texts.select(file, F.posexplode(blocks(F.col(text), tag)).alias("n", "_block"))
    return rows.select(file, "n", *(F.nullif(F.regexp_extract("_block", rf"\b{f}=(-?\d+)", 1), F.lit("")).cast("long").alias(f) for f in fields))


_STREAM = r"^(\w+?)_(adaptive|dynamic|multitrigger|session)_([a-z]+)_([a-z]+)_([a-z]+)_(\d{8})_(\d{6})\.log$"
_SPATIAL = r"^([a-z]+)_([a-z]+)_([a-z]+|random_walk)_([a-z]+)_(\d{8})_(\d{6})\.log$"
_ADAPTIVE = r"^(?:(fixed|adaptive)_)?(realtime|skewed|late|out_of_order|mixed)_([a-z]+)_(straight|random_walk|swarm|collision|corridor)_(\d+)_(\d+)_(\d{8})_(\d{6})\.log$"


def _named(name: Column, pattern: str, parts: list[str]) -> Column:
    base = F.element_at(F.split(name, "/"), -1)
    fields = [F.nullif(F.regexp_extract(base, pattern, i + 1), F.lit("")).alias(p) for i, p in enumerate(parts)]
    return F.when(base.rlike(pattern), F.struct(*fields))


def stream_run(name: Column) -> Column:
    return _named(name, _STREAM, ["model", "strategy", "ts_pattern", "rate", "geometry", "day", "time"])


def spatial_run(name: Column) -> Column:
    return _named(name, _SPATIAL, ["ts_pattern", "rate", "motion", "geometry", "day", "time"])


def adaptive_run(name: Column) -> Column:
    return _named(name, _ADAPTIVE, ["mode", "profile", "rate", "motion", "window_ms", "watermark_ms", "day", "time"])


def run_time(day: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat(day, time), "yyyyMMddHHmmss")


def stream_figures(lines: DataFrame, file: str = "file", line: str = "line", at: str = "n") -> DataFrame:
    """By file: mean event latency (non-negative lags), mean watermark lag, mean window latency and windows a second between
    the first and the last line that has an emit time."""
    number = lambda key: F.nullif(F.regexp_extract(line, rf"\b{key}=(-?\d+)", 1), F.lit("")).cast("long")
    lag = F.nullif(F.regexp_extract(line, r"\blag=(\d+)", 1), F.lit("")).cast("long")
    rows = lines.select(file, at, lag.alias("lag"), number("watermark").alias("wm"), number("currentTime").alias("now"), number("windowEnd").alias("end"), number("emitTime").alias("emit"))
    first, last = F.min_by("emit", F.when(F.col("emit").isNotNull(), F.col(at))), F.max_by("emit", F.when(F.col("emit").isNotNull(), F.col(at)))
    n = F.count("emit")
    return rows.groupBy(file).agg(F.avg("lag").alias("event_latency_ms"), F.avg(F.col("now") - F.col("wm")).alias("watermark_lag_ms"), F.avg(F.col("emit") - F.col("end")).alias("window_latency_ms"), n.alias("windows"), F.when(last > first, n * 1000.0 / (last - first)).alias("windows_per_s"))


# Lines of metrics, in the order they are tried: table, pattern, columns. What a pattern lacks reads ''.
METRICS = [
    ("timestamp", r"\[TIMESTAMP\]\s+eventTime=(\d+)\s+processingTime=(\d+)\s+lag=(\d+)\s+objectId=(\S+)", ["eventTime", "processingTime", "lag", "objectId"]),
    ("window", r"\[WINDOW RESULT\]\s+windowStart=(\d+)\s+windowEnd=(\d+)\s+count=(\d+)\s+processingTime=(\d+)", ["windowStart", "windowEnd", "count", "processingTime"]),
    ("spatial_insert", r"\[SPATIAL INDEX\]\s+action=insert\s+cell=\((\d+),(\d+)\)\s+size=(\d+)\s+objectId=(\S+)\s+lat=([\d\.\-]+)\s+lon=([\d\.\-]+)", ["cell_x", "cell_y", "size", "objectId", "lat", "lon"]),
    ("spatial_query", r"\[SPATIAL INDEX\]\s+action=queryRadius\s+center=\((\d+),(\d+)\)\s+radius=([\d\.]+)\s+candidates=(\d+)\s+returned=(\d+)\s+timeMs=([\d\.]+)", ["center_x", "center_y", "radius", "candidates", "returned", "timeMs"]),
    ("proximity", r"\[PROXIMITY\]\s+action=summary\s+events=(\d+)\s+neighbors=(\d+)\s+distanceComputations=(\d+)\s+interactionsRaw=(\d+)\s+interactionsFinal=(\d+)\s+timeMs=([\d\.]+)", ["events", "neighbors", "distanceComputations", "interactionsRaw", "interactionsFinal", "timeMs"]),
    ("collision", r"\[COLLISION\]\s+summary\s+events=(\d+).*?collisions=(\d+).*?timeMs=([\d\.]+)", ["events", "collisions", "timeMs"]),
    ("conflict", r"\[CONFLICT\]\s+summary\s+events=(\d+)\s+conflicts=(\d+)\s+timeMs=([\d\.]+)", ["events", "conflicts", "timeMs"]),
    ("density", r"\[DENSITY\]\s+global\s+count=(\d+)\s+totalAreaKm2=([\d\.]+)\s+density=([\d\.]+)", ["count", "totalAreaKm2", "density"]),
    ("trajectory_start", r"\[TRAJECTORY\]\s+start\s+objectId=(\S+)\s+events=(\d+)\s+ts=(\d+)", ["objectId", "events", "ts"]),
    ("trajectory_update", r"\[TRAJECTORY\]\s+update\s+objectId=(\S+)\s+length=(\d+)\s+timeGap=(\d+)\s+lastTs=(\d+)\s+newTs=(\d+)", ["objectId", "length", "timeGap", "lastTs", "newTs"]),
    ("collision_pair", r"\[COLLISION\]\s+pair=\((\S+),(\S+)\)\s+distance=([\d\.]+).*?ttc=([\d\.]+).*?relativeSpeed=([\d\.]+)", ["objA", "objB", "distance", "ttc", "relativeSpeed"]),
    ("collision_pair", r"\[COLLISION\]\s+detected\s+pair=\((\S+),(\S+)\)\s+distance=([\d\.]+).*?ttc=([\d\.]+)", ["objA", "objB", "distance", "ttc"]),
    ("collision_start", r"\[COLLISION\]\s+action=start\s+events=(\d+)", ["events"]),
    ("collision_spatial_index_built", r"\[COLLISION\]\s+action=spatialIndexBuilt\s+size=(\d+)", ["size"]),
    ("conflict_pair", r"\[CONFLICT\]\s+(detected|skipZeroSpeed)\s+pair=\((\S+),(\S+)\).*?t=([\d\.]+).*?distance=([\d\.]+)", ["type", "objA", "objB", "t", "distance"]),
    ("swarm_start", r"\[SWARM\]\s+action=start\s+events=(\d+).*?eps=([\d\.]+).*?minPoints=(\d+)", ["events", "eps", "minPoints"]),
    ("swarm_spatial_index_built", r"\[SWARM\]\s+action=spatialIndexBuilt\s+size=(\d+)", ["size"]),
    ("swarm_seed", r"\[SWARM\]\s+seed=(\S+)\s+neighbors=(\d+)", ["objectId", "neighbors"]),
    ("swarm_expand", r"\[SWARM\]\s+expand\s+current=(\S+)\s+neighbors=(\d+)", ["objectId", "neighbors"]),
    ("proximity_pair", r"\[PROXIMITY\]\s+pair=\((\S+),(\S+)\)\s+distance=([\d\.]+)\s+threshold=([\d\.]+)", ["objA", "objB", "distance", "threshold"]),
    ("knn", r"\[KNN\]\s+action=findKNN\s+k=(\d+)\s+candidates=(\d+)\s+distanceComputations=(\d+)\s+returned=(\d+)\s+timeMs=([\d\.]+)\s+queryLat=([\d\.\-]+)\s+queryLon=([\d\.\-]+)", ["k", "candidates", "distanceComputations", "returned", "timeMs", "queryLat", "queryLon"]),
]


def metric_table(lines: DataFrame, table: str, line: str = "line") -> DataFrame:
    """The figures, as text, of all lines whose first pattern in METRICS is one of the table's; other columns are kept."""
    own = [k for k, (name, _, _) in enumerate(METRICS) if name == table]
    if not own:
        raise ValueError(f"no metric {table}")
    last = max(own)
    first = F.coalesce(*(F.when(F.col(line).rlike(p), k) for k, (_, p, _) in enumerate(METRICS[: last + 1])))
    rows, columns = lines.withColumn("_first", first).where(F.col("_first").isin(own)), METRICS[own[0]][2]
    figure = lambda c: F.coalesce(*(F.when(F.col("_first") == k, F.regexp_extract(line, METRICS[k][1], METRICS[k][2].index(c) + 1)) for k in own if c in METRICS[k][2]), F.lit(""))
    return rows.select(*(figure(c).alias(c) for c in columns), *(c for c in lines.columns if c != line))


def swarm_sizes(lines: DataFrame, line: str = "line") -> DataFrame:
    """Cluster size of each seed: one more than the expand lines of its object; seeds without any are kept."""
    seeds = metric_table(lines, "swarm_seed", line).select(F.col("objectId").alias("object_id")).distinct()
    grown = metric_table(lines, "swarm_expand", line).groupBy(F.col("objectId").alias("object_id")).agg(F.count("*").alias("n"))
    return seeds.join(grown, "object_id", "left").select("object_id", (F.coalesce("n", F.lit(0)) + 1).alias("size"))


def swarm_growth(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Expand lines by the time in their file's name."""
    run = spatial_run(F.col(file))
    return metric_table(lines, "swarm_expand", line).groupBy(run_time(run["day"], run["time"]).alias("at")).agg(F.count("*").alias("n"))
