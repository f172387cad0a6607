"""Event, telemetry, road and log sources; the same parsing serves batch and streams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..runtime import ship

RAW_EVENT = "id string, wkt string, timestamp bigint, attributes map<string,string>"
GEO_EVENT = "id string, objectId string, timestamp bigint, lon double, lat double, wkt string, speed double, heading double, attributes map<string,string>"
TELEMETRY = "roverId string, ts bigint, lat double, lon double, speed double, heading double, edgeId string, routeId string"


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "earliest", stream: bool = True) -> DataFrame:
    """Messages (key, value) of a topic; needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    return reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()


def raw_events(messages: DataFrame) -> DataFrame:
    """Strict: a message without id, wkt or timestamp is an error; null messages are skipped; a null key reads ''."""
    key = F.coalesce(F.col("key").cast("string"), F.lit("")) if "key" in messages.columns else F.lit("")
    rows = messages.where("value is not null").select(key.alias("kafka_key"), F.from_json(F.col("value").cast("string"), RAW_EVENT).alias("e"))
    need = lambda c: F.when(F.col(f"e.{c}").isNotNull(), F.col(f"e.{c}")).otherwise(F.raise_error(F.lit(f"event without {c}")).cast(dict(id="string", wkt="string", timestamp="bigint")[c]))
    return rows.select(need("id").alias("id"), need("wkt").alias("wkt"), need("timestamp").alias("ts_ms"), "kafka_key")


def parsed_events(messages: DataFrame, dead_letters: bool = False) -> DataFrame:
    """Tolerant: what is malformed or invalid is left out, or is all that is returned if ``dead_letters``."""
    rows = messages.select("value", F.from_json(F.col("value").cast("string"), GEO_EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    ok = F.coalesce(F.col("e.id").isNotNull() & F.col("e.objectId").isNotNull() & F.col("e.timestamp").isNotNull() & geo.valid_event("e.lon", "e.lat", "e.wkt"), F.lit(False))
    if dead_letters:
        return rows.where(~ok).select("value")
    return rows.where(ok).select("e.id", F.col("e.objectId").alias("object_id"), F.col("e.timestamp").alias("ts_ms"), "e.lon", "e.lat", "e.wkt", "e.speed", "e.heading", "e.attributes")


def telemetry(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json(F.col("value").cast("string"), TELEMETRY).alias("e")).where("e is not null").select("e.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text logs."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def log_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of logs whose records span lines, for ``logs.blocks``. A file is one row, so one of 2 GB cannot be read."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def csv_union(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files with headers, united by column name; what a file lacks is null."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_that_works(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read, in order; the last one's error if none can."""
    for k, source in enumerate(sources):
        try:
            df = source()
            df.take(1)
            return df
        except Exception:
            if k == len(sources) - 1:
                raise
    raise ValueError("no source")


def jdbc_roads(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def wkb_points(wkb: bytes | None) -> list[tuple[float, float]] | None:
    """(lon, lat) of a WKB line string, either byte order."""
    if not wkb:
        return None
    order = "<" if wkb[0] == 1 else ">"
    kind, n = struct.unpack(f"{order}II", wkb[1:9])
    if kind & 0xFF != 2:
        return None
    flat = struct.unpack(f"{order}{2 * n}d", wkb[9 : 9 + 16 * n])
    return list(zip(flat[::2], flat[1::2], strict=True))


# Columns of the road table, and the tags that ways take from them.
ROAD_COLUMNS = ["rover_way_id", "osm_id", "geom_wkb", "highway", "name", "surface", "lanes", "oneway", "foot_access", "bicycle_access", "indoor", "service_type"]
ROAD_TAGS = {"highway": "highway", "name": "name", "surface": "surface", "lanes": "lanes", "oneway": "oneway", "foot_access": "foot_access", "bicycle_access": "bicycle_access", "indoor": "indoor", "service": "service_type"}
ROAD_TABLE, NODES_A_WAY = "api.v_osm_dubai_rover", 1000


def road_query(table: str = ROAD_TABLE) -> str:
    """For ``jdbc_roads``: only the columns in use, places as WKB."""
    columns = ", ".join("ST_AsBinary(geom) AS geom_wkb" if c == "geom_wkb" else c for c in ROAD_COLUMNS)
    return f"(SELECT {columns} FROM {table}) AS roads"


def _lines(wkb: pd.Series) -> pd.Series:
    return wkb.map(lambda b: None if (line := wkb_points(b)) is None else [{"lat": y, "lon": x} for x, y in line])


def roads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways (id, node_ids, tags) and nodes (id, lat, lon) of rows with ROAD_COLUMNS, for ``graph.build_edges``.

    A way's k-th node is way * 1000 + k. Null tags and lanes=0 are left out, flags that are null read false; rows without id
    or whose shape is no line string are left out. A way of over 1,000 nodes is an error, as its ids would be another's.
    """
    ship(rows.sparkSession)
    points = F.pandas_udf(_lines, "array<struct<lat:double,lon:double>>")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("string")
    value = {"lanes": F.when(F.col("lanes") != 0, F.col("lanes").cast("string")), "oneway": flag("oneway"), "indoor": flag("indoor")}
    tags = F.map_filter(F.create_map(*(x for tag, c in ROAD_TAGS.items() for x in (F.lit(tag), value.get(c, F.col(c).cast("string"))))), lambda k, v: v.isNotNull())
    way = F.col("rover_way_id").cast("long")
    lines = rows.select(way.alias("id"), points("geom_wkb").alias("line"), tags.alias("tags")).where("id is not null and line is not null")
    error = F.raise_error(F.concat(F.lit("too many nodes in way "), "id")).cast("array<struct<lat:double,lon:double>>")
    fits = F.when(F.size("line") > NODES_A_WAY, error).otherwise(F.col("line"))
    lines = lines.withColumn("line", fits)
    ways = lines.select("id", F.transform("line", lambda p, k: F.col("id") * NODES_A_WAY + k).alias("node_ids"), "tags")
    nodes = lines.select("id", F.posexplode("line").alias("k", "p")).select((F.col("id") * NODES_A_WAY + F.col("k")).alias("id"), "p.lat", "p.lon")
    return ways, nodes


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and envelopes that ``writers.write_graph`` has written."""
    nodes, edges, boxes = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "spatial_index"))
    return nodes, edges, boxes


# --- OSM PBF -------------------------------------------------------------------------------------------------------


def _varint(b: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[at]
        at += 1
        x |= (c & 0x7F) << shift
        if c < 0x80:
            return x, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            x, at = _varint(b, at)
        elif key & 7 == 2:
            n, at = _varint(b, at)
            x, at = b[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            x, at = b[at : at + n], at + n
        yield key >> 3, x


def _numbers(b: bytes, signed: bool = False, delta: bool = False) -> list[int]:
    out, at, total = [], 0, 0
    while at < len(b):
        x, at = _varint(b, at)
        x = (x >> 1) ^ -(x & 1) if signed else x
        total = total + x if delta else x
        out.append(total)
    return out


def _block_rows(block: bytes) -> tuple[list, list]:
    f: dict[int, list] = {}
    for k, v in _fields(block):
        f.setdefault(k, []).append(v)
    strings = [v.decode("utf-8", "replace") for k, v in _fields(f[1][0]) if k == 1] if 1 in f else []
    scale, lat0, lon0 = f.get(17, [100])[0], f.get(19, [0])[0], f.get(20, [0])[0]
    place = lambda x, zero: (zero + scale * x) * 1e-9
    nodes, ways = [], []
    for group in f.get(2, []):
        for k, v in _fields(group):
            if k == 2:
                d = dict(_fields(v))
                for i, la, lo in zip(*(_numbers(d[j], True, True) for j in (1, 8, 9)), strict=True):
                    nodes.append((i, place(la, lat0), place(lo, lon0)))
            elif k == 1:
                d = {j: x for j, x in _fields(v)}
                zig = lambda x: (x >> 1) ^ -(x & 1)
                nodes.append((zig(d[1]), place(zig(d[8]), lat0), place(zig(d[9]), lon0)))
            elif k == 3:
                d = {j: x for j, x in _fields(v)}
                tags = dict(zip((strings[i] for i in _numbers(d.get(2, b""))), (strings[i] for i in _numbers(d.get(3, b""))), strict=True))
                if "highway" in tags:
                    ways.append((d[1], _numbers(d.get(8, b""), True, True), tags))
    return nodes, ways


def _pbf_blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at + 4 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        head = dict(_fields(data[at + 4 : at + 4 + n]))
        at += 4 + n
        blob = dict(_fields(data[at : at + head[3]]))
        at += head[3]
        if head[1] == b"OSMData":
            yield zlib.decompress(blob[3]) if 3 in blob else blob[1]


def osm_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of OSM PBF files: nodes (id, lat, lon) with each block's own scale and offset, ways with a highway tag
    (id, node_ids, tags). Files are cut into their compressed blocks first, which are then decoded in parallel."""

    def cut(rows):
        import pandas as pd

        for pdf in rows:
            for data in pdf["content"]:
                for block in _pbf_blocks(bytes(data)):
                    yield pd.DataFrame({"block": [block]})

    def nodes(rows):
        import pandas as pd

        for pdf in rows:
            for b in pdf["block"]:
                yield pd.DataFrame(_block_rows(bytes(b))[0], columns=["id", "lat", "lon"])

    def ways(rows):
        import pandas as pd

        for pdf in rows:
            for b in pdf["block"]:
                yield pd.DataFrame(_block_rows(bytes(b))[1], columns=["id", "node_ids", "tags"])

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "block binary").repartition(spark.sparkContext.defaultParallelism)
    return blocks.mapInPandas(nodes, "id long, lat double, lon double"), blocks.mapInPandas(ways, "id long, node_ids array<long>, tags map<string,string>")
