"""Moving-object events derived from the driver's ``events`` table: 50 objects, 50 events a second, a fifth of them late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same text runs in Spark SQL and in DuckDB but for the name of the string type.
SQL = """
SELECT CAST(seq AS {string}) AS id, seq, concat('obj-', CAST(obj AS {string})) AS object_id,
       1704067200000 + off - dis AS ts_ms, 1704067200000 + off AS ingest_ms,
       round(30.3158 + (hx+speed*tri*sin(h))/(111320*cos(radians(59.9391))),7) AS lon,
       round(59.9391 + (hy+speed*tri*cos(h))/111320,7) AS lat, speed
FROM (SELECT *, ((obj*37)%50)*4-100 AS hx, ((obj*11)%50)*4-100 AS hy, radians((obj*83)%360) AS h,
             CAST(1.5+(obj%10)*0.1 AS double) AS speed, abs((off/1000.0)%60 - 30) AS tri
      FROM (SELECT event_id AS seq, user_id % 50 AS obj, event_id*20 AS off,
                   CASE WHEN event_id % 5 = 0 THEN (event_id*7919) % 3000 ELSE 0 END AS dis FROM events) b) m
"""
ORACLE = "geo AS (" + SQL.format(string="varchar") + ")"


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return spark.sql(SQL.format(string="string").replace("FROM events", "FROM {events}"), events=events)
