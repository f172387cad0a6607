"""Sinks: files, tables over JDBC, JSON, GeoJSON, Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.trajectories import geojson_line, lines


def append_csv(path: str):
    """For ``foreachBatch``: appends each batch as CSV; the batch's number is part of the folder, so a repeat replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return write


def jdbc_batches(url: str, table: str, batch_size: int = 200, **properties: str):
    """For ``foreachBatch``: appends with the batch's number as a column, so that repeats can be told (and be made unique)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.option("batchsize", batch_size).jdbc(url, table, mode="append", properties=properties)

    return write


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def to_kafka(rows: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    out = rows.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.compression.type", "lz4").option("topic", topic).save()


def trajectory_batches(path: str):
    """For ``foreachBatch`` of telemetry: Parquet of each batch, and one GeoJSON line for each rover, written by executors."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/parquet/batch_{number}")
        lines(batch).select("roverId", geojson_line("roverId", "coords").alias("value")).write.mode("overwrite").partitionBy("roverId").text(f"{path}/geojson/batch_{number}")

    return write


def write_graph(nodes: DataFrame, edges: DataFrame, boxes: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("spatial_index", boxes)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
