"""Streams against the batch operators on the same rows; restarts, changing delays, late rows."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from strandline.operators import control, windows as win
from strandline.sources.fixture import geo_events
from strandline.streaming import models as m, run as r

SCHEMA = "object_id string, ts_ms long, ingest_ms long, seq long"


@pytest.fixture
def parts(spark, tmp_path):
    """Files of events in order of arrival, one of which comes after all others; the events."""
    e = geo_events(spark, "/root/testdata/sf0.001").where("seq < 600").select("object_id", "ts_ms", "ingest_ms", "seq").persist()
    for k in range(3):
        e.where(F.floor(F.col("seq") / 200) == k).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    flush = [(f"obj-{k}", 1704068000000, 0, 0) for k in range(50)]
    spark.createDataFrame(flush, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/b9"))
    yield (lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b*"))), e, tmp_path
    e.unpersist()


def to_files(df, at):
    return df.writeStream.format("parquet").option("path", str(at / "out")).outputMode("append").trigger(availableNow=True)


def rows(df, limit=1704067900000):
    return sorted(tuple(x) for x in df.where(F.col("window_start") < limit).select("object_id", "window_start", "window_end", "value").collect())


def test_sliding_stream_equals_batch(spark, parts):
    source, e, at = parts
    r.supervised(lambda: to_files(m.sliding_counts(m.with_time(source(), "dataflow", 4000), "object_id", 4, 2), at), str(at / "c"), restarts=0)
    assert rows(spark.read.parquet(str(at / "out"))) == rows(win.sliding_count(e, 4000, 2000, "object_id"))


def test_count_trigger_equals_batch(spark, parts):
    source, e, at = parts
    r.supervised(lambda: to_files(m.counts_every(source(), "object_id", 4000, 2, 4000), at), str(at / "c"), restarts=0)
    assert rows(spark.read.parquet(str(at / "out"))) == rows(win.multi_trigger_count(e, 4000, 2, "object_id", "ts_ms"))


def test_restart_goes_on_from_the_checkpoint(spark, parts):
    source, e, at = parts
    mark = str(at / "failed")

    def build():
        @F.udf("long")
        def once(seq):
            if seq == 450 and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")
            return seq

        broken = source().withColumn("seq", once("seq")).where("seq is not null")
        return to_files(m.counts(m.with_time(broken, "dataflow", 4000), "dynamic", "object_id", 5), at)

    r.supervised(build, str(at / "c"), pause_s=0.1)
    assert os.path.exists(mark) and rows(spark.read.parquet(str(at / "out"))) == rows(win.tumbling_count(e, 5000, "object_id"))


def test_failures_end_after_the_last_restart(spark, parts):
    source, _, at = parts
    tries = []

    def build():
        tries.append(1)
        return to_files(source().withColumn("x", F.raise_error(F.lit("always")).cast("string")), at)

    with pytest.raises(StreamingQueryException):
        r.supervised(build, str(at / "c"), restarts=2, pause_s=0.01)
    assert len(tries) == 3


def test_delay_changes_between_epochs(spark, tmp_path):
    runtime, seen = control.Runtime(delay_ms=0), []

    def arrive(k, *times):
        spark.createDataFrame([("a", t) for t in times], "object_id string, ts_ms long").coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))

    def build(delay_ms):
        seen.append(delay_ms)
        source = spark.readStream.schema("object_id string, ts_ms long").parquet(str(tmp_path / "in/b*"))
        return m.counts(m.with_time(source, "dataflow", delay_ms), "dynamic", "object_id", 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")

    arrive(0, 1000, 12_000)
    run = r.epochs(build, runtime, str(tmp_path / "c"), stop=lambda: len(seen) == 3)
    next(run)
    runtime.update(5000, 4000, 0)
    arrive(1, 2000, 17_000)  # 2000 is late: the watermark is at 12,000
    assert r.late_rows(next(run)) == 1
    arrive(2, 13_500, 30_000)  # 13,500 is not: the watermark is at 13,000
    assert r.late_rows(next(run)) == 0 and seen == [0, 4000, 4000] and next(run, None) is None
    got = {(x.window_start, x.value) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 1), (10_000, 2), (15_000, 1)}


def test_state_on_disk(spark, parts):
    source, e, at = parts
    key = "spark.sql.streaming.stateStore.providerClass"
    try:
        r.keep_state_on_disk(spark)
        r.supervised(lambda: to_files(m.counts(m.with_time(source(), "dataflow", 4000), "session", "object_id", 2), at), str(at / "c"), restarts=0)
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(str(at / "out")).count() > 0
