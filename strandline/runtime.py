"""What operators need of the session: shared scratch tables and shipping the package to workers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a fresh local one is set in local mode; on a cluster
    that is an error, since executors do not share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete shuffle files of finished jobs now; else they stay until the driver happens to collect garbage."""
        for _ in range(2):  # the first round lets go of what Python still held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(1)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Deletes all of its tables; results that read them must have been written before."""
        self.drop("")


BATCH_CONF, BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048, "10000"


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each Spark context. Arrow batches get fewer rows than by
    default, since rows here are whole texts and both sides of the pipe hold batches; a setting of one's own stays."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == DEFAULT_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if getattr(sc, "_strandline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "strandline.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._strandline_shipped = True
