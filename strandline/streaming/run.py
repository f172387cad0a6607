"""Keeping streaming queries running: checkpoints, restarts after failures, watermark delays that follow the control loop."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import control

# Restarts after failures, and the pause before each.
RESTARTS, PAUSE_S = 10, 10.0


def keep_state_on_disk(spark: SparkSession) -> None:
    """State that outgrows the heap: new queries hold theirs in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def supervised(build: Callable[[], DataStreamWriter], checkpoint: str, restarts: int = RESTARTS, pause_s: float = PAUSE_S) -> StreamingQuery:
    """Runs a query until it stops, and starts it again from its checkpoint (in a shared folder) when it fails; the failure
    after the last restart is raised. File sinks and idempotent ``foreachBatch`` sinks see each row once."""
    for failed in itertools.count(1):
        query = build().option("checkpointLocation", checkpoint).start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if failed > restarts:
                raise
            time.sleep(pause_s)


def epochs(build: Callable[[int], DataStreamWriter], runtime: control.Runtime, checkpoint: str, stop: Callable[[], bool] = lambda: False) -> Iterator[StreamingQuery]:
    """An adaptive delay: each epoch reads what has arrived with the watermark delay that ``runtime`` then has, ends, and the next
    goes on from the same checkpoint. State and watermark are kept; a longer delay never moves the watermark back."""
    while not stop():
        query = build(runtime.delay_ms).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        yield query


def late_rows(query: StreamingQuery) -> int:
    """Rows (partial aggregates, where rows are combined first) that came after their windows had closed and were dropped, over
    the batches whose progress is still kept."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
