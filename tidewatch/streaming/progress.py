"""What streams took in and what they dropped, as a table."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = ("query string, name string, run string, batch long, at timestamp, input_rows long, "
                   "dropped_rows long, state_rows long, watermark timestamp")


class ProgressLog(StreamingQueryListener):
    """Writes a small file per finished micro-batch of every query: ``read_progress`` is the table.

    ``dropped_rows`` are those behind the watermark that stateful operators left out. A micro-batch
    that is repeated after a failure replaces its file. Add it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended = 0

    def wait(self, queries: int, seconds: float = 60.0) -> None:
        """Until so many queries have ended: progress comes a little later than the rows."""
        until = time.time() + seconds
        while self.ended < queries and time.time() < until:
            time.sleep(0.05)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = {"query": str(progress.id), "name": progress.name, "run": str(progress.runId), "batch": progress.batchId,
               "at": progress.timestamp, "input_rows": progress.numInputRows,
               "dropped_rows": sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
               "state_rows": sum(op.numRowsTotal for op in progress.stateOperators),
               "watermark": (progress.eventTime or {}).get("watermark")}
        # The driver writes one line itself: a Spark job has no place in a listener.
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/query={progress.id}/batch-{progress.batchId}.json")
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryTerminated(self, event) -> None:
        self.ended += 1


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch of every query that was logged."""
    return spark.read.schema(PROGRESS_SCHEMA).option("recursiveFileLookup", "true").json(path)
