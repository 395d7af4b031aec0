"""Scoring, alerts and statistics of request streams.

Sinks written batch by batch put each micro-batch in its own folder and overwrite it, so a
repeated batch after a failure replaces its rows instead of adding them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.verdicts import anomaly_flag
from tidewatch.operators.isolation_forest import IsolationForestModel, normalise_score
from tidewatch.operators.summaries import request_alerts, system_stats
from tidewatch.plans.models import PublishedModel
from tidewatch.sources.sinks import append_alerts

AVAILABLE_NOW = {"availableNow": True}


def score_stream(stream: DataFrame, model: IsolationForestModel, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Score and judge row by row into a Parquet table, exactly once."""
    return (model.transform(stream).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                trigger: dict | None, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def score_requests_stream(stream: DataFrame, root: str, path: str, checkpoint: str,
                          trigger: dict | None = None) -> StreamingQuery:
    """Verdicts and raw scores by the newest published model, a folder per micro-batch.

    ``read_request_scores`` rescales them by request, whose rows may come in any number of
    micro-batches. Models are swapped between micro-batches without a restart; without any model
    the query fails.
    """
    published = PublishedModel(stream.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = published.current().transform(batch)
        scored.withColumn("model_version", F.lit(published.version)).write.mode(
            "overwrite").parquet(f"{path}/batch={batch_id}")

    return _each_batch(stream, write, checkpoint, trigger)


def read_request_scores(spark: SparkSession, path: str, request: str = "request_id",
                        which: Column | None = None) -> DataFrame:
    """Scores rescaled within each request, over all micro-batches it came in.

    ``which`` limits the rows read to some requests, e.g. those of a day.
    """
    rows = spark.read.option("basePath", path).parquet(path).drop("batch")
    return normalise_score(rows if which is None else rows.filter(which), by=request)


def alert_stream(stream: DataFrame, model: IsolationForestModel, path: str, checkpoint: str,
                 request: str = "request_id", ts: str = "ts",
                 trigger: dict | None = None) -> StreamingQuery:
    """What each micro-batch found per request, into the alert table of the batch job.

    ``read_alerts`` makes one alert of a request that came in several micro-batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_alerts(request_alerts(model.transform(batch), request, ts, partial=True),
                      path, str(batch_id))

    return _each_batch(stream, write, checkpoint, trigger)


def stats_stream(stream: DataFrame, model: IsolationForestModel, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Running totals and detection rate; one row of totals per micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _each_batch(system_stats(model.transform(stream)), write, checkpoint, trigger,
                       "complete")


def latest_stats(spark: SparkSession, path: str) -> DataFrame:
    """The totals after the last micro-batch."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("batch")).scalar()
    return table.filter(F.col("batch") == last).drop("batch")


def anomaly_windows(detections: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                    ts: str = "ts") -> DataFrame:
    """Samples and anomalies per tumbling window; batch or stream (closed windows only)."""
    rows = detections.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, watermark)
    return (rows.groupBy(F.window(ts, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("total_samples"),
                 F.sum(anomaly_flag(F.col("prediction"))).cast("long").alias("anomalies_found"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "total_samples", "anomalies_found"))
