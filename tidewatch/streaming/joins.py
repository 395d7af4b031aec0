"""Streams joined with what comes later or changes slowly: truth labels and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidewatch.plans.pipelines import evaluate_detector
from tidewatch.streaming.scoring import AVAILABLE_NOW, _each_batch

LABELLED_AT = "labelled_at"


def with_truth(detections: DataFrame, labels: DataFrame, key: str, label: str = "label", ts: str = "ts",
               labelled_at: str = LABELLED_AT, early: str = "0 seconds", within: str = "1 hour",
               late: str = "10 minutes") -> DataFrame:
    """Detections with the truth labels given to them, batch or stream.

    A label counts if it was given from ``early`` before the detection to ``within`` after it. On
    streams both sides wait for one another in keyed state, as long as the watermarks (``late``
    behind the latest time of the slower side) say that a partner may come; then the state goes. A
    detection without a label comes out with NULL once its time for one is over, at the end of a
    stream not at all until the watermark gets there. A detection with several labels comes out
    with each, one with a NULL key or time with none.
    """
    given = labels.select(F.col(key).alias("_truth_key"), F.col(label).alias(label),
                          F.col(labelled_at).cast("timestamp").alias(labelled_at))
    found = detections.withColumn(ts, F.col(ts).cast("timestamp"))
    if detections.isStreaming or labels.isStreaming:
        given = given.withWatermark(labelled_at, late)
        found = found.withWatermark(ts, late)
    in_time = ((F.col(key) == F.col("_truth_key"))
               & (F.col(labelled_at) >= F.col(ts) - F.expr(f"interval {early}"))
               & (F.col(labelled_at) <= F.col(ts) + F.expr(f"interval {within}")))
    return found.join(given, in_time, "left_outer").drop("_truth_key")


def truth_stream(detections: DataFrame, labels: DataFrame, key: str, path: str, checkpoint: str,
                 trigger: dict | None = None, **times) -> StreamingQuery:
    """``with_truth`` of two streams into a Parquet table, exactly once."""
    return (with_truth(detections, labels, key, **times).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def evaluate_stream(spark: SparkSession, path: str, label: str = "label") -> dict:
    """The detector's metrics over what ``truth_stream`` labelled so far, and how much that is."""
    rows = spark.read.parquet(path)
    total, known = rows.agg(F.count(F.lit(1)), F.count(label)).first()
    return {"detections": total, "labelled": known, **evaluate_detector(rows.filter(F.col(label).isNotNull()), label)}


def publish_table(table: DataFrame, root: str) -> int:
    """Write a further version of a reference table; it counts once Spark has marked it complete."""
    version = (newest_table(table.sparkSession, root) or 0) + 1
    table.write.mode("overwrite").parquet(f"{root}/version={version}")
    marker = table.sparkSession.createDataFrame([(version,)], "version int").coalesce(1)
    marker.write.mode("append").json(f"{root}/published")
    return version


def newest_table(spark: SparkSession, root: str) -> int | None:
    """The newest published version below ``root``."""
    try:
        return spark.read.schema("version int").json(f"{root}/published").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def enriched_stream(stream: DataFrame, root: str, on: Sequence[str], path: str, checkpoint: str,
                    trigger: dict | None = None) -> StreamingQuery:
    """A stream joined with the newest published table, which is looked up for every micro-batch.

    A plain stream-static join keeps the files it listed when it began; here a changed row shows in
    the next micro-batch. Rows without a partner stay, with NULLs. Spark picks the join by size. A
    folder per micro-batch; ``table_version`` says which version it was joined with.
    """
    spark, on = stream.sparkSession, list(on)

    def write(batch: DataFrame, batch_id: int) -> None:
        version = newest_table(spark, root)
        if version is None:
            raise FileNotFoundError(f"no published table below {root}")
        table = spark.read.parquet(f"{root}/version={version}")
        batch.join(table, on, "left").withColumn("table_version", F.lit(version)).write.mode(
            "overwrite").parquet(f"{path}/batch={batch_id}")

    return _each_batch(stream, write, checkpoint, trigger)
