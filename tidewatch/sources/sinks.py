"""Sinks: detections, alerts, security events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("anomalies_found", T.LongType()), T.StructField("total_samples", T.LongType()),
    T.StructField("batch", T.StringType()), T.StructField("day", T.DateType()),
])


def write_detections(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Detections as CSV with header, or as Parquet."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def append_alerts(alerts: DataFrame, path: str, batch: str | None = None) -> None:
    """Alerts to a Parquet table with a folder per writing, and in it per day for pruning.

    A writing named by ``batch`` replaces itself when it is repeated; others get a new name. The
    rebalance hint gathers a day's rows into few files but still splits a day that holds most.
    """
    (alerts.withColumn("day", F.to_date("timestamp"))
     .hint("rebalance", "day")
     .write.mode("overwrite").partitionBy("day")
     .parquet(f"{path}/batch={batch or uuid.uuid4().hex}"))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert table: one alert per id, however many writings its request came in.

    Counts are added up and the latest time is taken; a request without an anomaly is no alert.
    """
    return _merged(_parts(spark, path))


def security_events(detections: DataFrame, severity: Column, source_ip: Column,
                    destination_ip: Column | None = None, event_type: str = "anomaly",
                    details: dict[str, Column] | None = None) -> DataFrame:
    """Structured security events of the detections judged anomalous."""
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return detections.filter(F.col("prediction") == "anomaly").select(
        F.lit(event_type).alias("event_type"),
        severity.alias("severity"),
        source_ip.cast("string").alias("source_ip"),
        (destination_ip if destination_ip is not None else F.lit(None)).cast("string")
        .alias("destination_ip"),
        (F.create_map(*pairs) if pairs else empty).alias("details"),
    )


EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("source_ip", T.StringType()), T.StructField("destination_ip", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("logged_at", T.TimestampType()), T.StructField("batch", T.StringType()),
    T.StructField("day", T.DateType()),
])


def append_events(events: DataFrame, path: str, logged_at: Column | None = None,
                  batch: str | None = None) -> None:
    """Security events to a Parquet table with a folder per writing, and in it per day.

    ``logged_at`` is when the event happened, without it the time of writing. A writing named by
    ``batch`` replaces itself when it is repeated.
    """
    at = F.current_timestamp() if logged_at is None else logged_at.cast("timestamp")
    (events.withColumn("logged_at", at).withColumn("day", F.to_date("logged_at"))
     .hint("rebalance", "day")
     .write.mode("overwrite").partitionBy("day")
     .parquet(f"{path}/batch={batch or uuid.uuid4().hex}"))


def read_events(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """Stored security events; ``which`` may ask for days or severities, and prunes folders of days."""
    events = spark.read.schema(EVENT_SCHEMA).option("basePath", path).parquet(path)
    return (events if which is None else events.filter(which)).drop("batch")


def close_days(spark: SparkSession, path: str, until: str) -> None:
    """Merge the alert table's days before ``until`` (yyyy-mm-dd): one row per alert, few files.

    For days that no further row of a request will come for. Alerts of closed days are a table of
    their own below ``path``-closed, with their number per day; writings stay as they are and are
    read from ``until`` on only. May be repeated, also after a failure, and for a later day.
    """
    closed, since = f"{path}-closed", closed_until(spark, path, until)
    day = F.to_date(F.lit(until))
    parts = _parts(spark, path).filter(F.col("day") < day)
    if since is not None:
        parts = parts.filter(F.col("day") >= F.lit(since))
    alerts = _merged(parts).withColumn("day", F.to_date("timestamp"))
    # A folder per closing: a repeated one replaces itself, one that failed is not marked.
    (alerts.hint("rebalance", "day").write.mode("overwrite").partitionBy("day")
     .parquet(f"{closed}/alerts/until={until}"))
    done = spark.read.schema(alerts.schema).option("basePath", f"{closed}/alerts").parquet(
        f"{closed}/alerts/until={until}")
    counts = done.groupBy("day").agg(F.count(F.lit(1)).alias("alerts"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{closed}/counts/until={until}")
    spark.createDataFrame([(until,)], "day string").coalesce(1).write.mode("overwrite").json(
        f"{closed}/marks/until={until}")


def closed_until(spark: SparkSession, path: str, before: str | None = None):
    """The first day that is not closed; None if none is. ``before``: by closings for earlier days."""
    try:
        marks = spark.read.schema("day string").json(f"{path}-closed/marks")
        if before is not None:
            marks = marks.filter(F.col("day") < before)
        return marks.agg(F.max(F.to_date("day"))).first()[0]
    except AnalysisException:
        return None


def latest_alerts(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The latest n alerts in arrival order with the number of all, as ``recent_alerts`` gives them.

    Open days are merged; of closed ones only so many of the last are read as hold what is still
    missing, and the number of the others' alerts is stored.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    since = closed_until(spark, path)
    parts = _parts(spark, path)
    found = _merged(parts if since is None else parts.filter(F.col("day") >= F.lit(since)))
    stored = 0
    if since is not None:
        root = f"{path}-closed"
        counts = spark.read.schema("day date, alerts long").option("basePath", f"{root}/counts").parquet(f"{root}/counts")
        # One row per day: a few thousand, however many alerts.
        days = counts.groupBy("day").agg(F.sum("alerts").alias("alerts")).orderBy(F.desc("day")).collect()
        stored = sum(r["alerts"] for r in days)
        enough, first = 0, None
        for r in days:
            if enough >= n:
                break
            enough, first = enough + r["alerts"], r["day"]
        if first is not None:
            closed = spark.read.schema("id string, timestamp timestamp, anomalies_found long, total_samples long, "
                                       "until string, day date").option("basePath", f"{root}/alerts").parquet(f"{root}/alerts")
            own = closed.filter(F.col("day") >= F.lit(first)).select(*found.columns)
            found = found.withColumn("_open", F.lit(True)).unionByName(own.withColumn("_open", F.lit(False)))
    if "_open" not in found.columns:
        found = found.withColumn("_open", F.lit(True))
    order = ["timestamp", F.length("id"), "id"]
    total = found.agg(F.count_if("_open")).scalar() + F.lit(stored)
    latest = found.orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).limit(n)
    return latest.orderBy(*order).drop("_open").withColumn("total_alerts", total)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).option("basePath", path).parquet(path)


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(
        F.max("timestamp").alias("timestamp"), F.sum("anomalies_found").alias("anomalies_found"),
        F.sum("total_samples").alias("total_samples")).filter("anomalies_found > 0")
