"""Data-set and detection summaries, alerts, rankings and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.hashing import digest, digest_below
from tidewatch.schema import CATEGORICAL, LABEL, feature_dictionary, features_by_importance
from tidewatch.session import scratch_path


def dataset_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: number of samples and of features."""
    return df.agg(F.count(F.lit(1)).alias("samples"),
                  F.lit(len([c for c in df.columns if c != label])).alias("features"))


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label, most frequent first, label as tie-break."""
    return (df.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), label))


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = (df.filter(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
                       .alias("t")).scalar()
    return counts.withColumn("weight", total["rows"] / (total["classes"] * F.col("n")))


def _anomalies(prediction: str = "prediction") -> Column:
    return F.count_if(F.col(prediction) == "anomaly")


def anomaly_summary(detections: DataFrame) -> DataFrame:
    """One row: samples, anomalies and their share in percent; no share for no samples."""
    n = F.count(F.lit(1))
    return detections.agg(
        n.alias("total_samples"), _anomalies().alias("anomalies_found"),
        F.when(n > 0, 100.0 * _anomalies() / n).alias("anomaly_rate"))


def request_summary(detections: DataFrame, request: str = "request_id") -> DataFrame:
    """Samples and anomalies per request."""
    return detections.groupBy(request).agg(
        F.count(F.lit(1)).alias("total_samples"), _anomalies().alias("anomalies_found"))


def system_stats(detections: DataFrame) -> DataFrame:
    """One row of running totals; the rate is 0 when nothing was seen."""
    n = F.count(F.lit(1))
    return detections.agg(
        n.alias("total_traffic_analyzed"), _anomalies().alias("total_anomalies_detected"),
        F.when(n > 0, 100.0 * _anomalies() / n).otherwise(0.0).alias("detection_rate"))


def request_alerts(detections: DataFrame, request: str = "request_id",
                   ts: str = "ts", partial: bool = False) -> DataFrame:
    """One alert per request with an anomaly. The id follows the request, so a rerun repeats it.

    ``partial`` also gives requests without one, whose further rows may still come.
    """
    per_request = detections.groupBy(request).agg(
        F.max(ts).alias("timestamp"), _anomalies().alias("anomalies_found"),
        F.count(F.lit(1)).alias("total_samples"))
    return per_request.filter(F.lit(partial) | (F.col("anomalies_found") > 0)).select(
        F.concat(F.lit("alert_"), F.col(request).cast("string")).alias("id"),
        "timestamp", "anomalies_found", "total_samples")


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    """The latest n alerts in arrival order, with the number of all alerts; 0 gives none.

    Alerts of one time are ordered by id, a shorter one first, so that ``alert_9`` comes before
    ``alert_10``. The alerts are written first: they are read twice and may stand for a scoring.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    spark, path = alerts.sparkSession, scratch_path(alerts.sparkSession, "alerts")
    alerts.write.parquet(path)
    alerts = spark.read.schema(alerts.schema).parquet(path)
    total = alerts.agg(F.count(F.lit(1)).alias("total")).scalar()
    order = ["timestamp", F.length("id"), "id"]
    latest = alerts.orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).limit(n)
    return latest.orderBy(*order).withColumn("total_alerts", total)


def hash_split(df: DataFrame, key: list[str], test: float = 0.2, seed: int = 42,
               ) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of their key; the same on every partitioning."""
    in_test = digest_below(digest(seed, F.lit("split"), *key), test)
    return df.filter(~in_test), df.filter(in_test)


def select_by_importance(flows: DataFrame, levels: tuple[str, ...] = ("HIGH", "CRITICAL"),
                         keep: list[str] = ()) -> DataFrame:
    """The features of the given importance levels, in flow-file order; a pruned projection."""
    return flows.select(*keep, *[F.col(f"`{c}`") for c in features_by_importance(levels)])


def describe_features(features: DataFrame) -> DataFrame:
    """A table with a ``feature`` column, looked up in the feature dictionary (41 fixed rows).

    Encoded slots such as ``service_http`` are looked up by their column.
    """
    entries = feature_dictionary(features.sparkSession).withColumnsRenamed(
        {"feature": "__name", "importance": "importance_level"})
    name = F.coalesce(*[F.when(F.startswith("feature", F.lit(f"{c}_")), F.lit(c))
                        for c in CATEGORICAL], F.col("feature"))
    return features.withColumn("__name", name).join(entries, "__name", "left").drop("__name")
