"""Verdicts, truth flags and severities of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def verdict(score: Column, threshold: float | Column) -> Column:
    """``anomaly`` strictly above the threshold, ``normal`` otherwise; NULL score stays NULL."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score > limit, F.lit("anomaly")).when(score.isNotNull(), F.lit("normal"))


def with_verdict(df: DataFrame, score: str, threshold: float | Column,
                 output: str = "prediction") -> DataFrame:
    """The input with a verdict column; rows keep their identity."""
    return df.withColumn(output, verdict(F.col(score), threshold))


def anomaly_flag(prediction: Column) -> Column:
    """1 for ``anomaly``, 0 for any other verdict, NULL for none."""
    return (prediction == "anomaly").cast("int")


def truth_flag(df: DataFrame, label: str = "label") -> Column:
    """Truth as 0/1: text labels are compared with ``normal``, numeric ones are taken as they are."""
    if isinstance(df.schema[label].dataType, T.StringType):
        return (F.col(label) != "normal").cast("int")
    return F.col(label).cast("int")


# Severity cut-offs.
SEVERITY_LOW, SEVERITY_MEDIUM, SEVERITY_HIGH = 0.3, 0.6, 0.8


def severity(score: Column, low: float = SEVERITY_LOW, medium: float = SEVERITY_MEDIUM,
             high: float = SEVERITY_HIGH) -> Column:
    """Grade of a normalised score; each cut-off belongs to the higher grade."""
    return (
        F.when(score >= high, F.lit("high"))
        .when(score >= medium, F.lit("medium"))
        .when(score >= low, F.lit("low"))
        .when(score.isNotNull(), F.lit("none"))
    )


def land_flag(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """1 when a connection's source and destination address and port are the same."""
    return ((src_ip == dst_ip) & (src_port == dst_port)).cast("int")
