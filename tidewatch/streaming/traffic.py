"""Windowed traffic features of a connection stream.

Each micro-batch runs the batch operator over its rows and the earlier connections their windows
reach back to. What later micro-batches may need is kept as a log: an entry per micro-batch, with
at most ``last_n - 1`` rows per host and the rows of its last window, in folders by a hash of the
host. Every ``merge_every`` micro-batches the entry is the whole log merged. A micro-batch reads
the folders of its own hosts and the rows of the last window, so idle hosts cost nothing. Hosts
and services stay split over many tasks, as in the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidewatch.operators.traffic import flow_features
from tidewatch.session import drop_path, scratch_path, shuffles_removed
from tidewatch.streaming.scoring import _each_batch

MICROS = 1_000_000
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("dst_ip"), F.lit(BUCKETS)).cast("int")


def _last_rows(conns: DataFrame, last_n: int) -> DataFrame:
    """The last n - 1 rows of each host; the limit applies before the shuffle too."""
    order = Window.partitionBy("dst_ip").orderBy(F.desc("ts"), F.desc("conn_id"))
    return conns.withColumn("_back", F.row_number().over(order)).filter(
        F.col("_back") <= last_n - 1).drop("_back")


def _worth_keeping(conns: DataFrame, window_seconds: float, last_n: int,
                   idle_seconds: float | None) -> DataFrame:
    """Rows a later window can reach: the host's last n - 1, or within the window of the end.

    Hosts without a connection for ``idle_seconds`` before the end are forgotten.
    """
    at = F.unix_micros("ts")
    end = conns.agg(F.unix_micros(F.max("ts")).alias("end")).scalar()
    last = _last_rows(conns, last_n)
    if idle_seconds is not None:
        latest = conns.groupBy(F.col("dst_ip").alias("_host")).agg(F.max(at).alias("_latest"))
        awake = latest.filter(F.col("_latest") >= end - int(idle_seconds * MICROS))
        last = last.join(awake, F.col("dst_ip").eqNullSafe(F.col("_host")), "left_semi")
    recent = conns.filter(at >= end - int(window_seconds * MICROS))
    return last.unionByName(recent).dropDuplicates(["conn_id"])


def within_reach(kept: DataFrame, rows: DataFrame, window_seconds: float, last_n: int) -> DataFrame:
    """The kept rows that windows of ``rows`` reach: of their hosts, or in the window before them."""
    found = rows.agg(F.min(F.unix_micros("ts")).alias("start"),
                     F.collect_set(_bucket()).alias("buckets")).first()
    if found["start"] is None:
        return kept.drop("bucket").limit(0)
    hosts = rows.select(F.col("dst_ip").alias("_host")).distinct()
    own = kept.filter(F.col("bucket").isin(found["buckets"])).join(
        hosts, F.col("dst_ip").eqNullSafe(F.col("_host")), "left_semi")
    since = F.timestamp_micros(F.lit(found["start"] - int(window_seconds * MICROS)))
    recent = kept.filter(F.col("ts") >= since)
    return _last_rows(own, last_n).unionByName(recent).drop("bucket").dropDuplicates(["conn_id"])


def _entries(spark: SparkSession, state: str, before: int) -> list[tuple[int, bool]]:
    """(micro-batch, merged) of the entries to read: from the last merged one on."""
    try:
        found = spark.read.schema("merged boolean, batch long").option(
            "basePath", f"{state}/entries").parquet(f"{state}/entries").collect()
    except AnalysisException:
        return []
    entries = sorted((r["batch"], r["merged"]) for r in found if r["batch"] < before)
    last = max((batch for batch, merged in entries if merged), default=-1)
    return [e for e in entries if e[0] >= last]


def flow_features_stream(stream: DataFrame, path: str, state: str, checkpoint: str,
                         window_seconds: float = 2.0, last_n: int = 100,
                         merge_every: int = 20, idle_seconds: float | None = None,
                         trigger: dict | None = None) -> StreamingQuery:
    """All 19 features per connection, written per micro-batch.

    Connections are expected in time order across micro-batches, in any order within one; a
    straggler sees the connections still kept. ``merge_every`` may change with a restart: which
    entries are merged is stored with them. Entries that are merged twice over are deleted.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        steps: list[str] = []

        def stored(df: DataFrame) -> DataFrame:
            steps.append(scratch_path(df.sparkSession, "traffic"))
            df.write.parquet(steps[-1])
            return df.sparkSession.read.schema(df.schema).parquet(steps[-1])

        try:
            with shuffles_removed(batch.sparkSession):
                _write(batch, batch_id, stored)
        finally:
            for step in steps:
                drop_path(spark, step)

    def _write(batch: DataFrame, batch_id: int, stored: Callable[[DataFrame], DataFrame]) -> None:
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp")).persist()
        entries = _entries(spark, state, batch_id)
        seen, kept, since = rows.withColumn("_new", F.lit(True)), None, None
        if entries:
            schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
            kept = spark.read.schema(schema).option("basePath", state).parquet(
                *[f"{state}/batch={i}" for i, _ in entries])
            reached = within_reach(kept, rows, window_seconds, last_n)
            # Several scans follow; the micro-batch is matched with the log once.
            seen = stored(seen.unionByName(reached.select(*rows.columns).withColumn("_new", F.lit(False))))
            start = rows.agg(F.min(F.unix_micros("ts"))).first()[0]
            since = None if start is None else start - int(window_seconds * MICROS)
        (flow_features(seen, window_seconds, last_n, since=since, stored=stored).filter("_new").drop("_new")
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
        merge = kept is not None and len(entries) >= merge_every
        log = rows.unionByName(kept.select(*rows.columns)) if merge else rows
        (_worth_keeping(log.filter(F.col("ts").isNotNull()), window_seconds, last_n,
                        idle_seconds if merge else None)
         # Few files a bucket, not one of each task.
         .withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{state}/batch={batch_id}"))
        spark.createDataFrame([(merge,)], "merged boolean").coalesce(1).write.mode(
            "overwrite").parquet(f"{state}/entries/batch={batch_id}")
        rows.unpersist()
        if merge:
            # A repeated micro-batch reads what this one read; what came before that can go.
            for old in _older(spark, state, entries[0][0]):
                drop_path(spark, f"{state}/batch={old}")
                drop_path(spark, f"{state}/entries/batch={old}")

    return _each_batch(stream, write, checkpoint, trigger)


def _older(spark: SparkSession, state: str, first: int) -> list[int]:
    found = spark.read.schema("merged boolean, batch long").option(
        "basePath", f"{state}/entries").parquet(f"{state}/entries").select("batch").collect()
    return sorted(r["batch"] for r in found if r["batch"] < first)
