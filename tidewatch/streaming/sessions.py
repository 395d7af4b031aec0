"""Sessions of a host's traffic, and rows that were sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.traffic import rejected, syn_error


def host_sessions(conns: DataFrame, gap: str = "30 minutes", host: str = "dst_ip", ts: str = "ts",
                  watermark: str = "1 hour") -> DataFrame:
    """Runs of a host's connections with no more than ``gap`` from one to the next.

    host, session_start, session_end (time of the last connection), connections, bytes, syn_errors,
    rejections; a NULL host is a host. Batch or stream; a stream gives a session once the watermark
    has passed its end and the gap. Connections without a time are in no session. Sessions grow
    from partial ones of each task, so a flooded host is merged map-side first.
    """
    rows = conns.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(ts, watermark)
    return (rows.groupBy(F.session_window(ts, gap).alias("w"), host)
            .agg(F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("connections"),
                 F.sum("bytes").alias("bytes"), F.sum(syn_error(F.col("flag"))).alias("syn_errors"),
                 F.sum(rejected(F.col("flag"))).alias("rejections"))
            .select(host, F.col("w.start").alias("session_start"), "session_end", "connections", "bytes",
                    "syn_errors", "rejections"))


def sent_once(stream: DataFrame, key: list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The stream without rows whose ``key`` came before, up to ``within`` apart in event time.

    The keys of the last ``within`` are state; older ones go with the watermark. Put it ahead of
    scoring, alerts or totals, so that a file or message sent twice changes none of them. On a
    batch all repeats go. Rows with a NULL in the key are equal to one another, as in a batch.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if not rows.isStreaming:
        return rows.dropDuplicates(key)
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
