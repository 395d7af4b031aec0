"""Windowed traffic features as keyed state: the hosts and services of a bucket share one state.

Of a host the rows are kept that its windows can still reach: the last n - 1, and those of its last
window of time; of a service the sums per time of its last window. Hosts and services fall into a
fixed number of buckets by a hash, and a bucket is worked out at once, as columns: Python is called
per bucket and micro-batch, not per host. A micro-batch reads and writes the buckets it has rows of,
so one of few rows is served well only while a bucket's hosts are few (``buckets``). State lives in
RocksDB with the query's checkpoint. Hosts and services that fall idle are dropped by timers.

One bucket is one task here. A host or service with most of the traffic is better served by
``flow_features_stream``, which splits keys within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.traffic import MICROS, rejected, syn_error, window_features
from tidewatch.streaming.scoring import _each_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HOST_SUMS = ["_h_n", "_h_syn", "_h_rej", "_p_n", "_l_n", "_l_syn", "_l_rej", "_ls_n", "_ls_syn", "_ls_rej", "_li_n", "_lp_n"]
SERVICE_SUMS = ["_s_n", "_s_syn", "_s_rej"]
#: Buckets of hosts, and of services. A checkpoint keeps the number it began with.
BUCKETS = 1024
_OUT = "conn_id long, named boolean, behind long, " + ", ".join(f"{c} long" for c in HOST_SUMS + SERVICE_SUMS)


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def like_me(code: np.ndarray, low: np.ndarray, high: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Per row the rows from place ``low`` to ``high`` of its own code: how many, and their weights."""
    size = len(code) + 1
    order = np.argsort(code, kind="stable")
    places = code[order].astype(np.int64) * size + order
    a = np.searchsorted(places, code * size + low)
    b = np.searchsorted(places, code * size + high, side="right")
    return [b - a, *[(sums := _running(w[order]))[b] - sums[a] for w in weights]]


def _spans(group: np.ndarray, t: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a group at a time: a number that sorts so, and that of the time ``span`` earlier in its group."""
    times, rank = np.unique(np.concatenate([t - span, t]), return_inverse=True)
    own = group * len(times)
    return own + rank[len(t):], own + rank[:len(t)]


def host_sums(rows: pd.DataFrame, host: np.ndarray, span: int, last_n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All sums of the rows of some hosts, and whether later windows reach a row.

    Rows are sorted by ``host`` (numbers from 0 on), time and ``conn_id``.
    """
    t, syn, rej = (rows[c].to_numpy() for c in ("t", "syn", "rej"))
    service = pd.factorize(rows["service"], use_na_sentinel=False)[0]
    caller = pd.factorize(rows["src_ip"], use_na_sentinel=False)[0]
    port = pd.factorize(rows["src_port"], use_na_sentinel=False)[0]
    here = np.arange(len(t))
    at, since = _spans(host, t, span)
    low, high = np.searchsorted(at, since), np.searchsorted(at, at, side="right") - 1
    begin, end = np.searchsorted(host, host), np.searchsorted(host, host, side="right")
    first = np.maximum(here - last_n + 1, begin)
    syns, rejs = _running(syn), _running(rej)
    out = {"_h_n": high - low + 1, "_h_syn": syns[high + 1] - syns[low], "_h_rej": rejs[high + 1] - rejs[low],
           "_p_n": like_me(service, low, high)[0], "_l_n": here - first + 1,
           "_l_syn": syns[here + 1] - syns[first], "_l_rej": rejs[here + 1] - rejs[first]}
    out["_ls_n"], out["_ls_syn"], out["_ls_rej"] = like_me(service, first, here, syn, rej)
    out["_li_n"] = like_me(service * (caller.max(initial=0) + 1) + caller, first, here)[0]
    out["_lp_n"] = like_me(port, first, here)[0]
    # A service alone may be missing as a port may: both are values of their own here.
    return out, here >= np.minimum(end - last_n + 1, low[end - 1])


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class FlowState(StatefulProcessor):
    """The rows of a bucket's hosts or services that later windows reach, and the sums of its new rows."""

    def __init__(self, span: int, last_n: int, idle: int | None):
        self.span, self.last_n, self.idle = span, last_n, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "due long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        due, kept = self.ring.get() or (None, None)
        kept = None if kept is None else _unpacked(bytes(kept))
        step = self._host if key[0] == "host" else self._service
        out, keep = step(fresh, kept)
        if kept is None:
            behind = np.zeros(len(out["t"]), np.int64)
        else:
            # What is kept of a host or service holds its latest row.
            newest = out["key"].map(kept.groupby("key")["t"].max())
            behind = np.where(newest.isna(), 0, np.maximum(newest.fillna(0).astype(np.int64) - out["t"], 0))
        self._keep(keep, due)
        none = np.zeros(len(behind), np.int64)
        yield pd.DataFrame({"conn_id": out["conn_id"], "named": out["named"], "behind": behind,
                            **{c: out.get(c, none) for c in HOST_SUMS + SERVICE_SUMS}})

    def _keep(self, keep: pd.DataFrame, due: int | None) -> None:
        """Store what is kept; the timer goes off when the first of its hosts or services is idle."""
        if self.idle is not None:
            first = int(self._idle_at(keep).min())
            if first != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                due = first
        self.ring.update((due, _packed(keep)))

    def _idle_at(self, keep: pd.DataFrame) -> pd.Series:
        """Per row the time in milliseconds when its host or service is forgotten."""
        return keep.groupby("key")["t"].transform("max") // 1000 + self.idle

    def _host(self, fresh: pd.DataFrame, kept: pd.DataFrame | None):
        own = fresh[["key", "t", "conn_id", "named", "syn", "rej", "src_ip", "src_port", "service"]].assign(new=True)
        rows = own if kept is None else pd.concat([kept.assign(new=False), own], ignore_index=True)
        host = pd.factorize(rows["key"])[0]
        # The order among equals is that of the rows: kept ones first.
        order = np.lexsort((rows["conn_id"].to_numpy(), rows["t"].to_numpy(), host))
        rows, host = rows.iloc[order].reset_index(drop=True), host[order]
        sums, reached = host_sums(rows, host, self.span, self.last_n)
        new = rows["new"].to_numpy(bool)
        out = {c: rows[c][new].reset_index(drop=True) for c in ("key", "t", "conn_id", "named")}
        return {**out, **{c: v[new] for c, v in sums.items()}}, rows[reached].drop(columns="new")

    def _service(self, fresh: pd.DataFrame, kept: pd.DataFrame | None):
        sums = fresh.assign(n=1)[["key", "t", "n", "syn", "rej"]]
        sums = (sums if kept is None else pd.concat([kept, sums])).groupby(["key", "t"], as_index=False).sum()
        names, group = np.unique(sums["key"].to_numpy(str), return_inverse=True)
        of_fresh = np.searchsorted(names, fresh["key"].to_numpy(str))
        order = np.lexsort((sums["t"].to_numpy(), group))
        sums, group = sums.iloc[order], group[order]
        size, t = len(sums), fresh["t"].to_numpy()
        at, since = _spans(np.concatenate([group, of_fresh]), np.concatenate([sums["t"].to_numpy(), t]), self.span)
        places = at[:size]
        low, high = np.searchsorted(places, since[size:]), np.searchsorted(places, at[size:], side="right")
        out = {c: fresh[c] for c in ("key", "t", "conn_id", "named")}
        for name, c in zip(SERVICE_SUMS, ("n", "syn", "rej"), strict=True):
            running = _running(sums[c].to_numpy())
            out[name] = running[high] - running[low]
        last = np.searchsorted(group, group, side="right") - 1
        return out, sums[places >= since[:size][last]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.ring.get()
        if found is not None:
            kept = _unpacked(bytes(found[1]))
            # Timers before the watermark go off, so all that are due by now are forgotten at once.
            awake = kept[self._idle_at(kept) >= timerValues.getCurrentWatermarkInMs()]
            if len(awake) == 0:
                self.ring.clear()
            else:
                # Spark removes the timer that went off.
                self._keep(awake, None)
        return iter(())

    def close(self) -> None:
        pass


def _keyed(conns: DataFrame, buckets: int) -> DataFrame:
    """Each connection once for its host and once for its service."""
    def key(column: str) -> Column:
        # A missing host or service is a key of its own.
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("none"))

    both = F.explode(F.array(F.struct(F.lit("host").alias("kind"), key("dst_ip").alias("key")),
                             F.struct(F.lit("service").alias("kind"), key("service").alias("key"))))
    rows = conns.select(
        both.alias("to"), "ts", F.unix_micros("ts").alias("t"),
        # A column of numbers without gaps stays one of whole numbers; no name sorts last.
        F.coalesce(F.col("conn_id").cast("long"), F.lit((1 << 63) - 1)).alias("conn_id"), F.col("conn_id").isNotNull().alias("named"),
        syn_error(F.col("flag")).alias("syn"), rejected(F.col("flag")).alias("rej"), "src_ip",
        F.col("src_port").cast("long").alias("src_port"), "service")
    host = F.col("to.kind") == "host"
    only = [F.when(host, F.col(c)).alias(c) for c in ("src_ip", "src_port", "service")]
    return rows.select(
        "to.kind", F.pmod(F.xxhash64("to.key"), F.lit(buckets)).cast("int").alias("bucket"), "to.key",
        "ts", "t", "conn_id", "named", "syn", "rej", *only)


def flow_state_stream(stream: DataFrame, path: str, checkpoint: str, window_seconds: float = 2.0, last_n: int = 100,
                      idle_seconds: float | None = None, late: str = "10 minutes",
                      trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """All 19 features of each connection (``conn_id``), written per micro-batch.

    Connections are expected in time order across micro-batches, in any order within one. A
    straggler, older than what its host or service had before, sees the rows still kept;
    ``behind_seconds`` says how late it is, else it is 0 (``read_stragglers``). Connections without
    a time are left out.

    Hosts are dealt into ``buckets``, and so are services; the number stays with a checkpoint. More suit small
    micro-batches over very many hosts.

    With ``idle_seconds`` a host or service without a connection for so long in event time is forgotten; that
    needs a watermark, and rows more than ``late`` behind it are dropped by Spark and counted in
    the query's progress (``ProgressLog``). Without it nothing is dropped and nothing forgotten.
    """
    spark = stream.sparkSession
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull())
    if idle_seconds is not None:
        rows = rows.withWatermark("ts", late)
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    state = FlowState(int(window_seconds * MICROS), last_n, idle)
    sums = _keyed(rows, buckets).groupBy("kind", "bucket").transformWithStateInPandas(
        statefulProcessor=state, outputStructType=_OUT, outputMode="Append",
        timeMode="None" if idle is None else "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = batch.groupBy(F.when(F.col("named"), F.col("conn_id")).alias("conn_id")).agg(
            F.max("behind").alias("behind"), *[F.sum(c).alias(c) for c in HOST_SUMS + SERVICE_SUMS])
        whole.select("conn_id", *window_features(), (F.col("behind") / MICROS).alias("behind_seconds")) \
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return _each_batch(sums, write, checkpoint, trigger)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read_stragglers(spark: SparkSession, path: str) -> DataFrame:
    """conn_id, behind_seconds, batch of connections older than what their key had seen before."""
    return spark.read.option("basePath", path).parquet(path).filter("behind_seconds > 0").select(
        "conn_id", "behind_seconds", "batch")
