"""Windowed traffic features against a brute-force count, batch and stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.traffic import (
    HOST_FEATURES, TIME_FEATURES, flow_features,
)
from tidewatch.schema import CONNECTION_SCHEMA
from tidewatch.streaming.traffic import (
    _bucket, _worth_keeping, flow_features_stream, within_reach,
)

FEATURES = TIME_FEATURES + HOST_FEATURES


def log(n, seed, hot=0.4, span=60.0, tick=0.25):
    """Random connections; one host and one service take a large share, times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = round(rng.random() * span / tick) * tick
        host = "hot" if rng.random() < hot else f"h{rng.randrange(5)}"
        rows.append((1704067200 + ts, i, f"s{rng.randrange(4)}", rng.randrange(6), host, 80,
                     rng.choice(["http", "http", "dns", "ssh"]),
                     rng.choice(["SF", "SF", "S0", "S1", "REJ"]), 1.0))
    return rows


def frame(spark, rows):
    names = [f.name for f in CONNECTION_SCHEMA]
    df = spark.createDataFrame(rows, "ts double, conn_id long, src_ip string, src_port int, "
                                     "dst_ip string, dst_port int, service string, flag string, "
                                     "bytes double")
    return df.withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).select(names)


def brute(rows, window, last_n):
    out = {}
    for r in rows:
        ts, cid, src, port, host, _, service, _, _ = r
        near = [x for x in rows if ts - window <= x[0] <= ts]
        h = [x for x in near if x[4] == host]
        s = [x for x in near if x[6] == service]
        p = [x for x in h if x[6] == service]
        last = sorted((x for x in rows if x[4] == host and (x[0], x[1]) <= (ts, cid)),
                      key=lambda x: (x[0], x[1]))[-last_n:]
        same = [x for x in last if x[6] == service]

        def rate(part, whole):
            return len(part) / len(whole)

        def syn(xs):
            return [x for x in xs if x[7] in ("S0", "S1", "S2", "S3")]

        def rej(xs):
            return [x for x in xs if x[7] == "REJ"]

        out[cid] = [
            len(h), len(s), rate(syn(h), h), rate(syn(s), s), rate(rej(h), h), rate(rej(s), s),
            rate(p, h), 1 - rate(p, h), 1 - rate(p, s), len(last), len(same), rate(same, last),
            1 - rate(same, last), rate([x for x in last if x[3] == port], last),
            rate([x for x in same if x[2] != src], same), rate(syn(last), last),
            rate(syn(same), same), rate(rej(last), last), rate(rej(same), same)]
    return out


def check(df, want):
    got = {r["conn_id"]: [r[c] for c in FEATURES] for r in df.collect()}
    assert set(got) == set(want)
    for cid, row in want.items():
        assert got[cid] == pytest.approx(row, abs=1e-9), cid


@pytest.mark.parametrize("cell,block", [(1.0, 16), (7.0, 10_000), (0.25, 11)])
def test_batch(spark, cell, block):
    rows = log(400, 7)
    df = flow_features(frame(spark, rows), 2.0, 10, cell_seconds=cell, block=block)
    check(df, brute(rows, 2.0, 10))


@pytest.mark.parametrize("block", [11, 10_000])
def test_earlier_connections_count_for_the_last_n_only(spark, block):
    """Rows from a window after ``since`` on are as without it; earlier ones are in no time window."""
    rows, t0 = log(300, 4), 1704067200.0
    df = flow_features(frame(spark, rows), 2.0, 10, block=block, since=int((t0 + 40) * 1_000_000)).cache()
    late = {cid: row for cid, row in brute(rows, 2.0, 10).items() if rows_at(rows, cid) >= t0 + 42}
    assert df.count() == 300 and len(late) > 50
    check(df.filter(F.col("ts").cast("double") >= t0 + 42), late)
    assert df.filter(F.col("ts").cast("double") < t0 + 40).filter("srv_count IS NOT NULL").count() == 0


def rows_at(rows, cid):
    return next(r[0] for r in rows if r[1] == cid)


@pytest.mark.parametrize("cell,block", [(1.0, 16), (70.0, 10_000)])
def test_host_features_alone(spark, cell, block):
    rows = log(300, 8)
    df = frame(spark, rows).withColumn("dst_ip", F.when(F.col("dst_ip") != "h1", F.col("dst_ip")))
    rows = [(*r[:4], None if r[4] == "h1" else r[4], *r[5:]) for r in rows]
    out = flow_features(df, 2.0, 10, cell_seconds=cell, block=block, time_windows=False)
    assert out.columns == df.columns + HOST_FEATURES
    want = brute(rows, 2.0, 10)
    for r in out.collect():
        assert [r[c] for c in HOST_FEATURES] == pytest.approx(want[r["conn_id"]][9:], abs=1e-9)


def test_window_longer_than_cells_and_all_rows_at_one_time(spark):
    rows = log(150, 3, span=30.0)
    check(flow_features(frame(spark, rows), 11.0, 5, cell_seconds=2.0), brute(rows, 11.0, 5))
    flood = log(120, 4, hot=1.0, span=0.0)
    check(flow_features(frame(spark, flood), 2.0, 7, block=9), brute(flood, 2.0, 7))


def test_before_the_epoch(spark):
    rows = [(r[0] - 1704067200 - 30, *r[1:]) for r in log(100, 9)]
    check(flow_features(frame(spark, rows), 2.0, 6, cell_seconds=3.0), brute(rows, 2.0, 6))


def test_connections_without_a_time(spark):
    rows = log(80, 6)
    df = frame(spark, rows)
    untimed = df.filter("conn_id < 7").withColumns({"conn_id": F.col("conn_id") + 1000, "ts": F.lit(None).cast("timestamp")})
    out = flow_features(df.unionByName(untimed), 2.0, 10)
    check(out.filter("conn_id < 1000"), brute(rows, 2.0, 10))
    assert [[r[c] for c in FEATURES] for r in out.filter("conn_id >= 1000").collect()] == [[None] * 19] * 7


def test_payload_and_guard(spark):
    rows = log(30, 1)
    df = frame(spark, rows).withColumn("note", F.concat(F.lit("n"), "conn_id"))
    out = flow_features(df)
    assert out.columns == df.columns + FEATURES
    assert all(r["note"] == f"n{r['conn_id']}" for r in out.collect())
    with pytest.raises(ValueError):
        flow_features(df, last_n=100, block=50)


def test_plan(spark):
    """The log is shuffled by number cell, by (host, service, time) and by block; sums are narrow."""
    df = flow_features(frame(spark, log(300, 1)).withColumn("note", F.lit("n")), cell_seconds=1.0)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "SinglePartition" not in plan and "Python" not in plan and "BroadcastNestedLoop" not in plan


def test_a_burst_at_one_time_is_many_cells(spark):
    """All of a host's connections at one instant: numbers come from many cells of few ids."""
    rows = [(1704067200.0, i, f"s{i % 3}", i % 4, "hot", 80, "http" if i % 5 else "dns", "S0" if i % 7 else "SF", 1.0)
            for i in range(200)] + [(1704067201.0, 300, "s", 1, "hot", 80, "http", "SF", 1.0)]
    df = flow_features(frame(spark, rows), 2.0, 10, block=16, cell_ids=7)
    check(df, brute(rows, 2.0, 10))
    many = spark.range(40_000).select(
        F.timestamp_micros(F.lit(1704067200000000)).alias("ts"), F.col("id").alias("conn_id"), F.lit("s").alias("src_ip"),
        F.lit(1).alias("src_port"), F.lit("hot").alias("dst_ip"), F.lit(80).alias("dst_port"), F.lit("http").alias("service"),
        F.lit("SF").alias("flag"), F.lit(1.0).alias("bytes"))
    out = flow_features(many, cell_ids=1000, block=1000).agg(
        F.min("count"), F.max("srv_count"), F.sum("dst_host_count"), F.min("same_srv_rate")).first()
    assert list(out) == [40_000, 40_000, 99 * 100 // 2 + 100 * (40_000 - 99), 1.0]


def test_a_stray_time_changes_nothing_for_others(spark):
    """A connection of 1970 in a log of today leaves every other row, and every cell, as it was."""
    rows = log(120, 12, span=5.0)
    stray = [(0.0, 9999, "s0", 1, "hot", 80, "http", "SF", 1.0)]
    check(flow_features(frame(spark, rows + stray), 2.0, 10), brute(rows + stray, 2.0, 10))


def test_a_small_batch_reaches_only_its_hosts(spark):
    """Ten rows after 20,000 of idle hosts: the rows of their hosts and of the last window."""
    kept = frame(spark, [(1704067200.0 + i / 1000, i, "s", 1, f"idle{i % 4000}", 80, "http", "SF", 1.0) for i in range(20_000)])
    rows = frame(spark, [(1704067400.0 + i, 50_000 + i, "s", 1, f"idle{i % 2}", 80, "http", "SF", 1.0) for i in range(10)])
    kept = kept.withColumn("bucket", _bucket())
    assert within_reach(kept, rows, 2.0, 100).count() == 10         # five rows of each of two hosts
    assert within_reach(kept, rows, 181.0, 100).count() == 10 + 1000 - sum(i % 4000 < 2 for i in range(19_000, 20_000))
    assert within_reach(kept, rows.filter("false"), 2.0, 100).count() == 0


@pytest.mark.parametrize("merge_every", [(2, 2), (20, 20), (20, 2), (1, 3)])
def test_stream_equals_batch(spark, tmp_path, merge_every):
    rows = sorted(log(240, 5))
    path, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "checkpoint"))
    source = str(tmp_path / "log")
    conns = frame(spark, rows).cache()
    bounds = [1704067200 + x for x in (0, 12, 14, 33, 34.5, 61)]

    def add(i):
        part = conns.filter((F.col("ts").cast("double") >= bounds[i])
                            & (F.col("ts").cast("double") < bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(source)

    def run(every):
        stream = spark.readStream.schema(conns.schema).option("maxFilesPerTrigger", 1) \
            .parquet(source)
        flow_features_stream(stream, path, state, checkpoint, 2.0, 10,
                             merge_every=every).awaitTermination()

    for i in range(3):
        add(i)
    run(merge_every[0])
    for i in range(3, 5):  # a restart goes on from the checkpoint, perhaps with other merges
        add(i)
    run(merge_every[1])
    check(spark.read.parquet(path), brute(rows, 2.0, 10))
    entries = sorted(int(p.name[6:]) for p in (tmp_path / "state").glob("batch=*"))
    assert entries == ([0, 1, 2, 3, 4] if merge_every[0] == 20 == merge_every[1] else entries)
    assert merge_every != (2, 2) or entries[0] > 0      # merged entries replace older ones


def test_idle_hosts_are_forgotten(spark):
    rows = frame(spark, [(1704067200.0 + t, i, "s", 1, h, 80, "http", "SF", 1.0)
                         for i, (t, h) in enumerate([(0, "old"), (50, "new"), (60, "new")])])
    kept = _worth_keeping(rows, 2.0, 100, 30.0)
    assert {r["dst_ip"] for r in kept.collect()} == {"new"}
    assert _worth_keeping(rows, 2.0, 100, None).count() == 3


def test_a_micro_batch_leaves_no_shuffle_files_and_no_steps(spark, tmp_path):
    """Those of all micro-batches stayed till the driver collected its garbage."""
    import gc
    from pathlib import Path

    from tidewatch.session import CLEANUP, shared_dir

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = blocks.getAllFiles().iterator()
        names = iter(lambda: found.next().getName() if found.hasNext() else None, None)
        return {name for name in names if name.startswith("shuffle_")}

    def steps():
        return set(Path(shared_dir(spark).removeprefix("file:"), "tidewatch").glob("traffic-*"))

    rows, source = log(120, 7), str(tmp_path / "log")
    for i in range(3):
        frame(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CONNECTION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    gc.collect()
    before, left, was = shuffles(), steps(), spark.conf.get(CLEANUP)
    flow_features_stream(stream, *(str(tmp_path / n) for n in ("out", "state", "checkpoint")), 2.0, 10).awaitTermination()
    assert shuffles() <= before and spark.conf.get(CLEANUP) == was
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    assert steps() <= left
