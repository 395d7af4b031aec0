"""Traffic features by keyed state: equal to a plain count over restarts, stragglers and idle keys."""

import pytest
from pyspark.sql import functions as F
from test_traffic import FEATURES, brute, check, frame, log

from tidewatch.streaming.flow_state import flow_state_stream, read_stragglers
from tidewatch.streaming.progress import ProgressLog, read_progress


class Log:
    """Connections that arrive in files, a file per micro-batch."""

    def __init__(self, spark, rows, path):
        self.spark, self.conns, self.path = spark, frame(spark, rows).cache(), path

    def add(self, which):
        self.conns.filter(which).coalesce(1).write.mode("append").parquet(str(self.path / "log"))

    def run(self, **settings):
        stream = self.spark.readStream.schema(self.conns.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "log"))
        flow_state_stream(stream, str(self.path / "out"), str(self.path / "checkpoint"), 2.0, 10, **settings).awaitTermination()
        return self.spark.read.option("basePath", str(self.path / "out")).parquet(str(self.path / "out"))


@pytest.mark.parametrize("settings", [{}, {"idle_seconds": 3600.0}])
def test_state_equals_plain_count_over_a_restart(spark, tmp_path, settings):
    rows = sorted(log(240, 5))
    feed = Log(spark, rows, tmp_path)
    bounds = [0, 12, 14, 33, 34.5, 61]
    slices = [(F.col("ts").cast("double") >= 1704067200 + a) & (F.col("ts").cast("double") < 1704067200 + b)
              for a, b in zip(bounds, bounds[1:], strict=False)]
    for part in slices[:3]:
        feed.add(part)
    feed.run(**settings)
    for part in slices[3:]:
        feed.add(part)
    got = feed.run(**settings)
    check(got.select("conn_id", *FEATURES), brute(rows, 2.0, 10))
    assert got.agg(F.max("behind_seconds")).first()[0] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_missing_hosts_and_services_are_keys(spark, tmp_path):
    rows = log(60, 9, span=6.0)
    feed = Log(spark, rows, tmp_path)
    missing = feed.conns.withColumns({"dst_ip": F.when(F.col("dst_ip") != "h1", F.col("dst_ip")),
                                      "service": F.when(F.col("service") != "dns", F.col("service"))})
    untimed = missing.limit(3).withColumns({"ts": F.lit(None).cast("timestamp"), "conn_id": F.col("conn_id") + 1000})
    feed.conns = missing.unionByName(untimed)
    feed.add("true")
    plain = [(*r[:4], None if r[4] == "h1" else r[4], r[5], None if r[6] == "dns" else r[6], *r[7:]) for r in rows]
    check(feed.run().select("conn_id", *FEATURES), brute(plain, 2.0, 10))


def test_stragglers_and_dropped_rows_are_tables(spark, tmp_path):
    """A straggler is computed and listed; a row behind the watermark is dropped and counted."""
    t0 = 1704067200.0
    rows = [(t0 + t, i, "s", 1, "a", 80, "http", "SF", 1.0) for i, t in enumerate([0, 100, 98, 200, 10, 199.5])]
    feed = Log(spark, rows, tmp_path)
    listener = ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        for ids in ("(0, 1)", "(2, 3)", "(4, 5)"):
            feed.add(f"conn_id IN {ids}")
        got = feed.run(idle_seconds=1000.0, late="20 seconds")
        listener.wait(1)
    finally:
        spark.streams.removeListener(listener)
    late = {r["conn_id"]: r["behind_seconds"] for r in read_stragglers(spark, str(tmp_path / "out")).collect()}
    assert late == {2: 2.0, 5: 0.5}
    assert {r["conn_id"]: r["count"] for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1}
    progress = read_progress(spark, str(tmp_path / "progress")).orderBy("batch").collect()
    # Row 4 goes as a row of its host and as one of its service.
    assert [r["dropped_rows"] for r in progress][:3] == [0, 0, 2]
    assert sum(r["input_rows"] for r in progress) == 6


def test_idle_hosts_expire(spark, tmp_path):
    t0 = 1704067200.0
    rows = [(t0 + t, i, "s", 1, h, 80, "http", "SF", 1.0)
            for i, (t, h) in enumerate([(0, "old"), (1, "new"), (50, "new"), (90, "new"), (95, "old"), (96, "new")])]
    feed = Log(spark, rows, tmp_path)
    for ids in ("(0, 1)", "(2)", "(3)", "(4, 5)"):
        feed.add(f"conn_id IN {ids}")
    got = {r["conn_id"]: r["dst_host_count"] for r in feed.run(idle_seconds=45.0, late="1 second").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 1, 5: 4}      # "old" was forgotten, "new" was not


@pytest.mark.parametrize("buckets", [1, 2])
def test_hosts_that_share_a_state_are_apart(spark, tmp_path, buckets):
    """One state for all hosts, and one for all services, gives what a state of each would."""
    rows = sorted(log(240, 7))
    feed = Log(spark, rows, tmp_path)
    for a, b in [(0, 12), (12, 33), (33, 61)]:
        feed.add((F.col("ts").cast("double") >= 1704067200 + a) & (F.col("ts").cast("double") < 1704067200 + b))
    check(feed.run(buckets=buckets).select("conn_id", *FEATURES), brute(rows, 2.0, 10))


def test_hosts_that_share_a_state_expire_apart(spark, tmp_path):
    t0 = 1704067200.0
    rows = [(t0 + t, i, "s", 1, h, 80, "http", "SF", 1.0) for i, (t, h) in enumerate(
        [(0, "old"), (1, "new"), (2, "late"), (50, "new"), (90, "new"), (95, "old"), (96, "new"), (97, "late")])]
    feed = Log(spark, rows, tmp_path)
    for ids in ("(0, 1, 2)", "(3)", "(4)", "(5, 6, 7)"):
        feed.add(f"conn_id IN {ids}")
    got = {r["conn_id"]: r["dst_host_count"] for r in feed.run(idle_seconds=45.0, late="1 second", buckets=1).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1, 6: 4, 7: 1}
