"""Late truth labels, changing reference tables, sessions and repeats, on streams and batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.verdicts import with_verdict
from tidewatch.streaming.joins import enriched_stream, evaluate_stream, publish_table, truth_stream, with_truth
from tidewatch.streaming.sessions import host_sessions, sent_once

START = datetime(2024, 1, 1)
DETECTION = "id long, ts timestamp, score double"
GIVEN = "id long, labelled_at timestamp, label string"
CONNECTION = T.StructType([T.StructField("dst_ip", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("bytes", T.DoubleType()), T.StructField("flag", T.StringType())])


def at(minutes):
    return START + timedelta(minutes=minutes)


def feed(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(path))


def test_truth_before_after_too_late_and_never(spark, tmp_path):
    """Each label ends as defined, also over a restart with the state of the run before."""
    first = [(1, at(0), 0.9), (2, at(1), 0.2), (3, at(2), 0.8), (4, at(3), 0.7), (None, at(3), 0.9)]
    labels = [(1, at(-5), "attack"), (2, at(30), "attack"), (None, at(3), "attack")]

    def run(detections, given):
        found = with_verdict(feed(spark, detections, DETECTION, tmp_path / "d"), "score", 0.5).withColumnRenamed("score", "anomaly_score")
        truth_stream(found, feed(spark, given, GIVEN, tmp_path / "l"), "id", str(tmp_path / "out"), str(tmp_path / "cp"),
                     early="10 minutes", within="1 hour", late="5 minutes").awaitTermination()
        return {(r["id"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run(first, labels) == {(1, "attack"), (2, "attack")}
    # 3 is labelled in time by the second run, 4 an hour and a minute after it.
    later = run([(5, at(70), 0.1)], [(3, at(50), "normal"), (4, at(64), "attack"), (9, at(70), "attack")])
    assert later == {(1, "attack"), (2, "attack"), (3, "normal"), (4, None), (None, None)}
    metrics = evaluate_stream(spark, str(tmp_path / "out"))
    assert (metrics["detections"], metrics["labelled"]) == (5, 3)
    assert metrics["confusion_matrix"] == [[0, 1], [1, 1]]


def test_truth_of_a_batch_and_of_many_labels(spark):
    found = spark.createDataFrame([(1, at(0), 0.9), (2, None, 0.1), (3, at(0), 0.4)], DETECTION)
    given = spark.createDataFrame([(1, at(1), "attack"), (1, at(2), "normal"), (2, at(0), "attack"), (3, at(61), "x")], GIVEN)
    got = {(r["id"], r["label"]) for r in with_truth(found, given, "id").collect()}
    assert got == {(1, "attack"), (1, "normal"), (2, None), (3, None)}


def test_a_changed_row_shows_in_the_next_micro_batch(spark, tmp_path):
    table = "host string, owner string"
    publish_table(spark.createDataFrame([("a", "red"), ("b", "blue")], table), str(tmp_path / "hosts"))

    def run(rows):
        stream = feed(spark, rows, "id long, host string", tmp_path / "in")
        enriched_stream(stream, str(tmp_path / "hosts"), ["host"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r["id"], r["owner"], r["table_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run([(1, "a"), (2, "z"), (3, None)]) == {(1, "red", 1), (2, None, 1), (3, None, 1)}
    assert publish_table(spark.createDataFrame([("a", "green"), ("z", "new")], table), str(tmp_path / "hosts")) == 2
    assert run([(4, "a"), (5, "z"), (6, "b")]) == {(1, "red", 1), (2, None, 1), (3, None, 1), (4, "green", 2), (5, "new", 2), (6, None, 2)}


def test_sessions(spark, tmp_path):
    rows = [("a", at(0), 1.0, "SF"), ("a", at(9), 2.0, "S0"), ("a", at(20), 4.0, "REJ"), ("a", at(30), None, "SF"),
            ("b", at(5), 1.0, "SF"), (None, at(5), 1.0, "SF"), (None, at(6), 1.0, None), ("a", None, 1.0, "SF")]
    want = {("a", at(0), at(9), 2, 3.0, 1, 0), ("a", at(20), at(30), 2, 4.0, 0, 1),
            ("b", at(5), at(5), 1, 1.0, 0, 0), (None, at(5), at(6), 2, 2.0, 0, 0)}
    assert {tuple(r) for r in host_sessions(spark.createDataFrame(rows, CONNECTION), "10 minutes").collect()} == want
    out = str(tmp_path / "out")
    for part in (rows[:2], rows[2:]):
        stream = host_sessions(feed(spark, part, CONNECTION, tmp_path / "in"), "10 minutes", watermark="20 minutes")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(
            availableNow=True).start().awaitTermination()
    # The watermark stands at ten minutes: no session has been over for ten minutes by then.
    assert spark.read.parquet(out).count() == 0


def test_repeats_go_over_a_restart(spark, tmp_path):
    schema = "id long, ts timestamp"
    out = str(tmp_path / "out")
    for rows in ([(1, at(0)), (2, at(1)), (2, at(1))], [(1, at(0)), (3, at(2))], [(3, at(2)), (2, at(3))]):
        sent_once(feed(spark, rows, schema, tmp_path / "in"), ["id"]).writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert sent_once(spark.createDataFrame([(1, at(0)), (1, at(9))], schema), ["id"]).count() == 1
