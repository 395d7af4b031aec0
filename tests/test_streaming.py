"""Streams give what the batch operators give, also over a restart."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.isolation_forest import IsolationForest, normalise_score
from tidewatch.operators.summaries import recent_alerts, request_alerts, system_stats
from tidewatch.plans.models import publish_model
from tidewatch.plans.standins import request_vectors
from tidewatch.functions.verdicts import with_verdict
from tidewatch.sources.sinks import append_alerts, read_alerts
from tidewatch.streaming import scoring


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return request_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).cache()


@pytest.fixture(scope="module")
def model(vectors):
    return IsolationForest("features", ["vec_id"], trees=15, psi=64).fit(vectors)


class Feed:
    """Requests that arrive in files, read one file per micro-batch."""

    def __init__(self, spark, vectors, path):
        self.spark, self.vectors, self.path = spark, vectors, str(path)
        self.checkpoint = str(path) + "-checkpoint"

    def add(self, low, high, which="true"):
        self.vectors.filter(F.col("request_id").between(low, high)).filter(which).coalesce(1) \
            .write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.vectors.schema) \
            .option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def feed(spark, vectors, tmp_path):
    feed = Feed(spark, vectors, tmp_path / "feed")
    feed.add(0, 3)
    feed.add(4, 5)
    return feed


def rows(df):
    return sorted(map(str, df.collect()))


def run_twice(feed, start):
    start(feed.stream()).awaitTermination()
    feed.add(6, 9)
    start(feed.stream()).awaitTermination()


def test_scores(spark, feed, vectors, model, tmp_path):
    out = str(tmp_path / "out")
    run_twice(feed, lambda s: scoring.score_stream(s, model, out, feed.checkpoint))
    batch = model.transform(vectors)
    assert rows(spark.read.parquet(out).select(batch.columns)) == rows(batch)


def test_request_scores_and_model_swap(spark, feed, vectors, model, tmp_path):
    out, root = str(tmp_path / "out"), str(tmp_path / "models")
    publish_model(spark, model, root)
    scoring.score_requests_stream(feed.stream(), root, out, feed.checkpoint).awaitTermination()
    other = IsolationForest("features", ["vec_id"], trees=5, psi=32, seed=7).fit(vectors)
    publish_model(spark, other, root)
    feed.add(6, 9)
    scoring.score_requests_stream(feed.stream(), root, out, feed.checkpoint).awaitTermination()
    got = scoring.read_request_scores(spark, out)
    for version, used, which in ((1, model, "request_id < 6"), (2, other, "request_id >= 6")):
        want = normalise_score(used.transform(vectors.filter(which)), by="request_id")
        part = got.filter(F.col("model_version") == version).select(want.columns)
        assert rows(part) == rows(want)


def test_no_model_fails_the_stream(feed, tmp_path):
    query = scoring.score_requests_stream(feed.stream(), str(tmp_path / "none"),
                                          str(tmp_path / "out"), feed.checkpoint)
    with pytest.raises(Exception, match="no published model"):
        query.awaitTermination()


def test_alerts(spark, feed, vectors, model, tmp_path):
    out = str(tmp_path / "alerts")
    run_twice(feed, lambda s: scoring.alert_stream(s, model, out, feed.checkpoint))
    want = request_alerts(model.transform(vectors))
    assert rows(read_alerts(spark, out).select(want.columns)) == rows(want)


def test_requests_over_several_micro_batches(spark, feed, vectors, model, tmp_path):
    """A request cut in three: one alert, and scores as if it came whole."""
    feed.add(6, 9, "pos < 10")
    out, scores, root = (str(tmp_path / n) for n in ("alerts", "scores", "models"))
    publish_model(spark, model, root)
    scoring.alert_stream(feed.stream(), model, out, feed.checkpoint).awaitTermination()
    feed.add(6, 9, "pos BETWEEN 10 AND 30")
    feed.add(6, 9, "pos > 30")
    scoring.alert_stream(feed.stream(), model, out, feed.checkpoint).awaitTermination()
    want = request_alerts(model.transform(vectors))
    assert rows(read_alerts(spark, out).select(want.columns)) == rows(want)
    append_alerts(want.limit(0), out)                    # the batch job shares the table
    assert rows(recent_alerts(read_alerts(spark, out), 3)) == rows(recent_alerts(want, 3))
    scoring.score_requests_stream(feed.stream(), root, scores, feed.checkpoint + "-2").awaitTermination()
    whole = normalise_score(model.transform(vectors), by="request_id")
    assert rows(scoring.read_request_scores(spark, scores).select(whole.columns)) == rows(whole)


def test_stats(spark, feed, vectors, model, tmp_path):
    out = str(tmp_path / "stats")
    run_twice(feed, lambda s: scoring.stats_stream(s, model, out, feed.checkpoint))
    assert rows(scoring.latest_stats(spark, out)) == rows(system_stats(model.transform(vectors)))
    assert spark.read.parquet(out).count() == 3


def test_closed_windows(spark, feed, vectors, tmp_path):
    out = str(tmp_path / "windows")
    judged = with_verdict(feed.stream().withColumn("x", F.col("features")[0]), "x", 0.0)
    feed.add(6, 9)
    scoring.anomaly_windows(judged, "1 minute", "30 seconds").writeStream.format("parquet") \
        .outputMode("append").option("path", out).option("checkpointLocation", feed.checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()
    batch = scoring.anomaly_windows(
        with_verdict(vectors.withColumn("x", F.col("features")[0]), "x", 0.0), "1 minute")
    end = vectors.agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(end) - F.expr("interval 30 seconds"))
    assert rows(spark.read.parquet(out)) == rows(closed)
