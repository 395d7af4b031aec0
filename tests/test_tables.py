"""Stored security events, alert tables with closed days, nested requests."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators.summaries import recent_alerts
from tidewatch.sources.flows import answer, read_requests
from tidewatch.sources.sinks import (
    append_alerts, append_events, close_days, closed_until, latest_alerts, read_alerts, read_events, security_events,
)

ALERT = "id string, timestamp timestamp, anomalies_found long, total_samples long"


def alerts(spark, rows):
    return spark.createDataFrame([(f"alert_{i}", datetime(2024, 1, d, 12), a, 10) for i, d, a in rows], ALERT)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_latest_alerts_equal_those_of_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = [(i, 1 + i // 4, i % 3) for i in range(24)]
    append_alerts(alerts(spark, rows[:13]), path)
    append_alerts(alerts(spark, [*rows[13:], (20, 5, 2)]), path)        # alert_20 has rows of two days
    whole = [plain(recent_alerts(read_alerts(spark, path), n)) for n in range(20)]
    assert [plain(latest_alerts(spark, path, n)) for n in range(20)] == whole
    for until in ("2024-01-03", "2024-01-03", "2024-01-05"):            # a closing may be repeated
        close_days(spark, path, until)
        assert [plain(latest_alerts(spark, path, n)) for n in range(20)] == whole
    assert str(closed_until(spark, path)) == "2024-01-05"


def test_latest_alerts_read_the_days_they_need(spark, tmp_path):
    path = str(tmp_path / "alerts")
    append_alerts(alerts(spark, [(i, 1 + i // 4, 1) for i in range(80)]), path)
    close_days(spark, path, "2024-01-19")
    want = plain(latest_alerts(spark, path, 10))
    for old in (tmp_path / "alerts-closed" / "alerts" / "until=2024-01-19").glob("day=2024-01-0*/*.parquet"):
        old.write_bytes(b"not read")
    assert plain(latest_alerts(spark, path, 10)) == want and want[-1][-1] == 80


def test_events_are_stored_and_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([(1, "anomaly", 0.9, datetime(2024, 1, 1, 5)), (2, "normal", 0.1, datetime(2024, 1, 1)),
                                  (3, "anomaly", 0.4, datetime(2024, 1, 2, 7))],
                                 "id long, prediction string, score double, at timestamp")
    events = security_events(rows, F.lit("high"), F.lit("10.0.0.1"), details={"id": F.col("id"), "at": F.col("at")})
    for batch in ("a", "a", "b"):                                       # a repeated writing replaces itself
        append_events(events, path, F.to_timestamp(F.col("details")["at"]), batch)
    stored = read_events(spark, path)
    assert stored.count() == 4 and stored.filter("destination_ip IS NOT NULL").count() == 0
    late = read_events(spark, path, F.col("day") == F.lit("2024-01-02").cast("date"))
    assert [r["details"]["id"] for r in late.collect()] == ["3", "3"]
    append_events(events.limit(0), path)
    assert read_events(spark, path).count() == 4


def test_nested_requests(spark, tmp_path):
    path = tmp_path / "requests.json"
    path.write_text('{"request_id": 1, "ts": "2024-01-01T00:00:00Z", "features": [[1, 2], [3, 4]], "return_scores": true}\n'
                    '{"request_id": 2, "features": [[5.5, 6]]}\n{"request_id": 3, "features": []}\n{"request_id": 4, "features": [null]}\n')
    rows = read_requests(spark, str(path), nested=True)
    got = sorted((r["request_id"], r["pos"], r["features"], r["return_scores"]) for r in rows.collect())
    assert got == [(1, 0, [1.0, 2.0], True), (1, 1, [3.0, 4.0], True), (2, 0, [5.5, 6.0], False), (4, 0, None, False)]
    told = answer(rows.withColumn("anomaly_score", F.lit(0.5))).filter("anomaly_score IS NOT NULL")
    assert [r["request_id"] for r in told.collect()] == [1, 1]
