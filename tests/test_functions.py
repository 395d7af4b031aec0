"""Hand-checked labels, verdicts, hashes and sources."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.hashing import digest, digest_below, hash_unit
from tidewatch.functions.labels import attack_category, binary_label, clean_label
from tidewatch.functions.verdicts import land_flag, severity, truth_flag, with_verdict
from tidewatch.operators import summaries
from tidewatch.schema import (
    DICTIONARY, FEATURE_NAMES, FLOW_SCHEMA, TAXONOMY, features_by_importance,
)
from tidewatch.sources.flows import load_flows, read_flows, read_requests
from tidewatch.sources.sinks import (
    append_alerts, read_alerts, security_events, write_detections,
)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_fixed_tables():
    assert len(FLOW_SCHEMA) == 43 and len(FEATURE_NAMES) == 41 and len(TAXONOMY) == 39
    assert [n for n, *_ in DICTIONARY] == FEATURE_NAMES
    levels = [level for _, level, *_ in DICTIONARY]
    assert {x: levels.count(x) for x in set(levels)} == {
        "CRITICAL": 5, "HIGH": 16, "MEDIUM": 16, "LOW": 4}
    assert len(features_by_importance()) == 21


def test_labels(spark):
    df = spark.createDataFrame(
        [("normal.",), ("nor.mal",), ("Normal",), ("Neptune",), ("satan",), ("spy",), ("ps.",),
         ("xyz",), (None,)], "label string")
    got = values(df.select(clean_label(F.col("label")).alias("label")).select(
        "label", binary_label(F.col("label")), attack_category(F.col("label"))))
    assert got == [
        ("normal", "normal", "normal"), ("normal", "normal", "normal"),
        ("Normal", "attack", "normal"), ("Neptune", "attack", "dos"),
        ("satan", "attack", "probe"), ("spy", "attack", "r2l"), ("ps", "attack", "u2r"),
        ("xyz", "attack", "unknown"), (None, None, None)]


def test_severity_and_verdict(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.29, 0.3, 0.6, 0.79, 0.8, 1.0, None)],
                               "s double")
    got = [r[0] for r in df.select(severity(F.col("s"))).collect()]
    assert got == ["none", "none", "low", "medium", "medium", "high", "high", None]
    got = [r["prediction"] for r in with_verdict(df, "s", 0.6).collect()]
    assert got == ["normal"] * 4 + ["anomaly"] * 3 + [None]


def test_truth_flag_by_type(spark):
    text = spark.createDataFrame([("normal",), ("dos",), (None,)], "label string")
    assert [r[0] for r in text.select(truth_flag(text)).collect()] == [0, 1, None]
    number = spark.createDataFrame([(0,), (1,)], "label int")
    assert [r[0] for r in number.select(truth_flag(number)).collect()] == [0, 1]


def test_land(spark):
    df = spark.createDataFrame([("a", 1, "a", 1), ("a", 1, "a", 2), ("a", 1, "b", 1)],
                               "s string, p int, d string, q int")
    assert [r[0] for r in df.select(land_flag(*map(F.col, "spdq"))).collect()] == [1, 0, 0]


def test_hash(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    h = digest(7, "a", "b")
    rows = df.select(h.alias("h"), hash_unit(h).alias("u"), digest_below(h, 0.5).alias("low"),
                     digest_below(h, 1.0).alias("all")).collect()
    for row, text in zip(rows, ("7|1|x", "7|2|")):
        want = hashlib.md5(text.encode()).hexdigest()
        assert row["h"] == want and row["u"] == int(want[:8], 16) / 2**32
        assert row["low"] == (row["u"] < 0.5) and row["all"]


def line(label, difficulty=21):
    return ",".join(["1", "tcp", "http", "SF"] + ["0"] * 20 + ["0.5"] * 7 + ["1", "1"]
                    + ["0.25"] * 8 + [label, str(difficulty)])


def test_csv_scan(spark, tmp_path):
    for name, label in (("train", "neptune."), ("test", "normal")):
        (tmp_path / name).write_text(line(label) + "\n")
    train, test = load_flows(spark, str(tmp_path / "train"), str(tmp_path / "test"))
    assert train.columns == FEATURE_NAMES + ["label"]
    row = train.first()
    assert (row["label"], row["duration"], row["serror_rate"], row["dst_host_count"]) == (
        "dos", 1, 0.5, 1)
    assert test.first()["label"] == "normal"
    binary, _ = load_flows(spark, str(tmp_path / "train"), str(tmp_path / "test"), binary=True)
    assert binary.first()["label"] == "attack"
    assert read_flows(spark, str(tmp_path / "train"), with_label=False).columns == FEATURE_NAMES


def test_short_csv_rows_give_nulls(spark, tmp_path):
    (tmp_path / "f").write_text("1,tcp\n" + line("normal") + "\n")
    rows = read_flows(spark, str(tmp_path / "f")).orderBy(F.col("service").isNull()).collect()
    assert rows[0]["service"] == "http" and rows[1]["service"] is None
    assert rows[1]["protocol_type"] == "tcp"


def test_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"request_id": 1, "ts": "2024-01-01T00:00:00Z", "pos": 0, "features": [1.0, 2.5]}\n')
    row = read_requests(spark, str(tmp_path)).first()
    assert row["features"] == [1.0, 2.5] and row["request_id"] == 1


def test_sinks(spark, tmp_path):
    det = spark.createDataFrame([(1, "anomaly", 0.9), (2, "normal", 0.1)],
                                "src int, prediction string, anomaly_score double")
    write_detections(det, str(tmp_path / "d"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "d"))
    assert back.columns == det.columns and back.count() == 2
    events = security_events(det, severity(F.col("anomaly_score")), F.col("src"),
                             details={"score": F.col("anomaly_score")})
    assert values(events) == [("anomaly", "high", "1", None, {"score": "0.9"})]
    assert values(security_events(det, F.lit("low"), F.col("src")))[0][-1] == {}
    alerts = spark.sql("select 'alert_1' id, timestamp'2024-01-02 03:00:00' timestamp, "
                       "2L anomalies_found, 5L total_samples")
    append_alerts(alerts, str(tmp_path / "a"))
    append_alerts(alerts.withColumn("id", F.lit("alert_2")), str(tmp_path / "a"))
    assert sorted(r["id"] for r in read_alerts(spark, str(tmp_path / "a")).collect()) == [
        "alert_1", "alert_2"]


def test_summaries(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "label string")
    assert values(summaries.label_distribution(df)) == [("b", 2), ("a", 1), ("c", 1)]
    weights = {r["label"]: r["weight"] for r in summaries.class_weights(df).collect()}
    assert weights == pytest.approx({"a": 4 / 3, "b": 4 / 6, "c": 4 / 3})
    det = spark.createDataFrame([(1, "anomaly"), (1, "normal"), (2, "normal")],
                                "request_id int, prediction string")
    assert values(summaries.anomaly_summary(det))[0][:2] == (3, 1)
    assert sorted(values(summaries.request_summary(det))) == [(1, 2, 1), (2, 1, 0)]
    empty = det.filter("false")
    assert values(summaries.anomaly_summary(empty)) == [(0, 0, None)]
    assert values(summaries.system_stats(empty)) == [(0, 0, 0.0)]


def test_recent_alerts(spark):
    alerts = spark.range(5).select(
        F.concat(F.lit("alert_"), F.col("id").cast("string")).alias("id"),
        F.timestamp_seconds("id").alias("timestamp"))
    got = summaries.recent_alerts(alerts, 2).collect()
    assert [r["id"] for r in got] == ["alert_3", "alert_4"] and got[0]["total_alerts"] == 5
    assert summaries.recent_alerts(alerts, 0).collect() == []
    assert len(summaries.recent_alerts(alerts, 50).collect()) == 5
    with pytest.raises(ValueError):
        summaries.recent_alerts(alerts, -1)


def test_hash_split_is_stable(spark):
    df = spark.range(2000)
    train, test = summaries.hash_split(df, ["id"])
    again = summaries.hash_split(df.repartition(7), ["id"])[1]
    assert train.count() + test.count() == 2000 and 300 < test.count() < 500
    assert set(test.collect()) == set(again.collect())


def test_malformed_fields(spark, tmp_path):
    from tidewatch.sources.flows import read_flows

    good = ",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal.", "5"])
    (tmp_path / "flows.csv").write_text(f"{good}\n{good.replace('0,tcp', 'long,tcp')}\n")
    assert [r["duration"] for r in read_flows(spark, str(tmp_path)).select("duration").collect()] == [0, None]
    assert read_flows(spark, str(tmp_path), malformed="drop").select("duration").collect() == [(0,)]
    with pytest.raises(Exception):
        read_flows(spark, str(tmp_path), malformed="fail").select("duration").collect()
    with pytest.raises(ValueError):
        read_flows(spark, str(tmp_path), malformed="other")


def test_fast_rounding_equals_decimal_rounding(spark):
    from tidewatch.plans.catalog import rounded
    odd = [0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, 1234.5678905, -0.0, 1e300, 123456.7890125, 999999.9999995,
           float("nan"), float("inf"), -float("inf"), None, 1e-320, 2.0000005]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").unionByName(
        spark.range(2000).selectExpr("(id * 2 + 1) / 2e6 + id % 7 AS x"))
    found = rounded("x", "r")
    both = rows.select(found, (F.round("x", 6) + F.lit(0.0)).alias("q")).collect()
    assert all(str(r["r"]) == str(r["q"]) for r in both)
    # Not every value goes by way of a decimal.
    assert "rint" in str(found).lower()
