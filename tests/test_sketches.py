"""Quantile sketches: within their bound, mergeable, and usable where exact ones are."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.isolation_forest import IsolationForest
from tidewatch.operators.preprocess import FlowPreprocessor
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.sketches import (
    approximate_quantiles, merge_sketches, rank_error, sketch_columns, sketched_quantiles,
)

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40_000).select(
        "id", (F.col("id") % 7).alias("day"), F.exp(F.sin("id") * 6).alias("x"), (F.col("id") % 11).cast("double").alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("gaps"),
        F.lit(None).cast("double").alias("none")).repartition(6).cache()


def ranks(rows, column, value):
    r = rows.filter(f"NOT isnan({column})").agg(F.count(column), F.count_if(F.col(column) < value), F.count_if(F.col(column) <= value)).first()
    return r[1] / r[0], r[2] / r[0]


def test_ranks_are_within_the_bound(rows):
    columns = ["x", "few", "gaps"]
    found = approximate_quantiles(rows, columns, PROBS)
    for c in columns:
        for p, value in zip(PROBS, found[c], strict=True):
            below, upto = ranks(rows, c, value)
            assert below - rank_error(200) <= p <= upto + rank_error(200)
    exact = exact_quantiles(rows, columns, [0.0, 1.0])
    assert {c: [found[c][0], found[c][-1]] for c in columns} == exact


def test_days_are_put_together(spark, rows, tmp_path):
    sketch_columns(rows, ["x", "gaps"], ["day"]).write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    assert stored.count() == 7
    week = sketched_quantiles(merge_sketches(stored, ["x", "gaps"]), ["x", "gaps"], [0.5])
    for c in ("x", "gaps"):
        below, upto = ranks(rows, c, week[c][0])
        assert below - rank_error(200) <= 0.5 <= upto + rank_error(200)
    two = merge_sketches(stored.filter("day < 2"), ["x"], ["day"])
    assert two.count() == 2


def test_no_values(rows):
    assert math.isnan(approximate_quantiles(rows, ["none"], [0.5])["none"][0])
    assert all(map(math.isnan, approximate_quantiles(rows.limit(0), ["x"], [0.5, 1.0])["x"]))


def test_scaling_and_threshold_take_them(rows):
    few = rows.select("id", "x", "few")
    close = FlowPreprocessor([], "robust", exclude=["id"], quantiles=approximate_quantiles).fit(few).params["numeric"]
    exact = FlowPreprocessor([], "robust", exclude=["id"]).fit(few).params["numeric"]
    assert [c for c, _, _ in close] == [c for c, _, _ in exact] and all(math.isfinite(v) for _, *pair in close for v in pair)
    settings = {"features": ["x", "few"], "key": ["id"], "trees": 10, "psi": 64}
    one = IsolationForest(**settings).fit(few)
    two = IsolationForest(**settings, quantiles=approximate_quantiles).fit(few)
    flagged = two.transform(few).filter("prediction = 'anomaly'").count() / 40_000
    assert abs(flagged - 0.1) <= 0.05 and two.bounds == one.bounds
