"""Scaling, encoding, quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.preprocess import (
    FlowPreprocessor, FlowPreprocessorModel, category_values, preprocess, scaling_parameters,
    split_features,
)
from tidewatch.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5), (9.0, 5)], "x double, k int")


def test_scaling_parameters(numbers):
    standard = scaling_parameters(numbers, ["x", "k"], "standard")
    assert standard["x"] == pytest.approx((4.0, 3.082207)) and standard["k"] == (5.0, 1.0)
    assert scaling_parameters(numbers, ["x", "k"], "minmax") == {"x": (1.0, 8.0), "k": (5.0, 1.0)}
    assert scaling_parameters(numbers, ["x", "k"], "robust") == {"x": (3.0, 3.5), "k": (5.0, 1.0)}


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_constant_column_on_new_data(spark, numbers, method):
    model = FlowPreprocessor(scaling=method).fit(numbers.select("k"))
    assert [r[1] for r in model.transform(numbers.select("k")).collect()] == [[0.0]] * 4
    assert model.transform(spark.createDataFrame([(7,)], "k int")).first()["features"] == [2.0]


def test_properties(numbers):
    rows = FlowPreprocessor().fit_transform(numbers.select("x"))
    x = np.array([r["features"][0] for r in rows.collect()])
    assert abs(x.mean()) < 1e-12 and x.std() == pytest.approx(1.0)
    rows = FlowPreprocessor(scaling="minmax").fit_transform(numbers.select("x"))
    assert {r["features"][0] for r in rows.collect()} <= {0.0, 0.125, 0.375, 1.0}


def test_encodings(spark):
    train = spark.createDataFrame([("tcp", 1), ("udp", 2), ("icmp", 3)], "p string, n int")
    new = spark.createDataFrame([("zzz", 1), (None, 1), ("tcp", 1)], "p string, n int")
    onehot = FlowPreprocessor(["p"], "minmax").fit(train)
    assert onehot.slots == ["n", "p_icmp", "p_tcp", "p_udp"]
    assert [r["features"] for r in onehot.transform(new).collect()] == [
        [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    label = FlowPreprocessor(["p"], "minmax", "label").fit(train)
    assert label.slots == ["n", "p"]
    assert [r["features"][1] for r in label.transform(new).collect()] == [-1.0, -1.0, 1.0]


def test_bad_settings(spark, numbers):
    with pytest.raises(ValueError):
        FlowPreprocessor(scaling="other")
    with pytest.raises(ValueError):
        FlowPreprocessor(encoding="other")
    with pytest.raises(ValueError):
        scaling_parameters(numbers.filter("false"), ["x"], "standard")
    with pytest.raises(ValueError):
        category_values(spark.range(50).select(F.col("id").cast("string")), ["id"], most=20)
    many = spark.range(20_000).select(F.col("id").cast("string"))
    assert len(category_values(many, ["id"])["id"]) == 20_000
    with pytest.raises(ValueError):
        FlowPreprocessor(["id"], max_categories=9).fit(many)
    for bad in (float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="infinite"):
            scaling_parameters(numbers.select(F.lit(bad).alias("x")).unionByName(numbers.select("x")), ["x"], "minmax")


def test_fit_on_train_only_save_load(spark, tmp_path, numbers):
    train = numbers.withColumn("label", F.lit("normal"))
    test = train.withColumn("x", F.col("x") * 10)
    a, b, model = preprocess(train, test, [], save_path=str(tmp_path / "m"))
    assert len(a.first()["features"]) == 2
    loaded = FlowPreprocessorModel.load(spark, str(tmp_path / "m"))
    assert loaded.params == model.params
    assert loaded.transform(test).collect() == b.collect()
    features, label = split_features(train)
    assert features.columns == ["x", "k"] and label.columns == ["label"]


def test_nulls(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    model = FlowPreprocessor().fit(df)
    assert model.params["numeric"] == [["x", 2.0, 1.0]]
    assert [r["features"] for r in model.transform(df).collect()] == [[-1.0], [1.0], [None]]
    assert model.transform(df, fill={"x": 2.0}).collect()[2]["features"] == [0.0]


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(3)
    skewed = np.exp(rng.normal(0, 12, 6000))
    tied = rng.choice([0.0, 0.0, 0.0, 1.0, 7.5], 6000)
    wide = rng.choice([-1e308, 1e308, 0.1], 6000)
    df = spark.createDataFrame(
        [(float(a), float(b), float(c), None) for a, b, c in zip(skewed, tied, wide)],
        "a double, b double, c double, d double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, list("abcd"), probs, bins=16)
    for name, data in (("a", skewed), ("b", tied), ("c", wide)):
        assert got[name] == pytest.approx(np.quantile(data, probs).tolist(), rel=1e-12), name
    assert all(math.isnan(v) for v in got["d"])
    small = exact_quantiles(df, list("abd"), probs)
    assert small["a"] == pytest.approx(got["a"]) and small["b"] == got["b"]
    assert all(math.isnan(v) for v in small["d"])


@pytest.mark.parametrize("n", [1_000, 250_000])
def test_quantiles_with_nan_and_infinities(spark, n):
    x = F.when(F.col("id") == 7, float("inf")).when(F.col("id") == 8, float("-inf")).when(
        F.col("id") == 9, float("nan")).otherwise(F.col("id") * 0.5)
    df = spark.range(n).select(x.alias("x"), F.lit(float("inf")).alias("all"), F.lit(float("nan")).alias("none"),
                               F.when(F.col("id") % 2 == 0, 0.0).otherwise(5e-324).alias("tiny"))
    got = exact_quantiles(df, ["x", "all", "none", "tiny"], [0.0, 0.25, 0.5, 1.0])
    data = np.array([i * 0.5 for i in range(n) if i not in (7, 8, 9)] + [np.inf, -np.inf])
    assert got["x"][1:3] == np.quantile(data, [0.25, 0.5]).tolist()
    assert got["x"][0] == -math.inf and got["x"][3] == math.inf
    assert got["all"] == [math.inf] * 4 and all(map(math.isnan, got["none"]))
    assert got["tiny"][0] == 0.0 and got["tiny"][3] == 5e-324


def test_one_nan_leaves_the_column(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double")
    assert scaling_parameters(df, ["x"], "standard") == {"x": (2.0, 1.0)}
    assert scaling_parameters(df, ["x"], "minmax") == {"x": (1.0, 2.0)}


def test_null_categories_count_as_unseen(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    for encoding, want in (("onehot", [[1, 0], [0, 1], [0, 0]]), ("label", [[0], [1], [-1]])):
        assert [r["features"] for r in FlowPreprocessor(["p"], encoding=encoding).fit_transform(df).collect()] == want


def test_no_python_in_the_plan(spark, numbers):
    model = FlowPreprocessor(["k"], exclude=[]).fit(numbers)
    plan = model.transform(numbers)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan
