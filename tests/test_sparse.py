"""Sparse features have the slots, nodes and scores of the dense ones."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.isolation_forest import IsolationForest
from tidewatch.operators.preprocess import FlowPreprocessor
from tidewatch.operators.sparse import SparseFlowPreprocessor, SparseIsolationForest, number_values

CATEGORICAL = ["city", "kind"]


@pytest.fixture(scope="module")
def rows(spark):
    number = spark.range(300).withColumn("a", F.col("id") % 17).withColumn("b", F.sin("id") * 5)
    return number.withColumns({"city": F.when(F.col("id") % 50 != 0, F.concat(F.lit("Ä"), (F.col("id") * 7 % 90).cast("string"))),
                               "kind": F.when(F.col("id") % 3 == 0, "x").otherwise("y")}).repartition(5).cache()


def dense(x, size):
    out = [0.0] * size
    for i, v in zip(x["indices"], x["values"], strict=True):
        out[i] = v
    return out


def test_slots_are_those_of_the_dense_encoder(spark, rows):
    train, test = rows.filter("id < 250"), rows
    want = {r["id"]: r["features"] for r in FlowPreprocessor(CATEGORICAL, exclude=["id"]).fit(train).transform(test).collect()}
    model = SparseFlowPreprocessor(CATEGORICAL, exclude=["id"]).fit(train)
    got = {r["id"]: r["features"] for r in model.transform(test).collect()}
    assert {i: dense(x, x["size"]) for i, x in got.items()} == {i: pytest.approx(v) for i, v in want.items()}
    label = {r["id"]: r["features"] for r in SparseFlowPreprocessor(CATEGORICAL, encoding="label", exclude=["id"]).fit(
        train).transform(test).collect()}
    plain = FlowPreprocessor(CATEGORICAL, encoding="label", exclude=["id"]).fit(train).transform(test).collect()
    assert label == {r["id"]: pytest.approx(r["features"]) for r in plain}


def test_forest_equals_the_dense_one(spark, rows, tmp_path):
    settings = {"key": ["id"], "trees": 12, "psi": 32}
    dense_rows = FlowPreprocessor(CATEGORICAL, exclude=["id"]).fit(rows).transform(rows)
    sparse_rows = SparseFlowPreprocessor(CATEGORICAL, exclude=["id"]).fit(rows).transform(rows)
    one = IsolationForest(**settings).fit(dense_rows)
    two = SparseIsolationForest(**settings).fit(sparse_rows)
    assert sorted(map(str, one.nodes.collect())) == sorted(map(str, two.nodes.collect()))
    want = {r["id"]: (r["anomaly_score"], r["prediction"]) for r in one.transform(dense_rows).collect()}
    assert {r["id"]: (r["anomaly_score"], r["prediction"]) for r in two.transform(sparse_rows).collect()} == want
    with pytest.raises(Exception, match="must not be NaN"):
        two.transform(sparse_rows.withColumn("features", F.col("features").withField(
            "values", F.array(F.lit(float("nan")), *[F.lit(0.0)] * 3)))).collect()


def test_numbers_follow_the_order(spark, tmp_path):
    values = spark.range(5000).select((F.col("id") % 3).cast("int").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    number_values(values, ["i", "v"], str(tmp_path / "places"))
    got = spark.read.parquet(str(tmp_path / "places")).collect()
    assert [(r["i"], r["v"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["i"], r["v"]) for r in values.collect())
    assert sorted(r["place"] for r in got) == list(range(5000))


def test_no_rows_and_unseen_values(spark, rows):
    model = SparseFlowPreprocessor(CATEGORICAL, exclude=["id"]).fit(rows.withColumn("city", F.lit(None).cast("string")))
    x = model.transform(rows).select("features.*").first()
    assert x["size"] == 4 and len(x["indices"]) == 3
