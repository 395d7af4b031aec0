"""Isolation and random forest."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.isolation_forest import (
    IsolationForest, IsolationForestModel, average_path, grow_tree, normalise_score,
)
from tidewatch.operators.random_forest import RandomForestModel, fit_random_forest, top_features
from tidewatch.operators.summaries import describe_features
from tidewatch.plans.models import PublishedModel, load_model, publish_model


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3000, 3))
    x[:30] += 8
    return spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double"
    ).repartition(5).cache()


@pytest.fixture(scope="module")
def forest():
    return IsolationForest(["a", "b", "c"], key=["id"], trees=20, psi=64, contamination=0.05)


@pytest.fixture(scope="module")
def model(forest, cloud):
    return forest.fit(cloud)


def test_average_path():
    assert average_path(1) == 0.0 and average_path(2) == 1.0
    assert average_path(256) == pytest.approx(10.244770920119917, abs=1e-12)


def test_sample_is_the_lowest_hashes(forest, cloud):
    import hashlib

    sample, total = forest.sample(cloud)
    rows = sample.collect()
    assert total == 3000 and len(rows) == 20 * 64

    def rank(i, tree):
        digest = hashlib.md5(f"42|{i}".encode()).hexdigest()
        return (int(digest[:8], 16) + tree * int(digest[8:16], 16)) % 2**32

    for tree in (0, 19):
        want = sorted(range(3000), key=lambda i: (rank(i, tree), str(i)))[:64]
        assert {r["key"] for r in rows if r["tree"] == tree} == {str(i) for i in want}


def test_same_forest_on_any_partitioning(forest, cloud, model):
    again = forest.fit(cloud.repartition(2, "a"))
    order = ["tree", "node"]
    assert model.nodes.orderBy(order).collect() == again.nodes.orderBy(order).collect()
    assert again.threshold == model.threshold


def test_node_sizes_add_up(model):
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    for (tree, node), row in nodes.items():
        assert row["depth"] == int(math.log2(node)) <= 6
        if row["feature"] >= 0:
            left, right = nodes[tree, 2 * node], nodes[tree, 2 * node + 1]
            assert row["n"] == left["n"] + right["n"] and left["n"] and right["n"]
        else:
            assert (tree, 2 * node) not in nodes
            assert row["path"] == pytest.approx(row["depth"] + average_path(row["n"]))


def test_scores_follow_the_trees(model, cloud):
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}

    def path(x, tree):
        node = 1
        while nodes[tree, node]["feature"] >= 0:
            split = nodes[tree, node]
            node = 2 * node + (x[split["feature"]] > split["threshold"])
        return nodes[tree, node]["path"]

    for row in model.score(cloud).orderBy("id").limit(60).collect():
        mean = sum(path((row["a"], row["b"], row["c"]), t) for t in range(20)) / 20
        assert row["anomaly_score"] == pytest.approx(2 ** (-mean / average_path(64)), abs=1e-12)


def test_verdicts(model, cloud):
    rows = model.transform(cloud).collect()
    found = {r["id"] for r in rows if r["prediction"] == "anomaly"}
    assert len(found) == pytest.approx(150, abs=30) and set(range(30)) <= found
    assert all((r["anomaly_score"] > model.threshold) == (r["id"] in found) for r in rows)


def test_save_load_and_publish(spark, model, cloud, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert isinstance(loaded, IsolationForestModel) and loaded.threshold == model.threshold
    assert loaded.transform(cloud).orderBy("id").collect() == \
        model.transform(cloud).orderBy("id").collect()
    root = str(tmp_path / "published")
    published = PublishedModel(spark, root)
    with pytest.raises(FileNotFoundError):
        published.current()
    assert publish_model(spark, model, root) == 1
    assert published.current().threshold == model.threshold
    # A marker without a model: the model in force stays.
    spark.createDataFrame([(2,)], "version int").write.mode("append").json(f"{root}/published")
    assert published.current() is not None and published.version == 1


def test_guards(spark, forest, cloud, model):
    with pytest.raises(ValueError, match="no rows"):
        forest.fit(cloud.filter("false"))
    with pytest.raises(ValueError, match="nodes"):
        IsolationForest(trees=100_000, psi=256)
    with pytest.raises(ValueError):
        IsolationForest(psi=1)
    with pytest.raises(ValueError):
        IsolationForest(contamination=0.0)
    assert model.transform(cloud.filter("false")).collect() == []
    missing = cloud.withColumn("a", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="NULL"):
        model.score(missing).collect()
    with pytest.raises(Exception, match="NaN"):
        model.score(cloud.withColumn("a", F.lit(float("nan")))).collect()


def test_vectors_of_another_width_are_rejected(spark):
    rows = spark.range(300).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    model = IsolationForest("features", ["id"], trees=3, psi=8).fit(rows)
    for wrong in ([[1.0, 2.0, 3.0]] * 2, [[1.0] * 3, [1.0]], [[], [1.0, 2.0]]):
        df = spark.createDataFrame([(x,) for x in wrong], "features array<double>").coalesce(1)
        with pytest.raises(Exception, match="takes 2 features"):
            model.score(df).collect()
    model.release()
    assert model.transform(rows).count() == 300


def test_small_tables_and_any_partitioning(spark, cloud):
    few = cloud.limit(40).select("a", "b", "c").cache()
    model = IsolationForest(["a", "b", "c"], trees=4, psi=256).fit(few)
    assert model.nodes.agg(F.max("depth")).first()[0] <= 6
    sample, _ = IsolationForest(["a", "b", "c"], trees=4, psi=256).sample(few)
    assert sample.groupBy("tree").count().collect() == [(t, 40) for t in range(4)] or \
        {r["count"] for r in sample.groupBy("tree").count().collect()} == {40}
    wide = cloud.select("a", "b", "c")
    draws = [IsolationForest(["a", "b", "c"], trees=4, psi=32).sample(wide.repartition(p))[0]
             .select("tree", "rank", "key").orderBy("tree", "rank").collect() for p in (1, 5)]
    assert draws[0] == draws[1]


def test_rows_that_share_a_key(spark, cloud):
    shared = cloud.withColumn("k", F.col("id") % 9)
    model = IsolationForest(["a"], key=["k"], trees=4, psi=16).fit(shared)
    assert model.transform(shared).count() == cloud.count()


def test_without_key_copies_are_drawn_apart(spark):
    same = spark.range(4000).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    mixed = same.unionByName(spark.range(2000).select(
        F.rand(1).alias("a"), F.rand(2).alias("b")))
    model = IsolationForest(["a", "b"], trees=5, psi=16).fit(mixed)
    share = model.nodes.filter("node = 1").agg(F.sum("n")).first()[0]
    assert share == 5 * 16
    assert model.transform(mixed).count() == 6000


def test_constant_features(spark):
    df = spark.range(300).select("id", F.lit(3.0).alias("a"))
    model = IsolationForest(["a"], key=["id"], trees=3, psi=8).fit(df)
    rows = normalise_score(model.transform(df)).collect()
    assert {r["anomaly_score"] for r in rows} == {0.0}
    assert {r["prediction"] for r in rows} == {"normal"}


def test_tree_handles_equal_rows():
    rows = grow_tree(np.zeros((9, 2)), 0, 42, 3)
    assert [(r[1], r[3], r[5]) for r in rows] == [(1, -1, 9)]


def test_normalise(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 3.0), (3, 9.0)],
                               "request_id int, anomaly_score double")
    got = sorted(tuple(r) for r in normalise_score(df, by="request_id").collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0)]
    got = sorted(r["anomaly_score"] for r in normalise_score(df).collect())
    assert got == pytest.approx([0.0, 1 / 7, 1 / 7, 2 / 7, 1.0])
    got = [r["anomaly_score"] for r in normalise_score(df, scope="train", bounds=(3, 5)).collect()]
    assert got == [0.0, 0.5, 0.0, 0.0, 1.0]
    nulls = df.withColumn("request_id", F.when(F.col("request_id") > 1, F.col("request_id")))
    got = sorted(tuple(r) for r in normalise_score(nulls, by="request_id").filter("request_id IS NULL").collect())
    assert got == [(None, 0.0), (None, 1.0)]
    with pytest.raises(ValueError):
        normalise_score(df, scope="train")
    with pytest.raises(ValueError):
        normalise_score(df, scope="other")


def test_scoring_sends_only_features_to_python(spark, model, tmp_path):
    spark.range(9).selectExpr("id", "id + 0D a", "id + 1D b", "id * 2D c", "'x' payload") \
        .write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    plan = model.transform(wide)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [mean_path(array(a#" in plan and "Exchange" not in plan


def test_batch_scores_are_computed_once(model, cloud):
    plan = normalise_score(model.transform(cloud))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan                 # scored when written, read twice


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(5)
    label = rng.choice(["dos", "normal", "probe"], 600, p=[0.2, 0.7, 0.1])
    centre = {"dos": (4, 0), "normal": (0, 0), "probe": (0, 5)}
    pdf = pd.DataFrame([(i, y, [float(v) for v in rng.normal(centre[y], 1.0)] + [float(i % 3)])
                        for i, y in enumerate(label)], columns=["id", "label", "features"])
    return spark.createDataFrame(pdf, "id int, label string, features array<double>").cache()


def test_random_forest(spark, classes, tmp_path):
    model = fit_random_forest(classes, trees=15, max_depth=6, slots=["duration", "service_http",
                                                                    "count"])
    rows = model.transform(classes)
    hits = rows.filter("label = predicted").count()
    assert hits > 540 and rows.columns == classes.columns + ["predicted", "class_probability"]
    assert model.classes == ["dos", "normal", "probe"]
    first = rows.first()
    assert sum(first["class_probability"]) == pytest.approx(1.0)
    weights = [r["importance"] for r in model.importances().collect()]
    assert sum(weights) == pytest.approx(1.0)
    top = top_features(model, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]
    named = {r["feature"]: r["importance_level"]
             for r in describe_features(top_features(model, 3)).collect()}
    assert named == {"duration": "HIGH", "service_http": "MEDIUM", "count": "HIGH"}
    model.save(str(tmp_path / "rf"))
    loaded = load_model(spark, str(tmp_path / "rf"))
    assert isinstance(loaded, RandomForestModel)
    again = loaded.transform(classes).orderBy("id").select("predicted").collect()
    assert again == rows.orderBy("id").select("predicted").collect()
    assert loaded.importances().collect() == model.importances().collect()


def test_class_weights_need_no_join(spark, classes):
    seen = []
    from pyspark.ml.classification import RandomForestClassifier

    fit = RandomForestClassifier.fit
    RandomForestClassifier.fit = lambda self, df, *a: seen.append(df) or fit(self, df, *a)
    try:
        fit_random_forest(classes, trees=1, max_depth=1)
    finally:
        RandomForestClassifier.fit = fit
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    weight = {r["__label"]: r["weight"] for r in seen[0].select("__label", "weight").distinct().collect()}
    count = {r["label"]: r["count"] for r in classes.groupBy("label").count().collect()}
    assert weight == pytest.approx({c: 600 / (3 * n) for c, n in count.items()})
    with pytest.raises(ValueError):
        fit_random_forest(classes, max_classes=2)
    with pytest.raises(ValueError):
        fit_random_forest(classes.filter("false"))


def test_random_forest_default_names(classes):
    model = fit_random_forest(classes, trees=2, max_depth=2, balanced=False)
    assert model.params["slots"] == ["feature_0", "feature_1", "feature_2"]
    with pytest.raises(ValueError):
        fit_random_forest(classes, trees=1, max_depth=1, slots=["one"])


def _grown(rows, classes, **settings):
    from tidewatch.operators.grown_forest import grow_forest

    names = sorted({r["label"] for r in classes.select("label").distinct().collect()})
    y = (F.array_position(F.lit(names), F.col("label")) - 1).cast("int").alias("y")
    args = {"trees": 8, "max_depth": 30, "min_leaf": 1, "bins": 256, "seed": 42, "bootstrap": True, "subset": "auto",
            "slots": None} | settings
    return grow_forest(rows.select(y, "features"), names, [1.0] * len(names),
                       {"classes": names, "features": "features", "label": "label"}, **args)


def test_forest_to_purity_passes_over_the_rows_a_few_times(spark, classes, tmp_path, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("a pass per group of nodes"))
    # Labels that no feature tells: every row drawn has to be told apart.
    noisy = classes.withColumn("label", F.when(F.xxhash64("id") % 2 == 0, "a").otherwise("b"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    model = fit_random_forest(noisy, trees=12)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 25
    rows = model.transform(noisy)
    assert rows.columns == [*noisy.columns, "predicted", "class_probability"]
    assert rows.filter("label = predicted").count() > 570
    for r in rows.limit(50).collect():
        assert sum(r["class_probability"]) == pytest.approx(1.0)
        assert r["predicted"] == model.classes[int(np.argmax(r["class_probability"]))]
    assert sum(r["importance"] for r in model.importances().collect()) == pytest.approx(1.0)
    model.save(str(tmp_path / "rf"))
    loaded = load_model(spark, str(tmp_path / "rf"))
    assert loaded.transform(noisy).orderBy("id").collect() == rows.orderBy("id").collect()
    assert loaded.importances().collect() == model.importances().collect()
    for tree in model.trees:                # some rows share their bins, or what a node tries
        assert np.mean(np.diff(tree["start"])[tree["feature"] < 0] == 1) > 0.9


def test_grown_forest_is_the_same_with_and_without_histograms(classes):
    rows = classes.coalesce(1)
    # All features tried: the splits do not depend on where a node is grown.
    plain = _grown(rows, classes, subset="all")
    top = _grown(rows, classes, subset="all", task_rows=60, histogram_mb=1)
    order = [m.transform(rows).orderBy("id").select("predicted", "class_probability").collect() for m in (plain, top)]
    assert [r["predicted"] for r in order[0]] == [r["predicted"] for r in order[1]]
    for a, b in zip(*order, strict=True):
        assert a["class_probability"] == pytest.approx(b["class_probability"])
    for a, b in zip(plain.importances().collect(), top.importances().collect(), strict=True):
        assert a["importance"] == pytest.approx(b["importance"])


def test_grown_tree_splits_as_spark_ml_does(classes):
    stump = fit_random_forest(classes, trees=1, max_depth=1, bootstrap=False, feature_subset="all", balanced=False)
    for task_rows in (100_000, 10):
        mine = _grown(classes, classes, trees=1, max_depth=1, bootstrap=False, subset="all", task_rows=task_rows)
        want = stump.transform(classes).orderBy("id").select("predicted", "class_probability").collect()
        got = mine.transform(classes).orderBy("id").select("predicted", "class_probability").collect()
        same = sum(a["predicted"] == b["predicted"] for a, b in zip(want, got, strict=True))
        assert same > 590                   # Spark ML's thresholds are quantiles of its own
        assert mine.importances().orderBy(F.desc("importance")).first()["slot"] == int(np.argmax(
            stump.forest.featureImportances.toArray()))


def test_grown_forest_of_odd_rows(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0])] * 3, "label string, features array<double>")
    model = fit_random_forest(one, trees=3)
    assert {(r["predicted"], tuple(r["class_probability"])) for r in model.transform(one).collect()} == {("a", (1.0,))}
    tied = one.unionByName(one.withColumn("label", F.lit("b")).limit(1))
    rows = fit_random_forest(tied, trees=40, balanced=False).transform(tied).collect()
    assert {r["predicted"] for r in rows} == {"a"} and 0.5 < rows[0]["class_probability"][0] < 1
    assert _grown(tied, tied, task_rows=1).transform(tied).count() == 4
    with pytest.raises(ValueError):
        fit_random_forest(one, trees=1, slots=["one"])
    with pytest.raises(Exception, match="2 features"):
        model.transform(spark.createDataFrame([([1.0],)], "features array<double>")).collect()
