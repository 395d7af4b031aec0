"""Train and detect end to end on flow files."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.preprocess import FlowPreprocessorModel
from tidewatch.operators.summaries import hash_split
from tidewatch.plans.models import load_model
from tidewatch.plans.pipelines import detect, train
from tidewatch.plans.standins import ROW_KEY, flow_records
from tidewatch.schema import FEATURE_NAMES
from tidewatch.sources.flows import process_labels, read_flows
from tidewatch.sources.sinks import write_detections


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    return flow_records(spark, sf_dir, ROW_KEY).drop("difficulty").cache()


@pytest.fixture(scope="module")
def split(flows):
    return hash_split(flows, ROW_KEY)


def test_detector(spark, split, tmp_path_factory, sf_dir):
    root = str(tmp_path_factory.mktemp("detector"))
    parts = [process_labels(p, binary=True) for p in split]
    metrics = train(*parts, root, key=ROW_KEY, trees=20, psi=64)
    assert set(metrics) == {"accuracy", "precision", "recall", "f1_score", "confusion_matrix",
                            "roc_auc"}
    assert sum(map(sum, metrics["confusion_matrix"])) == parts[1].count()
    # Labels are arbitrary here, so ranking cannot be much better than chance.
    assert 0.3 < metrics["roc_auc"] < 0.7

    model = load_model(spark, f"{root}/isolation_forest")
    prep = FlowPreprocessorModel.load(spark, f"{root}/preprocessor")
    flow_records(spark, sf_dir).write.csv(f"{root}/flows")
    rows = read_flows(spark, f"{root}/flows", with_label=False)
    write_detections(detect(rows, prep, model), f"{root}/detections")
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(
        f"{root}/detections")
    assert back.columns == FEATURE_NAMES + ["prediction", "anomaly_score"]
    low, high = back.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert (low, high) == (0.0, 1.0) and back.count() == rows.count()
    plain = detect(rows, prep, model, scope="train", with_score=False)
    assert plain.columns == FEATURE_NAMES + ["prediction"]
    assert back.groupBy("prediction").count().orderBy("prediction").collect() == \
        plain.groupBy("prediction").count().orderBy("prediction").collect()


def test_classifier(spark, split, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("classifier"))
    # A learnable category: by protocol and flag.
    parts = [p.withColumn("label", F.when(F.col("protocol_type") == "tcp", "normal").when(
        F.col("flag") == "SF", "dos").otherwise("probe")) for p in split]
    metrics = train(*parts, root, model="random_forest", key=ROW_KEY, trees=10, max_depth=8)
    assert metrics["accuracy"] > 0.9 and set(metrics) == {
        "accuracy", "precision", "recall", "f1_score", "class_report"}
    assert {r["class"] for r in metrics["class_report"] if r["kind"] == "class"} == {"normal", "dos", "probe"}
    model = load_model(spark, f"{root}/random_forest")
    prep = FlowPreprocessorModel.load(spark, f"{root}/preprocessor")
    rows = parts[1].select(*FEATURE_NAMES, "label")
    out = detect(rows, prep, model)
    wrong = out.filter((F.col("label") == "normal") != (F.col("prediction") == "normal")).count()
    assert wrong < 0.1 * rows.count()
    assert out.filter("anomaly_score < 0 or anomaly_score > 1").count() == 0
    top = {r["feature"] for r in model.importances().orderBy(F.desc("importance")).limit(4)
           .collect()}
    assert "protocol_type_tcp" in top


def test_unknown_model(split, tmp_path):
    with pytest.raises(ValueError):
        train(*split, str(tmp_path), model="other")


def test_scratch_copies_go_with_their_detections(spark, tmp_path):
    """A score relative to the batch is read from a copy without features, which can be dropped."""
    import glob

    from tidewatch.plans.pipelines import detect
    from tidewatch.operators.isolation_forest import IsolationForest
    from tidewatch.session import drop_scratch, shared_dir

    rows = spark.range(60).select("id", F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    model = IsolationForest("features", ["id"], trees=5, psi=16).fit(rows)
    found = detect(rows, None, model)
    paths = {p.rsplit("/", 1)[0] for p in found.inputFiles()}
    assert len(paths) == 1 and "scored-" in next(iter(paths)) and found.count() == 60
    drop_scratch(found, "scored")
    assert not glob.glob(next(iter(paths)).replace("file:", "").replace("///", "/") + "/*")
    assert shared_dir(spark)
    verdicts = detect(rows, None, model, with_score=False)
    assert not verdicts.inputFiles() and verdicts.columns == ["id", "features", "prediction"]
