"""Registered queries: each runs an operator over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import attack_category, binary_label, clean_label
from tidewatch.functions.verdicts import (
    anomaly_flag, land_flag, severity, truth_flag, with_verdict,
)
from tidewatch.operators import metrics, summaries
from tidewatch.operators.isolation_forest import (
    IsolationForest, IsolationForestModel, normalise_score,
)
from tidewatch.operators.preprocess import (
    FlowPreprocessor, FlowPreprocessorModel, numeric_columns, scaling_parameters, split_features,
)
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.random_forest import RandomForestModel, fit_random_forest, top_features
from tidewatch.operators.sketches import merge_sketches, rank_error, sketch_columns, sketched_quantiles
from tidewatch.operators.sparse import SparseFlowPreprocessor, SparseIsolationForest
from tidewatch.operators.traffic import HOST_FEATURES, TIME_FEATURES, flow_features
from tidewatch.plans.models import load_model, publish_model
from tidewatch.plans.pipelines import detect, detect_job, evaluate_classifier, train
from tidewatch.plans.standins import (
    CATEGORY, NUMERIC, ROW_KEY, connections, flow_records, labelled_events, lineitem,
    request_vectors,
)
from tidewatch.schema import CATEGORICAL, FEATURE_NAMES
from tidewatch.session import scratch_path, spread, uneven
from tidewatch.sources.flows import load_flows, process_labels, read_flows, read_requests
from tidewatch.sources.sinks import (
    append_alerts, append_events, close_days, latest_alerts, read_alerts, read_events,
    security_events, write_detections,
)
from tidewatch.streaming import scoring
from tidewatch.streaming.flow_state import flow_state_stream
from tidewatch.streaming.joins import enriched_stream, publish_table, truth_stream
from tidewatch.streaming.progress import ProgressLog, read_progress
from tidewatch.streaming.sessions import host_sessions, sent_once
from tidewatch.streaming.traffic import flow_features_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
RATES = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(column: str | Column, alias: str | None = None) -> Column:
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    # F.round goes by way of a decimal's text. Away from halves, in doubles, the nearest whole number
    # of units is the same one and its quotient the same double.
    units = col * F.lit(10.0 ** DIGITS)
    whole = F.rint(units)
    plain = (F.abs(units) < 1e12) & (F.abs(units - whole) < 0.499)
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return (F.when(plain, whole / F.lit(10.0 ** DIGITS)).otherwise(F.round(col, DIGITS)) + F.lit(0.0)).alias(alias or column)


def naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- sources, labels, projections -------------------------------------------------------------

@query
def scan_flows(spark, sf_dir):
    path = scratch_path(spark, "flows")
    flow_records(spark, sf_dir).write.csv(path)
    return process_labels(read_flows(spark, path))


@query
def scan_flows_binary(spark, sf_dir):
    path = scratch_path(spark, "flows")
    flow_records(spark, sf_dir).write.parquet(path)
    flows = process_labels(read_flows(spark, path, "parquet"), binary=True)
    return summaries.label_distribution(flows)


@query
def scan_unlabelled(spark, sf_dir):
    path = scratch_path(spark, "flows")
    flow_records(spark, sf_dir).write.csv(path)
    return read_flows(spark, path, with_label=False)


@query
def scan_requests(spark, sf_dir):
    path = scratch_path(spark, "requests")
    request_vectors(read(spark, sf_dir, "embeddings")).drop("vec_id", "label").write.json(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return read_requests(spark, path).select(
        "request_id", naive("ts"), "pos", F.size("features").alias("n_features"),
        rounded(total, "feature_sum"))


@query
def scan_nested_requests(spark, sf_dir):
    """Requests of 50 vectors as one record each; every other one wants scores."""
    path = scratch_path(spark, "requests")
    rows = request_vectors(read(spark, sf_dir, "embeddings"))
    vectors = F.transform(F.sort_array(F.collect_list(F.struct("pos", "features"))), lambda x: x["features"])
    rows.groupBy("request_id").agg(F.min("ts").alias("ts"), vectors.alias("features")).withColumn(
        "return_scores", F.when(F.col("request_id") % 2 == 0, True)).write.json(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return read_requests(spark, path, nested=True).select(
        "request_id", naive("ts"), "pos", F.size("features").alias("n_features"),
        rounded(total, "feature_sum"), "return_scores")


@query
def label_clean(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    return rows.select("event_id", clean_label(F.col("label")).alias("label"))


@query
def label_binary(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    return rows.select("event_id", binary_label(clean_label(F.col("label"))).alias("label"))


@query
def label_category(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    return rows.select("event_id", attack_category(clean_label(F.col("label"))).alias("category"))


@query
def split_columns(spark, sf_dir):
    features, _ = split_features(flow_records(spark, sf_dir).drop("difficulty"))
    numeric = numeric_columns(features, CATEGORICAL)
    return features.agg(*[rounded(F.sum(F.col(f"`{c}`").cast("double")), c) for c in numeric])


@query
def high_importance(spark, sf_dir):
    return summaries.select_by_importance(flow_records(spark, sf_dir, ROW_KEY), keep=ROW_KEY)


@query
def feature_dictionary(spark, sf_dir):
    flows = flow_records(spark, sf_dir).select(*FEATURE_NAMES)
    numeric = numeric_columns(flows, CATEGORICAL)
    # Looked up for the fitted scale of each feature; a mean of two-digit rates would often lie
    # exactly between two roundings.
    fitted = scaling_parameters(flows, numeric, "standard")
    scales = spark.createDataFrame([(c, s) for c, (_, s) in fitted.items()],
                                   "feature string, scale double")
    return summaries.describe_features(scales).select(
        "ordinal", "feature", "description", "importance_level",
        rounded("scale"))


@query
def land(spark, sf_dir):
    conns = connections(read(spark, sf_dir, "events"))
    return conns.select("conn_id", land_flag(
        F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")).alias("land"))


@query
def severity_grades(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "value")
    scored = normalise_score(events, "value")
    return scored.select("event_id", rounded("value", "score"),
                         severity(F.col("value")).alias("severity"))


# --- data-set summaries -----------------------------------------------------------------------

@query
def dataset_summary(spark, sf_dir):
    return summaries.dataset_summary(flow_records(spark, sf_dir).drop("difficulty"))


@query
def label_distribution(spark, sf_dir):
    return summaries.label_distribution(process_labels(flow_records(spark, sf_dir)))


@query
def class_weights(spark, sf_dir):
    weights = summaries.class_weights(process_labels(flow_records(spark, sf_dir)))
    return weights.select("label", "n", rounded("weight"))


@query
def hash_split(spark, sf_dir):
    train, test = summaries.hash_split(lineitem(spark, sf_dir), ROW_KEY)
    tag = [train.select(*ROW_KEY, F.lit("train").alias("part")),
           test.select(*ROW_KEY, F.lit("test").alias("part"))]
    return tag[0].unionByName(tag[1])


# --- scaling and encoding ---------------------------------------------------------------------

def _scaled(spark, sf_dir, method):
    rows = spread(lineitem(spark, sf_dir).select(*ROW_KEY, *NUMERIC))
    x = F.col("features")
    return FlowPreprocessor(scaling=method, exclude=ROW_KEY).fit_transform(rows).select(
        *ROW_KEY, *[rounded(x[i], f"{c}_scaled") for i, c in enumerate(NUMERIC)])


@query
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query
def robust_parameters(spark, sf_dir):
    rows = spread(lineitem(spark, sf_dir).select(*NUMERIC))
    found = exact_quantiles(rows, NUMERIC, [0.25, 0.5, 0.75])
    return spark.createDataFrame(
        [(c, *map(float, q)) for c, q in found.items()],
        "feature string, q1 double, median double, q3 double",
    ).select("feature", rounded("q1"), rounded("median"), rounded("q3"))


def _encoded(spark, sf_dir, encoding, names):
    rows = lineitem(spark, sf_dir).select(*ROW_KEY, *CATEGORY)
    # Fitted without flag N, so N is an unseen category.
    model = FlowPreprocessor(CATEGORY, encoding=encoding, exclude=ROW_KEY).fit(
        rows.filter(F.col("l_returnflag") != "N"))
    x = F.col("features")
    return model.transform(rows).select(
        *ROW_KEY, *[x[i].cast("int").alias(n) for i, n in enumerate(names)])


@query
def encode_onehot(spark, sf_dir):
    return _encoded(spark, sf_dir, "onehot", ["flag_a", "flag_r", "status_f", "status_o"])


@query
def encode_label(spark, sf_dir):
    return _encoded(spark, sf_dir, "label", ["flag_code", "status_code"])


@query
def sketched_quartiles(spark, sf_dir):
    """Quartiles by sketches of each flag, put together: whether their ranks are within the bound."""
    rows = lineitem(spark, sf_dir).select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    path, k = scratch_path(spark, "sketches"), 400
    sketch_columns(rows, NUMERIC, ["l_returnflag"], k).write.parquet(path)
    found = sketched_quantiles(merge_sketches(spark.read.parquet(path), NUMERIC, k=k), NUMERIC, [0.25, 0.5, 0.75])
    asked = spark.createDataFrame([(c, p, v) for c in NUMERIC for p, v in zip([0.25, 0.5, 0.75], found[c], strict=True)],
                                  "column string, prob double, value double")
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in NUMERIC])))
    # Twelve rows are broadcast to the cells.
    counts = cells.join(F.broadcast(asked), "column").groupBy("column", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"),
        F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    error = rank_error(k)
    return counts.select("column", "prob", "n", (
        (F.col("below") / F.col("n") <= F.col("prob") + error) & (F.col("upto") / F.col("n") >= F.col("prob") - error)).alias("within"))


@query
def encode_wide(spark, sf_dir):
    """One-hot of a column with a value per order: sparse, by a lookup table."""
    rows = spread(lineitem(spark, sf_dir)).select(*ROW_KEY, *NUMERIC, "l_returnflag", F.col("l_orderkey").alias("order"))
    prep = SparseFlowPreprocessor(["order", "l_returnflag"], exclude=ROW_KEY).fit(rows)
    x = F.col("features")
    return prep.transform(rows).select(
        *ROW_KEY, x["size"].alias("size"), F.size(x["indices"]).alias("filled"), x["indices"][4].alias("order_slot"),
        x["indices"][5].alias("flag_slot"), rounded(x["values"][0], "s0"), rounded(x["values"][5], "s5"))


@query
def detect_flows_sparse(spark, sf_dir):
    """``detect_flows`` on sparse features: the same forest and scores."""
    flows = flow_records(spark, sf_dir, ROW_KEY).drop("label", "difficulty")
    rows = SparseFlowPreprocessor(CATEGORICAL, "minmax", exclude=ROW_KEY).fit(flows).transform(flows)
    model = SparseIsolationForest("features", key=ROW_KEY).fit(rows)
    return detect(rows, None, model).select(*ROW_KEY, "prediction", rounded("anomaly_score"))


@query
def assemble_features(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(*ROW_KEY, *CATEGORY, *NUMERIC)
    x = F.col("features")
    return FlowPreprocessor(CATEGORY, exclude=ROW_KEY).fit_transform(rows).select(
        *ROW_KEY, *[rounded(x[i], f"s{i}") for i in range(9)])


@query
def flow_preprocess(spark, sf_dir):
    """Saved and loaded preprocessor over the 41 flow features."""
    flows = flow_records(spark, sf_dir, ROW_KEY).drop("label", "difficulty")
    path = scratch_path(spark, "preprocessor")
    FlowPreprocessor(CATEGORICAL, exclude=ROW_KEY).fit(flows).save(spark, path)
    model = FlowPreprocessorModel.load(spark, path)
    # One lambda for all slots: rounding spelled out for each makes a method the JVM only interprets.
    x = F.col("rounded")
    return model.transform(flows).select(*ROW_KEY, F.transform("features", lambda v: rounded(v, "v")).alias("rounded")).select(
        *ROW_KEY, *[x[i].alias(slot) for i, slot in enumerate(model.slots)])


# --- isolation forest -------------------------------------------------------------------------

_FITTED: dict[tuple, object] = {}


def _once(spark, sf_dir, name, fit):
    """Fit once per session and data; queries about other operators share the model."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def items(spark, sf_dir) -> DataFrame:
    return spread(lineitem(spark, sf_dir))


def _forest() -> IsolationForest:
    return IsolationForest(NUMERIC, key=ROW_KEY)


def item_forest(spark, sf_dir) -> IsolationForestModel:
    return _once(spark, sf_dir, "items", lambda: _forest().fit(items(spark, sf_dir)))


def item_detections(spark, sf_dir) -> DataFrame:
    return item_forest(spark, sf_dir).transform(items(spark, sf_dir))


def request_forest(spark, sf_dir) -> IsolationForestModel:
    return _once(spark, sf_dir, "requests", lambda: IsolationForest("features", ["vec_id"]).fit(
        request_vectors(read(spark, sf_dir, "embeddings"))))


def request_detections(spark, sf_dir) -> DataFrame:
    return request_forest(spark, sf_dir).transform(
        request_vectors(read(spark, sf_dir, "embeddings")))


@query
def if_sample(spark, sf_dir):
    sample, _ = _forest().sample(items(spark, sf_dir))
    return sample.select("tree", "rank", "key")


@query
def if_nodes(spark, sf_dir):
    nodes = _forest().fit(items(spark, sf_dir)).nodes
    return nodes.select("tree", "node", "depth", "feature", rounded("threshold"), "n",
                        rounded("path"))


@query
def if_scores(spark, sf_dir):
    return item_detections(spark, sf_dir).select(*ROW_KEY, rounded("anomaly_score"))


@query
def if_threshold(spark, sf_dir):
    model = item_forest(spark, sf_dir)
    scores = item_detections(spark, sf_dir)
    return scores.agg(F.count(F.lit(1)).alias("total")).select(
        "total", rounded(F.lit(model.threshold), "threshold"),
        rounded(F.lit(model.bounds[0]), "min_score"), rounded(F.lit(model.bounds[1]), "max_score"))


@query
def if_detect(spark, sf_dir):
    model = _forest().fit(items(spark, sf_dir))
    rows = model.transform(items(spark, sf_dir))
    return rows.select(*ROW_KEY, rounded("anomaly_score"), "prediction")


@query
def if_normalised(spark, sf_dir):
    return normalise_score(item_detections(spark, sf_dir)).select(
        *ROW_KEY, rounded("anomaly_score", "score"),
        severity(F.col("anomaly_score")).alias("severity"))


@query
def if_normalised_train_scope(spark, sf_dir):
    model = item_forest(spark, sf_dir)
    rows = normalise_score(item_detections(spark, sf_dir), scope="train", bounds=model.bounds)
    return rows.select(*ROW_KEY, rounded("anomaly_score", "score"))


@query
def anomaly_summary(spark, sf_dir):
    out = summaries.anomaly_summary(item_detections(spark, sf_dir))
    return out.select("total_samples", "anomalies_found", rounded("anomaly_rate"))


@query
def system_stats(spark, sf_dir):
    out = summaries.system_stats(request_detections(spark, sf_dir))
    return out.select("total_traffic_analyzed", "total_anomalies_detected",
                      rounded("detection_rate"))


@query
def request_summary(spark, sf_dir):
    return summaries.request_summary(request_detections(spark, sf_dir))


@query
def request_scores(spark, sf_dir):
    rows = normalise_score(request_detections(spark, sf_dir), by="request_id")
    return rows.select("request_id", "pos", "prediction", rounded("anomaly_score"))


@query
def alerts(spark, sf_dir):
    path = scratch_path(spark, "alerts")
    append_alerts(summaries.request_alerts(request_detections(spark, sf_dir)), path)
    return read_alerts(spark, path).select("id", naive("timestamp"), "anomalies_found",
                                           "total_samples")


def _daily_alerts(spark, sf_dir) -> str:
    """An alert table over five days, a writing for every two requests; its first three days are closed."""
    path = scratch_path(spark, "alerts")
    # A request's vectors come from two days.
    day = F.expr("make_dt_interval(cast(request_id % 5 as int) + if(pos < 20, 0, 1))")
    found = request_detections(spark, sf_dir).withColumn("ts", F.col("ts") + day)
    parts = summaries.request_alerts(found.withColumn("half", F.col("pos") < 20).withColumn(
        "request_id", F.struct("request_id", "half")), partial=True)
    halves = parts.withColumn("id", F.regexp_replace("id", r"^alert_\{(\d+), .*$", "alert_$1")).persist()
    first = F.expr("substring(id, 7) % 2 = 0")
    append_alerts(halves.filter(first), path, "even")
    append_alerts(halves.filter(~first), path, "odd")
    halves.unpersist()
    close_days(spark, path, "2024-01-03")
    close_days(spark, path, "2024-01-04")
    return path


@query
def latest_alerts_of_days(spark, sf_dir):
    """The latest alerts of a table kept by days, its older days closed."""
    found = latest_alerts(spark, _daily_alerts(spark, sf_dir), 5)
    return found.select("id", naive("timestamp"), "anomalies_found", "total_samples", "total_alerts")


@query
def recent_alerts(spark, sf_dir):
    found = summaries.request_alerts(request_detections(spark, sf_dir))
    return summaries.recent_alerts(found, 5).select(
        "id", naive("timestamp"), "anomalies_found", "total_samples", "total_alerts")


@query
def detections_sink(spark, sf_dir):
    path = scratch_path(spark, "detections")
    rows = normalise_score(item_detections(spark, sf_dir)).drop("l_shipdate")
    write_detections(rows, path)
    schema = rows.schema
    back = spark.read.schema(schema).option("header", "true").csv(path)
    return back.select(*ROW_KEY, *NUMERIC, "prediction", rounded("anomaly_score"))


@query
def security_event_log(spark, sf_dir):
    rows = normalise_score(item_detections(spark, sf_dir))
    found = security_events(
        rows, severity(F.col("anomaly_score")), F.col("l_suppkey"), F.col("l_partkey"),
        details={"order": F.col("l_orderkey"), "line": F.col("l_linenumber")})
    return found.select("event_type", "severity", "source_ip", "destination_ip",
                        F.col("details")["order"].alias("details_order"),
                        F.col("details")["line"].alias("details_line"))


@query
def security_events_stored(spark, sf_dir):
    """Events appended to their table in two writings, one of them repeated, and read back."""
    path = scratch_path(spark, "events")
    rows = normalise_score(item_detections(spark, sf_dir))
    found = security_events(
        rows, severity(F.col("anomaly_score")), F.col("l_suppkey"), F.col("l_partkey"),
        details={"order": F.col("l_orderkey"), "line": F.col("l_linenumber"), "day": F.trunc("l_shipdate", "year")})
    day = F.col("details")["day"]
    odd = F.expr("details['line'] % 2 = 1")
    for which, batch in ((odd, "1"), (~odd, "2"), (~odd, "2")):
        append_events(found.filter(which), path, day, batch)
    stored = read_events(spark, path, F.col("day") >= F.lit("1999-01-01"))
    return stored.select("event_type", "severity", "source_ip", "destination_ip",
                         F.col("details")["order"].alias("details_order"),
                         F.col("details")["line"].alias("details_line"), "day")


@query
def model_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "model")
    item_forest(spark, sf_dir).save(path)
    rows = load_model(spark, path).transform(items(spark, sf_dir))
    return rows.select(*ROW_KEY, rounded("anomaly_score"), "prediction")


@query
def detect_flows(spark, sf_dir):
    """Preprocess, fit, score and judge the 41 flow features end to end."""
    flows = flow_records(spark, sf_dir, ROW_KEY).drop("label", "difficulty")
    prep = FlowPreprocessor(CATEGORICAL, "minmax", exclude=ROW_KEY).fit(flows)
    model = IsolationForest("features", key=ROW_KEY).fit(prep.transform(flows))
    return detect(flows, prep, model).select(*ROW_KEY, "prediction", rounded("anomaly_score"))


@query
def train_detector(spark, sf_dir):
    """The whole training job: fit on four fifths of the flows, evaluate on the rest."""
    flows = flow_records(spark, sf_dir, ROW_KEY).drop("difficulty")
    parts = summaries.hash_split(process_labels(flows, binary=True), ROW_KEY)
    found = train(*parts, scratch_path(spark, "trained"), key=ROW_KEY, scaling="minmax")
    (tn, fp), (fn, tp) = found.pop("confusion_matrix")
    row = spark.createDataFrame(
        [(tn, fp, fn, tp, *[found[c] for c in RATES])],
        "tn long, fp long, fn long, tp long, " + ", ".join(f"{c} double" for c in RATES))
    return row.select("tn", "fp", "fn", "tp", *[rounded(c) for c in RATES])


@query
def detect_report(spark, sf_dir):
    """The whole detection job: saved models, detections on disk, count and rate returned."""
    flows = flow_records(spark, sf_dir, ROW_KEY).drop("label", "difficulty")
    root = scratch_path(spark, "detect")
    prep = FlowPreprocessor(CATEGORICAL, "minmax", exclude=ROW_KEY).fit(flows)
    prep.save(spark, f"{root}/preprocessor")
    IsolationForest("features", key=ROW_KEY).fit(prep.transform(flows)).save(f"{root}/model")
    found = detect_job(flows, f"{root}/preprocessor", f"{root}/model", f"{root}/out")
    back = spark.read.option("header", "true").csv(f"{root}/out")
    return back.agg(F.count(F.lit(1)).alias("rows_written"),
                    F.count_if(F.col("prediction") == "anomaly").alias("anomalies_written")).select(
        "rows_written", "anomalies_written", F.lit(found["total_samples"]).alias("total_samples"),
        F.lit(found["anomalies_found"]).alias("anomalies_found"),
        rounded(F.lit(found["anomaly_rate"]), "anomaly_rate"))


@query
def detect_without_score(spark, sf_dir):
    """Verdicts only."""
    return detect(items(spark, sf_dir), None, item_forest(spark, sf_dir), with_score=False).select(
        *ROW_KEY, "prediction")


@query
def load_flow_sets(spark, sf_dir):
    """Train and test files by one call, labels cleaned and reduced to two."""
    root = scratch_path(spark, "sets")
    flows = flow_records(spark, sf_dir)
    flows.write.csv(f"{root}/train")
    flows.filter(F.col("protocol_type") == "tcp").write.csv(f"{root}/test")
    parts = load_flows(spark, f"{root}/train", f"{root}/test", binary=True)
    tagged = [p.select(F.lit(n).alias("part"), "label", "src_bytes") for n, p in zip(("train", "test"), parts)]
    return tagged[0].unionByName(tagged[1]).groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("src_bytes").alias("src_bytes"))


@query
def zscore_verdict(spark, sf_dir):
    """Verdicts by a cut on the standardised price."""
    rows = lineitem(spark, sf_dir).select("l_extendedprice")
    centre, divisor = scaling_parameters(rows, ["l_extendedprice"], "standard")["l_extendedprice"]
    z = F.abs((F.col("l_extendedprice") - centre) / divisor)
    judged = with_verdict(rows.withColumn("z", z), "z", 1.5)
    out = summaries.anomaly_summary(judged)
    return out.select("total_samples", "anomalies_found", rounded("anomaly_rate"))


# --- metrics ----------------------------------------------------------------------------------

def _quality(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(
        F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("flag"))


def _judged(spark, sf_dir):
    rows = item_detections(spark, sf_dir).withColumn(
        "label", F.when(F.col("l_returnflag") == "R", "attack").otherwise("normal"))
    return rows.select(truth_flag(rows).alias("truth"),
                       anomaly_flag(F.col("prediction")).alias("flag"),
                       F.col("anomaly_score").alias("score"))


def _three_class(spark, sf_dir):
    guess = F.when(F.col("l_partkey") % 3 == 0, "A").when(F.col("l_partkey") % 3 == 1, "N")
    return lineitem(spark, sf_dir).select(
        F.col("l_returnflag").alias("actual"), guess.otherwise("X").alias("predicted"))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_quality(spark, sf_dir), "truth", "flag")


@query
def binary_metrics(spark, sf_dir):
    out = metrics.binary_metrics(_quality(spark, sf_dir), "truth", "flag")
    return out.select(*[rounded(c) for c in out.columns])


@query
def if_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_judged(spark, sf_dir), "truth", "flag")


@query
def if_evaluate(spark, sf_dir):
    path = scratch_path(spark, "judged")
    _judged(spark, sf_dir).write.parquet(path)
    judged = spark.read.parquet(path)
    out = metrics.binary_metrics(judged, "truth", "flag")
    auc = metrics.roc_auc(judged, "truth", "score")
    return out.select(*[rounded(c) for c in out.columns],
                      rounded(F.lit(auc).cast("double"), "roc_auc"))


@query
def roc_auc(spark, sf_dir):
    """Rejection by price alone; equal prices count half."""
    rows = lineitem(spark, sf_dir).select(
        (F.col("l_returnflag") == "R").cast("int").alias("truth"),
        F.floor("l_extendedprice").cast("double").alias("score"))
    auc = metrics.roc_auc(rows, "truth", "score")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", rounded(F.lit(auc).cast("double"), "roc_auc"))


@query
def weighted_metrics(spark, sf_dir):
    out = metrics.weighted_metrics(_three_class(spark, sf_dir), "actual", "predicted")
    return out.select(*[rounded(c) for c in out.columns])


@query
def class_report(spark, sf_dir):
    out = metrics.class_report(_three_class(spark, sf_dir), "actual", "predicted")
    return out.select("kind", "class", rounded("precision"), rounded("recall"),
                      rounded("f1_score"), "support")


# --- random forest ----------------------------------------------------------------------------

def _label_rows(spark, sf_dir):
    return request_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", "label", "features")


def vector_classifier(spark, sf_dir) -> RandomForestModel:
    return _once(spark, sf_dir, "classes", lambda: fit_random_forest(spread(_label_rows(spark, sf_dir))))


@query
def rf_stump(spark, sf_dir):
    """One tree of one split, saved and loaded: small enough to be worked out in SQL."""
    rows = items(spark, sf_dir).withColumn("label", F.when(
        F.col("l_quantity") + 3 * F.col("l_linenumber") > 45, "attack").otherwise("normal"))
    slots = ["l_quantity", "l_linenumber", "l_discount"]
    rows = rows.withColumn("features", F.array(*[F.col(c).cast("double") for c in slots]))
    model = fit_random_forest(rows, trees=1, max_depth=1, bootstrap=False, feature_subset="all", slots=slots)
    path = scratch_path(spark, "stump")
    model.save(path)
    model = load_model(spark, path)
    used = top_features(model, 1).first()
    return model.transform(rows).select(
        *ROW_KEY, "label", "predicted",
        *[rounded(F.col("class_probability")[i], f"p_{c}") for i, c in enumerate(model.classes)],
        F.lit(used["feature"]).alias("top_feature"), rounded(F.lit(used["importance"]), "importance"))


@query
def rf_predict(spark, sf_dir):
    """What holds of any forest's predictions: sums, and the class of the greatest probability."""
    model = vector_classifier(spark, sf_dir)
    rows = model.transform(_label_rows(spark, sf_dir))
    p = F.col("class_probability")
    named = F.element_at(F.lit(model.classes).cast("array<string>"), F.array_position(p, F.array_max(p)).cast("int"))
    return rows.select("vec_id", "label", F.size(p).alias("classes"),
                       rounded(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), "probability_sum"),
                       (named == F.col("predicted")).alias("predicts_likeliest"))


@query
def rf_importance(spark, sf_dir):
    """Importances per slot: as many as features, none negative, adding up to 1."""
    model = vector_classifier(spark, sf_dir)
    rows = _label_rows(spark, sf_dir).agg(F.max(F.size("features")).alias("features"))
    found = model.importances()
    top = top_features(model, 10)
    return rows.select(
        "features", found.agg(F.count(F.lit(1))).scalar().alias("slots"),
        rounded(found.agg(F.sum("importance")).scalar(), "importance_sum"),
        (found.agg(F.min("importance")).scalar() >= 0).alias("none_negative"),
        top.agg(F.count(F.lit(1))).scalar().alias("top"))


@query
def rf_evaluate(spark, sf_dir):
    """The per-class report of the training rows: support, and recall that beats the majority."""
    rows = vector_classifier(spark, sf_dir).transform(_label_rows(spark, sf_dir))
    found = evaluate_classifier(rows)
    report = spark.createDataFrame(
        [(r["kind"], r["class"], r["support"], r["recall"]) for r in found["class_report"]],
        "kind string, class string, support long, recall double")
    most = report.filter(F.col("kind") == "class").agg(F.max("support") / F.sum("support")).scalar()
    return report.select("kind", "class", "support",
                         (F.lit(found["accuracy"]) > most).alias("beats_majority"))


@query
def rf_flows(spark, sf_dir):
    """A balanced forest of full size on held-out flows, labelled by their protocol and flag."""
    flows = process_labels(flow_records(spark, sf_dir, ROW_KEY).drop("difficulty"))
    told = F.when(F.col("flag") == "S0", "dos").when(F.col("protocol_type") == "icmp", "probe").otherwise("normal")
    train, test = summaries.hash_split(flows.withColumn("label", told), ROW_KEY)
    prep = FlowPreprocessor(CATEGORICAL, exclude=[*ROW_KEY, "label"]).fit(train)
    model = fit_random_forest(prep.transform(train))
    found = evaluate_classifier(model.transform(prep.transform(test)))
    n = test.agg(F.count(F.lit(1)).alias("test_rows"))
    return n.select("test_rows", F.lit(len(model.classes)).alias("classes"),
                    F.lit(found["accuracy"] > 0.9).alias("accurate"))


# --- windowed traffic features ----------------------------------------------------------------

def _features(spark, sf_dir, names, window):
    rows = flow_features(connections(read(spark, sf_dir, "events")), window,
                         time_windows=names is TIME_FEATURES)
    return rows.select("conn_id", *[
        rounded(F.col(f"`{n}`").cast("double"), n) if n.endswith("rate") else F.col(f"`{n}`")
        for n in names])


@query
def win_time(spark, sf_dir):
    return _features(spark, sf_dir, TIME_FEATURES, 2.0)


@query
def win_time_hour(spark, sf_dir):
    return _features(spark, sf_dir, TIME_FEATURES, 3600.0)


@query
def win_last100(spark, sf_dir):
    return _features(spark, sf_dir, HOST_FEATURES, 2.0)


# --- streams ----------------------------------------------------------------------------------

def _table_stream(spark, sf_dir, table) -> DataFrame:
    rows = read(spark, sf_dir, table)
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{table}.parquet").parquet(
        sf_dir)
    # A single file a micro-batch; if it is one task, spread it as a folder of many files would be.
    return stream.repartition(spark.sparkContext.defaultParallelism) if uneven(rows) else stream


def _run(start: Callable[[str, str], object], spark) -> str:
    path = scratch_path(spark, "stream")
    start(f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


@query
def stream_scores(spark, sf_dir):
    model = item_forest(spark, sf_dir)
    stream = _table_stream(spark, sf_dir, "lineitem")
    out = _run(lambda p, c: scoring.score_stream(stream, model, p, c), spark)
    return spark.read.parquet(out).select(*ROW_KEY, rounded("anomaly_score"), "prediction")


def _in_slices(spark, slices: list[DataFrame], start: Callable) -> str:
    """Feed a stream a slice after the other, each written by Spark and run to its end; the output's path."""
    path = scratch_path(spark, "stream")
    for rows in slices:
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        start(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


def _split_requests(spark, sf_dir) -> list[DataFrame]:
    """Slices of requests that cut every request in three."""
    rows = request_vectors(spread(read(spark, sf_dir, "embeddings")))
    return [rows.filter(F.col("pos") % 3 == i) for i in range(3)]


@query
def stream_request_scores(spark, sf_dir):
    root = scratch_path(spark, "published")
    publish_model(spark, request_forest(spark, sf_dir), root)
    out = _in_slices(spark, _split_requests(spark, sf_dir),
                     lambda s, p, c: scoring.score_requests_stream(s, root, p, c))
    return scoring.read_request_scores(spark, out).select(
        "request_id", "pos", "prediction", rounded("anomaly_score"), "model_version")


def _stream_alerts(spark, sf_dir) -> DataFrame:
    model = request_forest(spark, sf_dir)
    return read_alerts(spark, _in_slices(spark, _split_requests(spark, sf_dir),
                                         lambda s, p, c: scoring.alert_stream(s, model, p, c)))


@query
def stream_alerts(spark, sf_dir):
    return _stream_alerts(spark, sf_dir).select("id", naive("timestamp"), "anomalies_found",
                                                "total_samples")


@query
def stream_alerts_resent(spark, sf_dir):
    """Every slice is sent twice, and no alert changes."""
    model = request_forest(spark, sf_dir)
    slices = _split_requests(spark, sf_dir)
    out = _in_slices(spark, [s for i, rows in enumerate(slices) for s in (rows, slices[i - 1] if i else rows)],
                     lambda s, p, c: scoring.alert_stream(sent_once(s, ["vec_id"], within="30 days"), model, p, c))
    return read_alerts(spark, out).select("id", naive("timestamp"), "anomalies_found", "total_samples")


@query
def stream_recent_alerts(spark, sf_dir):
    """The latest alerts of the stream's table."""
    return summaries.recent_alerts(_stream_alerts(spark, sf_dir), 5).select(
        "id", naive("timestamp"), "anomalies_found", "total_samples", "total_alerts")


@query
def stream_stats(spark, sf_dir):
    model = item_forest(spark, sf_dir)
    stream = _table_stream(spark, sf_dir, "lineitem")
    out = _run(lambda p, c: scoring.stats_stream(stream, model, p, c), spark)
    return scoring.latest_stats(spark, out).select(
        "total_traffic_analyzed", "total_anomalies_detected", rounded("detection_rate"))


@query
def stream_tumbling(spark, sf_dir):
    """Events above a value, per day; days still open at the watermark are not out yet."""
    stream = _table_stream(spark, sf_dir, "events").select("ts", "value")
    judged = with_verdict(stream, "value", 100.0)

    def start(path, checkpoint):
        return (scoring.anomaly_windows(judged).writeStream.format("parquet")
                .outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    return spark.read.parquet(_run(start, spark)).select(
        naive("window_start"), naive("window_end"), "total_samples", "anomalies_found")


def _time_slices(rows: DataFrame, n: int = 4, ts: str = "ts") -> list[DataFrame]:
    """Rows in ``n`` slices of equal time; the last also takes those without a time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    part = F.coalesce(F.least(F.floor((at - first) * n / (last - first + 1)), F.lit(n - 1)), F.lit(n - 1))
    return [rows.filter(part == i) for i in range(n)]


@query
def stream_flow_features(spark, sf_dir):
    """All windowed features, the log arriving in four slices of time."""
    state = scratch_path(spark, "state")
    conns = connections(spread(read(spark, sf_dir, "events")))
    out = _in_slices(spark, _time_slices(conns), lambda s, p, c: flow_features_stream(
        s, p, state, c, window_seconds=3600.0))
    names = [*TIME_FEATURES, *HOST_FEATURES]
    return spark.read.parquet(out).select("conn_id", *[
        rounded(n) if n.endswith("rate") else F.col(f"`{n}`") for n in names])


@query
def stream_flow_state(spark, sf_dir):
    """The same features by keyed state per host and service."""
    conns = connections(spread(read(spark, sf_dir, "events")))
    out = _in_slices(spark, _time_slices(conns), lambda s, p, c: flow_state_stream(s, p, c, window_seconds=3600.0))
    names = [*TIME_FEATURES, *HOST_FEATURES]
    return spark.read.parquet(out).select("conn_id", "behind_seconds", *[
        rounded(n) if n.endswith("rate") else F.col(f"`{n}`") for n in names])


@query
def stream_late_rows(spark, sf_dir):
    """Rows taken in and dropped per micro-batch: the last of four slices comes before the third."""
    conns = connections(spread(read(spark, sf_dir, "events")))
    first, second, third, fourth = _time_slices(conns)
    log = scratch_path(spark, "progress")
    listener = ProgressLog(spark, log)
    spark.streams.addListener(listener)
    try:
        _in_slices(spark, [first, second, fourth, third], lambda s, p, c: flow_state_stream(
            s, p, c, idle_seconds=30 * 86400.0, late="2 days"))
        listener.wait(4)
    finally:
        spark.streams.removeListener(listener)
    # A dropped connection is missed by its host and by its service.
    order = F.row_number().over(Window.orderBy("batch"))
    return read_progress(spark, log).filter("input_rows > 0").select(
        order.alias("slice"), "input_rows", (F.col("dropped_rows") / 2).cast("long").alias("dropped_rows"))


@query
def stream_truth(spark, sf_dir):
    """Detections joined with labels that come before them, in time, too late or never."""
    events = spread(read(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    found = with_verdict(events.select("event_id", "ts", "value"), "value", 100.0)
    minutes = (F.col("event_id") % 7 - 1) * 15
    labels = events.filter(F.col("event_id") % 7 != 0).select(
        "event_id", (F.unix_micros("ts") + minutes * 60_000_000).alias("at"),
        F.when(F.col("event_type") == "error", "attack").otherwise("normal").alias("label")).select(
        "event_id", F.timestamp_micros("at").alias("labelled_at"), "label")
    path = scratch_path(spark, "truth")
    for mine, theirs in zip(_time_slices(found), _time_slices(labels, ts="labelled_at"), strict=True):
        mine.write.mode("append").parquet(f"{path}/detections")
        theirs.write.mode("append").parquet(f"{path}/labels")
        truth_stream(spark.readStream.schema(found.schema).parquet(f"{path}/detections"),
                     spark.readStream.schema(labels.schema).parquet(f"{path}/labels"), "event_id",
                     f"{path}/out", f"{path}/checkpoint", within="40 minutes", late="10 minutes").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "prediction", "label")


@query
def stream_enriched(spark, sf_dir):
    """Events joined with customers, whose table changes between two micro-batches."""
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    root = scratch_path(spark, "customers")
    slices = _time_slices(spread(read(spark, sf_dir, "events")).select("event_id", "user_id", "ts"), 2)
    tables = iter([customers, customers.withColumn("segment", F.lower("segment"))])

    def start(stream, path, checkpoint):
        publish_table(next(tables), root)
        return enriched_stream(stream.drop("ts"), root, ["user_id"], path, checkpoint)

    out = _in_slices(spark, slices, start)
    return spark.read.parquet(out).select("event_id", "user_id", "segment", "table_version")


@query
def sessions(spark, sf_dir):
    """Sessions of a host with no more than six hours between connections."""
    found = host_sessions(connections(read(spark, sf_dir, "events")), "6 hours")
    return found.select("dst_ip", naive("session_start"), naive("session_end"), "connections",
                        rounded("bytes"), "syn_errors", "rejections")


@query
def stream_sessions(spark, sf_dir):
    """The same on a stream: sessions that the watermark has closed."""
    def start(stream, path, checkpoint):
        return (host_sessions(stream, "6 hours", watermark="1 hour").writeStream.format("parquet")
                .outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    out = _in_slices(spark, _time_slices(connections(spread(read(spark, sf_dir, "events")))), start)
    return spark.read.parquet(out).select("dst_ip", naive("session_start"), naive("session_end"), "connections")
