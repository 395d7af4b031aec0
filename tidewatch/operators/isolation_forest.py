"""Isolation forest: hash-ranked samples, one small tree per group, vectorised scoring.

Every random choice is a hash of seed, tree and row key or node, so that the same rows give the
same forest on any partitioning. A fitted forest is a node table of at most
``trees * (2 psi - 1)`` rows, whatever the input; scoring broadcasts it.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.verdicts import verdict
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.session import drop_path, scratch_path

KIND = "isolation_forest"
NODE_SCHEMA = ("tree int, node long, depth int, feature int, threshold double, n long, "
               "path double")
# Nodes of a forest at most: the table is held by the driver and broadcast to score.
MOST_NODES = 10_000_000
# Copies of one row that are numbered by one task.
COPIES = 100_000
# Levels of a tree that are asked of whole columns: seven nodes, the bits of a byte.
TOP = 3
EULER = 0.5772156649015329

# Executors get the tree code with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _unit(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def grow_tree(x: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    """Node rows of one isolation tree over a sample of at most psi rows."""
    rows, open_nodes = [], [(1, 0, np.arange(len(x)))]
    while open_nodes:
        node, depth, members = open_nodes.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(low < high)
        if len(members) <= 1 or depth >= max_depth or not len(splittable):
            rows.append((tree, node, depth, -1, None, len(members),
                         depth + average_path(len(members))))
            continue
        prefix = f"{seed}|{tree}|{node}|"
        feature = int(splittable[math.floor(_unit(prefix + "f") * len(splittable))])
        lo, hi = float(low[feature]), float(high[feature])
        threshold = lo + _unit(prefix + "t") * (hi - lo)
        threshold = lo if threshold >= hi else threshold
        rows.append((tree, node, depth, feature, threshold, len(members), None))
        left = part[:, feature] <= threshold
        open_nodes += [(2 * node, depth + 1, members[left]),
                       (2 * node + 1, depth + 1, members[~left])]
    return rows


def halves(digest: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first two numbers of eight hex digits each of digests of 32."""
    if not len(digest):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    digest = digest.cast(pa.string())
    offsets = np.frombuffer(digest.buffers()[1], np.int32)[digest.offset:digest.offset + len(digest) + 1]
    text = np.frombuffer(digest.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, 32)[:, :16]
    digits = np.where(text < 58, text - 48, text - 87).astype(np.uint32).reshape(-1, 2, 8)
    numbers = (digits << np.arange(28, -4, -4, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    return numbers[:, 0], numbers[:, 1]


def lowest_draws(a: np.ndarray, b: np.ndarray, trees: int, limit: int) -> pa.Array:
    """Per row the trees whose hash (a + tree * b) mod 2^32 is below ``limit``, ascending; a and b are unsigned, of 32 bits."""
    at, of = [], []
    h, step = a.copy(), b
    for tree in range(trees):
        hit = np.flatnonzero(h < limit)
        at.append(hit)
        of.append(np.full(len(hit), tree, np.int32))
        h += step
    at, of = np.concatenate(at), np.concatenate(of)
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(a)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(of[np.argsort(at, kind="stable")]))


class IsolationForest:
    """Settings of a fit.

    ``features`` is a vector or array column, or a list of numeric columns. Every tree draws its
    rows from all rows by a hash of ``key``, the columns that identify a row; rows that share a
    key share their draws. Without a key a row is known by its features and, among equal rows, a
    number, so the draw is the same on any partitioning. ``quantiles`` sets the threshold; it may
    be ``sketches.approximate_quantiles``, which scores once and is near the threshold.
    """

    def __init__(self, features: str | list[str] = "features", key: list[str] | None = None,
                 trees: int = 100, psi: int = 256, contamination: float = 0.1, seed: int = 42,
                 train_filter: Column | None = None, quantiles: Callable = exact_quantiles):
        if trees < 1 or psi < 2:
            raise ValueError("trees must be at least 1 and psi at least 2")
        if trees * (2 * psi - 1) > MOST_NODES:
            raise ValueError(f"trees * (2 psi - 1) must not exceed {MOST_NODES} nodes")
        if not 0 < contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        self.features, self.key = features, list(key or [])
        self.trees, self.psi, self.contamination, self.seed = trees, psi, contamination, seed
        self.train_filter, self.quantiles = train_filter, quantiles

    def sample(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(tree, rank, key, x) with the psi lowest-hashed rows of each tree, and the row count."""
        df = df if self.train_filter is None else df.filter(self.train_filter)
        spark = df.sparkSession
        total = df.count()
        if not total:
            raise ValueError("cannot fit an isolation forest on no rows")
        rows, path = self._identified(df), scratch_path(spark, "sample")
        self._rank(rows, 4.0 * self.psi / total).write.parquet(path)
        # Exact whatever the hashes are: if a tree is short of rows, all rows are ranked.
        need = min(self.psi, total)
        full = spark.read.parquet(path).groupBy("tree").count().filter(F.col("count") >= need)
        if full.count() < self.trees:
            drop_path(spark, path)
            path = scratch_path(spark, "sample")
            self._rank(rows, 1.0).write.parquet(path)
        return spark.read.parquet(path), total

    def _features(self, df: DataFrame) -> Column:
        """The features as the array that is sampled."""
        return feature_array(df, self.features)

    @staticmethod
    def _tree(x: pd.Series, tree: int, seed: int, depth: int) -> list[tuple]:
        return grow_tree(np.vstack(x.to_numpy()), tree, seed, depth)

    def _model(self, spark: SparkSession, nodes: pd.DataFrame, params: dict) -> IsolationForestModel:
        return IsolationForestModel(spark, nodes, params)

    def _identified(self, df: DataFrame) -> DataFrame:
        """(key, x): the features of each row and a text that identifies it."""
        x = self._features(df).alias("x")
        if self.key:
            parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.key]
            joined = [c for part in parts for c in (F.lit("|"), part)][1:]
            return df.select(F.concat(*joined).alias("key"), x)
        # Copies are counted map-side and numbered a chunk at a time, not in one task.
        counted = df.select(x).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("chunk")
        chunks = counted.select("x", "n", chunk).repartition("x", "chunk")
        number = F.explode(F.sequence(F.col("chunk") * COPIES, F.least(
            F.col("n"), (F.col("chunk") + 1) * COPIES) - 1)).alias("number")
        return chunks.select("x", number).select(
            F.concat(F.md5(F.array_join(F.col("x").cast("array<string>"), "|", "").cast("binary")),
                     F.lit("|"), F.col("number").cast("string")).alias("key"), "x")

    def _rank(self, rows: DataFrame, share: float) -> DataFrame:
        """Row hashes of all trees from one digest: (a + tree * b) mod 2^32."""
        rows = rows.select("key", "x", F.md5(F.concat(F.lit(f"{self.seed}|"), "key").cast("binary")).alias("digest"))
        if share < 1.0:
            # Most rows are drawn by no tree: they are left out before anything is made of them.
            trees, limit = self.trees, math.ceil(share * (1 << 32))

            @F.arrow_udf("array<int>")
            def drawn_by(digest: pa.Array) -> pa.Array:
                return lowest_draws(*halves(digest), trees, limit)

            rows = rows.filter("digest IS NOT NULL").withColumn("trees", drawn_by("digest")).filter(F.size("trees") > 0)
            tree = F.explode("trees")
        else:
            tree = F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))
        a, b = (F.conv(F.substring("digest", at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "a"), (9, "b")))
        drawn = rows.select("key", "x", a, b, tree.alias("tree")).select(
            "key", "x", "tree", ((F.col("a") + F.col("tree") * F.col("b")) % (1 << 32)).alias("h"))
        order = Window.partitionBy("tree").orderBy("h", "key", "x")
        return (drawn.withColumn("rank", F.row_number().over(order))
                .filter(F.col("rank") <= self.psi).select("tree", "rank", "key", "x"))

    def grow(self, sample: DataFrame, total: int) -> DataFrame:
        """The node table; each task grows one tree from its psi rows, or all if there are fewer."""
        tree, seed, depth = self._tree, self.seed, math.ceil(math.log2(max(2, min(self.psi, total))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = tree(pdf["x"], int(pdf["tree"].iloc[0]), seed, depth)
            return pd.DataFrame(rows, columns=["tree", "node", "depth", "feature", "threshold",
                                               "n", "path"])

        return sample.select("tree", "x").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)

    def fit(self, df: DataFrame) -> IsolationForestModel:
        """Sample, grow, score the training rows, set the threshold at their 1 - c quantile."""
        spark = df.sparkSession
        rows = df if self.train_filter is None else df.filter(self.train_filter)
        sample, total = self.sample(df)
        nodes = self.grow(sample, total).toPandas()
        width = sample.agg(F.max(F.size("x"))).first()[0]
        for path in {p.rsplit("/", 1)[0] for p in sample.inputFiles()}:
            drop_path(spark, path)
        params = {"kind": KIND, "trees": self.trees, "psi": self.psi, "seed": self.seed,
                  "sample_size": min(self.psi, total), "contamination": self.contamination,
                  "features": self.features, "key": self.key, "width": width}
        model = self._model(spark, nodes, params)
        # The quantile passes read a written copy of the scores instead of scoring again.
        scores = model.score(rows).select("anomaly_score")
        threshold = self.quantiles(scores, ["anomaly_score"],
                                   [0.0, 1 - self.contamination, 1.0])["anomaly_score"]
        params["min_score"], params["threshold"], params["max_score"] = threshold
        return model


class IsolationForestModel:
    """A fitted forest: node table (bounded, see ``MOST_NODES``) and settings, in memory."""

    def __init__(self, spark: SparkSession, nodes: pd.DataFrame, params: dict):
        self.spark, self.params, self._nodes = spark, params, nodes
        self._forest = spark.sparkContext.broadcast(self._packed(nodes))

    def _packed(self, nodes: pd.DataFrame) -> dict:
        return pack_forest(nodes)

    def release(self) -> None:
        """Drop the executors' copies; scoring sends them again."""
        self._forest.unpersist()

    @property
    def threshold(self) -> float:
        return self.params["threshold"]

    @property
    def bounds(self) -> tuple[float, float]:
        """Least and greatest score of the training rows."""
        return self.params["min_score"], self.params["max_score"]

    @property
    def nodes(self) -> DataFrame:
        names = [field.split()[0] for field in NODE_SCHEMA.split(", ")]
        plain = self._nodes[names].astype(object).where(self._nodes[names].notna(), None)
        return self.spark.createDataFrame(plain.values.tolist(), NODE_SCHEMA)

    def score(self, df: DataFrame, output: str = "anomaly_score") -> DataFrame:
        """The input plus the raw anomaly score 2^(-mean path / c(sample size)).

        Only the features go to the Python workers; all other columns stay in the JVM.
        """
        forest, width = self._forest, self.params["width"]

        @F.arrow_udf("double")
        def mean_path(x: pa.Array) -> pa.Array:
            return pa.array(walk(forest.value, to_matrix(x, width)))

        path = mean_path(feature_array(df, self.params["features"]))
        norm = average_path(self.params["sample_size"])
        return df.withColumn(output, F.pow(F.lit(2.0), -path / F.lit(norm or 1.0)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores and verdicts; a score strictly above the threshold is an anomaly."""
        return self.score(df).withColumn(
            "prediction", verdict(F.col("anomaly_score"), self.threshold))

    def save(self, path: str) -> None:
        """Node table and settings below ``path``."""
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        _write_params(self.spark, path, self.params)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForestModel:
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
        return IsolationForestModel(spark, nodes, read_params(spark, path))


def pack_forest(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """The trees as arrays by node number, all as deep as the deepest: below a leaf all goes left."""
    depth = int(nodes["depth"].max())
    names, tree = np.unique(nodes["tree"].to_numpy(), return_inverse=True)
    node, leaf = nodes["node"].to_numpy(np.int64), nodes["feature"].to_numpy() < 0
    shape, split = (len(names), 2 << depth), (tree[~leaf], node[~leaf])
    feature, threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
    feature[split] = nodes["feature"].to_numpy()[~leaf]
    threshold[split] = nodes["threshold"].to_numpy()[~leaf]
    path = np.zeros((len(names), 1 << depth))
    ends = node[leaf] << (depth - nodes["depth"].to_numpy(np.int64)[leaf])
    path[tree[leaf], ends - (1 << depth)] = nodes["path"].to_numpy()[leaf]
    return {"feature": feature, "threshold": threshold, "path": path, "depth": depth}


def walk(forest: dict, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row, all rows of a batch one level at a time.

    The first nodes of a tree are asked of whole columns; their answers, as bits, give the node that
    a row has come to.
    """
    size, depth = len(x), forest["depth"]
    columns, here = np.ascontiguousarray(x.T), np.arange(len(x))
    cells, first = columns.ravel(), min(TOP, depth)
    answers = np.arange(1 << ((1 << first) - 1))
    reached = np.ones(len(answers), np.int64)
    for _ in range(first):
        reached = 2 * reached + (answers >> (reached - 1) & 1)
    total = np.zeros(size)
    for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"], strict=True):
        bits = np.zeros(size, np.uint8)
        for i in range((1 << first) - 1):
            if threshold[i + 1] < np.inf:
                bits |= (columns[feature[i + 1]] > threshold[i + 1]).view(np.uint8) << np.uint8(i)
        at, column = reached.take(bits), feature * size
        for _ in range(depth - first):
            right = cells.take(column.take(at) + here) > threshold.take(at)
            at += at
            at += right
        total += path.take(at - (1 << depth))
    return total / len(forest["feature"])


def to_matrix(x: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of ``width`` numbers as a matrix; other widths, NULL and NaN are errors."""
    if not len(x):
        return np.zeros((0, width))
    values = x.flatten()
    if x.null_count or values.null_count:
        raise ValueError("features must not be NULL; fill them before scoring")
    lengths = np.diff(np.asarray(x.offsets))
    if (lengths != width).any():
        raise ValueError(f"the forest takes {width} features, not {lengths[lengths != width][0]}")
    matrix = values.to_numpy().reshape(len(x), width)
    if np.isnan(matrix).any():
        raise ValueError("features must not be NaN; fill them before scoring")
    return matrix


def feature_array(df: DataFrame, features: str | list[str]) -> Column:
    """The features as an array of doubles."""
    if isinstance(features, list):
        return F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(F.col(features))
    return F.col(features).cast("array<double>")


def _write_params(spark: SparkSession, path: str, params: dict) -> None:
    row = spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1)
    row.write.mode("overwrite").json(f"{path}/params")


def read_params(spark: SparkSession, path: str) -> dict:
    """Settings of a saved model; its ``kind`` says which class loads it."""
    return json.loads(spark.read.schema("params string").json(f"{path}/params").first()[0])


def normalise_score(df: DataFrame, score: str = "anomaly_score", scope: str = "batch",
                    by: str | None = None, bounds: tuple[float, float] | None = None,
                    output: str | None = None) -> DataFrame:
    """The score rescaled to [0, 1], all 0 where the batch is flat.

    ``batch`` takes the least and greatest score of the rows given, or of each ``by`` group (NULL
    is a group); the rows are written first, as scores are read twice and shall be computed once.
    ``train`` takes fixed ``bounds`` (a model's stored ones), clipped, and so works row by row.
    """
    output = output or score
    if scope == "train":
        if bounds is None:
            raise ValueError("scope 'train' needs bounds")
        low, high = (F.lit(float(b)) for b in bounds)
        return df.withColumn(output, F.least(F.greatest(
            _rescale(F.col(score), low, high), F.lit(0.0)), F.lit(1.0)))
    if scope != "batch":
        raise ValueError(f"scope must be 'batch' or 'train', not {scope!r}")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "scored")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    limits = [F.min(score).alias("__low"), F.max(score).alias("__high")]
    if by is None:
        # A one-row subquery over the score alone; no join, nothing collected.
        ends = df.agg(F.struct(*limits).alias("ends")).scalar()
        return df.withColumn(output, _rescale(F.col(score), ends["__low"], ends["__high"]))
    # Map-side combined, then joined back: a request with most of the rows is never one group.
    groups = df.groupBy(F.col(f"`{by}`").alias("__by")).agg(*limits)
    joined = df.join(groups, F.col(f"`{by}`").eqNullSafe(F.col("__by")))
    return (joined.withColumn(output, _rescale(F.col(score), F.col("__low"), F.col("__high")))
            .drop("__low", "__high", "__by"))


def _rescale(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / (high - low)).when(score.isNotNull(), F.lit(0.0))
