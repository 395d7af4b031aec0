"""Categories of any number: a lookup table gives their slots, features are sparse.

Values stay in a table that Spark sorts, numbers and joins; nothing of them comes to the driver.
The slots are those of ``FlowPreprocessor``, so a forest on sparse features has the nodes and
scores of one on the dense array.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.isolation_forest import (
    NODE_SCHEMA, IsolationForest, IsolationForestModel, average_path, grow_tree, pack_forest, walk,
)
from tidewatch.operators.preprocess import ENCODINGS, numeric_columns, scaling_parameters
from tidewatch.schema import LABEL
from tidewatch.session import drop_path, scratch_path

# Executors get the tree code with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def number_values(values: DataFrame, keys: list[str], path: str) -> None:
    """Write distinct rows of ``keys`` with their place in the sorted order, from 0, as ``place``.

    Ranges of the order are sorted apart; only the number of rows of each range is collected.
    """
    spark = values.sparkSession
    ranges = scratch_path(spark, "ranges")
    values.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).write.parquet(ranges)
    rows = spark.read.schema(T.StructType([*values.schema, T.StructField("part", T.IntegerType())])).parquet(ranges)
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    before, first = {}, 0
    for part, size in sizes:
        before[part], first = first, first + size
    pairs = [F.lit(x) for part, start in before.items() for x in (part, start)]
    start = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1 + start
    rows.select(*keys, place.cast("long").alias("place")).write.parquet(path)
    drop_path(spark, ranges)


class SparseFlowPreprocessor:
    """Fits scaling and encoding as ``FlowPreprocessor`` does, for columns of very many values.

    One-hot gives a struct ``features`` (size, indices, values), label encoding the plain array.
    """

    def __init__(self, categorical: list[str], scaling: str = "standard", encoding: str = "onehot",
                 exclude: list[str] | None = None, output: str = "features"):
        if encoding not in ENCODINGS:
            raise ValueError(f"encoding must be one of {ENCODINGS}, not {encoding!r}")
        self.categorical, self.scaling, self.encoding = list(categorical), scaling, encoding
        self.exclude, self.output = [LABEL] if exclude is None else list(exclude), output

    def fit(self, df: DataFrame, path: str | None = None) -> SparsePreprocessorModel:
        """The fitted model, kept below ``path`` (a scratch folder, if none is given)."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "encoder")
        numeric = numeric_columns(df, self.categorical, self.exclude)
        cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in self.categorical]))
        values = df.select(cells.alias("i", "v")).filter(F.col("v").isNotNull()).distinct()
        number_values(values, ["i", "v"], f"{path}/places")
        places = spark.read.parquet(f"{path}/places")
        firsts = {r["i"]: (r["first"], r["n"]) for r in places.groupBy("i").agg(
            F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
        params = {
            "encoding": self.encoding, "output": self.output, "categorical": self.categorical,
            "numeric": [[c, *p] for c, p in scaling_parameters(df, numeric, self.scaling).items()],
            "firsts": [firsts.get(i, (0, 0))[0] for i in range(len(self.categorical))],
            "size": len(numeric) + sum(n for _, n in firsts.values())}
        spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode(
            "overwrite").json(f"{path}/params")
        return SparsePreprocessorModel.load(spark, path)


class SparsePreprocessorModel:
    """A fitted lookup table and settings."""

    def __init__(self, places: DataFrame, params: dict):
        self.places, self.params = places, params

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparsePreprocessorModel:
        row = spark.read.schema("params string").json(f"{path}/params").first()
        return SparsePreprocessorModel(
            spark.read.schema("i int, v string, place long").parquet(f"{path}/places"), json.loads(row[0]))

    def transform(self, df: DataFrame) -> DataFrame:
        """The input plus its features. Each column is looked up by a join whose way Spark picks by
        size; a NULL or unseen category has no slot, or -1 as its label."""
        params, rows = self.params, df
        for i, c in enumerate(params["categorical"]):
            own = self.places.filter(F.col("i") == i).select(
                F.col("v").alias(f"_value{i}"), F.col("place").alias(f"_place{i}"))
            rows = rows.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_value{i}"), "left").drop(f"_value{i}")
        numbers = [(F.col(f"`{c}`").cast("double") - F.lit(centre)) / F.lit(divisor)
                   for c, centre, divisor in params["numeric"]]
        places = [F.col(f"_place{i}") for i in range(len(params["categorical"]))]
        if params["encoding"] == "label":
            labels = [F.coalesce(p - first, F.lit(-1)).cast("double")
                      for p, first in zip(places, params["firsts"], strict=True)]
            features = F.array(*numbers, *labels).cast("array<double>")
        else:
            seen = F.filter(F.array(*[p + len(numbers) for p in places]).cast("array<long>"), lambda x: x.isNotNull())
            dense = F.array(*[F.lit(i) for i in range(len(numbers))]).cast("array<long>")
            features = F.struct(
                F.lit(params["size"]).cast("long").alias("size"), F.concat(dense, seen).alias("indices"),
                F.concat(F.array(*numbers).cast("array<double>"),
                         F.transform(seen, lambda x: F.lit(1.0))).alias("values"))
        return rows.withColumn(params["output"], features).drop(*[f"_place{i}" for i in range(len(places))])


def to_compact(indices: pa.ListArray, values: pa.ListArray, used: np.ndarray) -> np.ndarray:
    """Sparse rows as a matrix of the ``used`` slots, which are sorted; the others are left out."""
    if not len(indices):
        return np.zeros((0, len(used)))
    flat, numbers = indices.flatten().to_numpy(), values.flatten()
    if indices.null_count or numbers.null_count:
        raise ValueError("features must not be NULL; fill them before scoring")
    numbers = numbers.to_numpy()
    if np.isnan(numbers).any():
        raise ValueError("features must not be NaN; fill them before scoring")
    row = np.repeat(np.arange(len(indices)), indices.value_lengths().to_numpy())
    at = np.minimum(np.searchsorted(used, flat), max(len(used) - 1, 0))
    hit = used[at] == flat if len(used) else np.zeros(len(flat), bool)
    matrix = np.zeros((len(indices), len(used)))
    matrix[row[hit], at[hit]] = numbers[hit]
    return matrix


class SparseIsolationForest(IsolationForest):
    """An isolation forest on sparse features (``size``, ``indices``, ``values``).

    A tree looks at the slots its sample has; all others are zero in it and cannot be split, so the
    trees are those of the dense features. A sampled row is sent as its indices and then its values.
    """

    def _features(self, df: DataFrame):
        x = F.col(self.features)
        return F.concat(F.transform(x["indices"], lambda i: i.cast("double")), x["values"])

    @staticmethod
    def _tree(x: pd.Series, tree: int, seed: int, depth: int) -> list[tuple]:
        halves = [(row[:len(row) // 2].astype(np.int64), row[len(row) // 2:]) for row in x.to_numpy()]
        slots = np.unique(np.concatenate([i for i, _ in halves]))
        matrix = np.zeros((len(halves), len(slots)))
        for row, (i, values) in enumerate(halves):
            matrix[row, np.searchsorted(slots, i)] = values
        return [(t, node, level, f if f < 0 else int(slots[f]), *rest)
                for t, node, level, f, *rest in grow_tree(matrix, tree, seed, depth)]

    def _model(self, spark: SparkSession, nodes: pd.DataFrame, params: dict) -> IsolationForestModel:
        return SparseIsolationForestModel(spark, nodes, params)


class SparseIsolationForestModel(IsolationForestModel):
    """Scores sparse rows on the slots its nodes ask for; at most as many as there are nodes."""

    def __init__(self, spark: SparkSession, nodes: pd.DataFrame, params: dict):
        self.used = np.unique(nodes["feature"][nodes["feature"] >= 0].to_numpy(np.int64))
        super().__init__(spark, nodes, params)

    def _packed(self, nodes: pd.DataFrame) -> dict:
        asked = nodes["feature"].to_numpy()
        return pack_forest(nodes.assign(feature=np.where(asked < 0, -1, np.searchsorted(self.used, asked))))

    def score(self, df: DataFrame, output: str = "anomaly_score") -> DataFrame:
        forest, used = self._forest, self.used

        @F.arrow_udf("double")
        def mean_path(indices: pa.Array, values: pa.Array) -> pa.Array:
            return pa.array(walk(forest.value, to_compact(indices, values, used)))

        x = F.col(self.params["features"])
        norm = average_path(self.params["sample_size"])
        return df.withColumn(output, F.pow(F.lit(2.0), -mean_path(x["indices"], x["values"]) / F.lit(norm or 1.0)))
