"""Scaling and encoding of flow features as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import column_stats, exact_quantiles
from tidewatch.schema import LABEL

SCALINGS = ("standard", "minmax", "robust")
ENCODINGS = ("onehot", "label")


def split_features(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """Features and label as two projections of the same rows."""
    return df.drop(label), df.select(label)


def numeric_columns(df: DataFrame, categorical: list[str], exclude: list[str] = ()) -> list[str]:
    """All columns that are not categorical, in their order."""
    return [c for c in df.columns if c not in categorical and c not in exclude]


def scaling_parameters(df: DataFrame, columns: list[str], method: str,
                       quantiles: Callable = exact_quantiles) -> dict[str, tuple]:
    """(centre, divisor) per column; a zero spread divides by 1."""
    if method not in SCALINGS:
        raise ValueError(f"scaling must be one of {SCALINGS}, not {method!r}")
    if not columns:
        return {}
    if method == "robust":
        quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) for c, q in quartiles.items()}
    else:
        stats = column_stats(df, columns)
        # A constant column is told by min = max: its computed deviation may be a rounding rest.
        pairs = {
            c: (s["min"], 0.0) if s["min"] == s["max"]
            else (s["mean"], s["std"]) if method == "standard"
            else (s["min"], s["max"] - s["min"])
            for c, s in stats.items()
        }
    missing = [c for c, (m, _) in pairs.items() if m is None or m != m]
    if missing:
        raise ValueError(f"no values to scale in {missing}")
    endless = [c for c, pair in pairs.items() if not all(map(math.isfinite, pair))]
    if endless:
        raise ValueError(f"infinite values leave no {method} scale in {endless}")
    return {c: (float(m), float(s) if s else 1.0) for c, (m, s) in pairs.items()}


def category_values(df: DataFrame, columns: list[str],
                    most: int | None = None) -> dict[str, list[str]]:
    """The sorted distinct values per column, NULLs ignored.

    They come to the driver, as they become the slots of the features. ``most`` makes a column of
    more values an error, before they are fetched.
    """
    if not columns:
        return {}
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    pairs = df.select(cells.alias("i", "v")).filter(F.col("v").isNotNull()).distinct()
    if most is not None:
        wide = [columns[r["i"]] for r in pairs.groupBy("i").count().filter(
            F.col("count") > most).collect()]
        if wide:
            raise ValueError(f"more than {most} distinct values to encode in {wide}")
    found = {c: [] for c in columns}
    for r in pairs.collect():
        found[columns[r["i"]]].append(r["v"])
    return {c: sorted(values) for c, values in found.items()}


class FlowPreprocessor:
    """Fits scaling and encoding; the fitted model adds one ``features`` array of doubles.

    Slots: scaled numerics in column order, then each categorical's encoding in the order given
    (sorted categories, unseen ones all zero; or one slot with the class number, unseen ones -1).
    NULL and NaN are left out of the fit. A NULL category counts as unseen; a NULL number stays
    NULL, which scoring rejects. ``max_categories`` makes a wider column an error. ``quantiles`` may
    be ``sketches.approximate_quantiles`` for robust scaling in one pass.
    """

    def __init__(self, categorical: list[str] | None = None, scaling: str = "standard",
                 encoding: str = "onehot", exclude: list[str] | None = None,
                 output: str = "features", max_categories: int | None = None,
                 quantiles: Callable = exact_quantiles):
        if scaling not in SCALINGS:
            raise ValueError(f"scaling must be one of {SCALINGS}, not {scaling!r}")
        if encoding not in ENCODINGS:
            raise ValueError(f"encoding must be one of {ENCODINGS}, not {encoding!r}")
        self.categorical = list(categorical or [])
        self.scaling, self.encoding, self.output = scaling, encoding, output
        self.exclude = [LABEL] if exclude is None else list(exclude)
        self.max_categories, self.quantiles = max_categories, quantiles

    def fit(self, df: DataFrame) -> FlowPreprocessorModel:
        numeric = numeric_columns(df, self.categorical, self.exclude)
        return FlowPreprocessorModel({
            "scaling": self.scaling, "encoding": self.encoding, "output": self.output,
            "numeric": [[c, *p] for c, p in scaling_parameters(
                df, numeric, self.scaling, self.quantiles).items()],
            "categorical": [[c, v] for c, v in category_values(
                df, self.categorical, self.max_categories).items()],
        })

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class FlowPreprocessorModel:
    """Fitted scaling and encoding: a projection, for batch and stream alike."""

    def __init__(self, params: dict):
        self.params = params

    @property
    def slots(self) -> list[str]:
        """Names of the feature slots."""
        names = [c for c, _, _ in self.params["numeric"]]
        for c, values in self.params["categorical"]:
            names += [f"{c}_{v}" for v in values] if self.params["encoding"] == "onehot" else [c]
        return names

    def _slots_of(self, name: str, values: list[str]) -> Column:
        """The slots of one category as an array: one expression, however many values there are."""
        text = F.col(f"`{name}`").cast("string")
        # The position counts from 1; it is 0 for an unseen value and NULL for NULL.
        place = F.coalesce(F.array_position(F.lit(values).cast("array<string>"), text), F.lit(0))
        if self.params["encoding"] == "label":
            return F.array((place - 1).cast("double"))
        if not values:
            return F.array().cast("array<double>")
        return F.transform(F.sequence(F.lit(1), F.lit(len(values))),
                           lambda i: (i == place).cast("double"))

    def transform(self, df: DataFrame, fill: dict | None = None) -> DataFrame:
        """The input plus the feature array; ``fill`` replaces NULLs by column first."""
        rows = df.fillna(fill) if fill else df
        numbers = F.array(*[(F.col(f"`{c}`").cast("double") - F.lit(centre)) / F.lit(divisor)
                            for c, centre, divisor in self.params["numeric"]]).cast("array<double>")
        codes = [self._slots_of(c, values) for c, values in self.params["categorical"]]
        return rows.withColumn(self.params["output"], F.concat(numbers, *codes))

    def save(self, spark: SparkSession, path: str) -> None:
        row = spark.createDataFrame([(json.dumps(self.params),)], "params string").coalesce(1)
        row.write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FlowPreprocessorModel:
        row = spark.read.schema("params string").json(path).first()
        return FlowPreprocessorModel(json.loads(row[0]))


def preprocess(train: DataFrame, test: DataFrame, categorical: list[str],
               scaling: str = "standard", encoding: str = "onehot",
               save_path: str | None = None, exclude: list[str] | None = None,
               ) -> tuple[DataFrame, DataFrame, FlowPreprocessorModel]:
    """Fit on train only, transform both, optionally save the fitted model."""
    model = FlowPreprocessor(categorical, scaling, encoding, exclude).fit(train)
    if save_path:
        model.save(train.sparkSession, save_path)
    return model.transform(train), model.transform(test), model
