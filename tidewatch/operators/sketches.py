"""Approximate quantiles by mergeable sketches: one pass, and days can be put together later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """How far a quantile's rank may be off, as a share of the rows, with 99 percent confidence."""
    return 2.296 / k ** 0.9723          # fixed values of the KLL sketch


def _value(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def sketch_columns(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = 200) -> DataFrame:
    """A KLL sketch per column, or per group of ``by``, as binary columns of the same names.

    Sketches are built in each task and merged by Spark, a few kilobytes each whatever the rows.
    NULL and NaN are left out; a column without values has a sketch of no rows. Store the table
    and put groups together with ``merge_sketches``.
    """
    sketches = [F.kll_sketch_agg_double(_value(c), F.lit(k)).alias(c) for c in columns]
    return df.groupBy(*(by or [])).agg(*sketches)


def merge_sketches(sketches: DataFrame, columns: list[str], by: list[str] | None = None, k: int = 200) -> DataFrame:
    """Stored sketches put together, all or per group of ``by``."""
    return sketches.groupBy(*(by or [])).agg(*[F.kll_merge_agg_double(F.col(f"`{c}`"), F.lit(k)).alias(c) for c in columns])


def sketched_quantiles(sketches: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Quantiles per column of a table of one row of sketches; NaN for a column without values."""
    ranks = F.lit(list(probs)).cast("array<double>")
    row = sketches.select(*[F.when(F.kll_sketch_get_n_double(F.col(f"`{c}`")) > 0, F.kll_sketch_get_quantile_double(
        F.col(f"`{c}`"), ranks)).alias(c) for c in columns]).first()
    return {c: [float("nan")] * len(probs) if row[c] is None else list(row[c]) for c in columns}


def approximate_quantiles(df: DataFrame, columns: list[str], probs: list[float], k: int = 200) -> dict[str, list[float]]:
    """As ``exact_quantiles``, in one pass, off by ``rank_error(k)`` of the rows at most (see there).

    To be asked for: ``FlowPreprocessor(quantiles=approximate_quantiles)``, and so for a forest.
    """
    return sketched_quantiles(sketch_columns(df, columns, k=k), columns, probs)
