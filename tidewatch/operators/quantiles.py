"""Exact interpolated quantiles of columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import drop_path, scratch_path

BINS = 1024
# An interval of at most this many rows is read value by value.
FEW = 2_000


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """count, mean, population deviation, minimum and maximum per column, NULL and NaN ignored.

    Columns become rows before the aggregate: a few functions over one column compile well where
    several for each of many columns do not, and the map side reduces to one row per column.
    """
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    rows = df.select(cells.alias("i", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("i").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max")).collect()
    found = {r["i"]: r.asDict() for r in rows}
    none = {"n": 0, "mean": None, "std": None, "min": None, "max": None}
    return {c: found.get(i, none) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    bins: int = BINS) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column, NULL and NaN ignored; NaN without a value.

    Infinities are the ends of the order: they are counted and never binned. The finite values
    are narrowed: a histogram per wanted rank finds the bin that holds it, and the bin becomes
    the next interval until one value is left. Every pass is a map-side combined aggregate of at
    most ``2 * len(columns) * len(probs) * bins`` groups. The columns are written once, so passes
    do not repeat what comes before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "quantiles")
    df.select([F.col(f"`{c}`").cast("double").alias(f"c{i}")
               for i, c in enumerate(columns)]).write.parquet(path)
    doubles = spark.read.parquet(path)
    names = doubles.columns
    ends = _ends(doubles, names)

    wanted = {}  # (column, rank) -> value, filled by narrowing
    intervals: dict[tuple, list[int]] = {}
    # interval -> ranks inside it; an interval is (column, low, high, rows below it, rows in it)
    for c in names:
        below, finite, above, low, high = ends[c]
        for p in probs if below + finite + above else []:
            position = (below + finite + above - 1) * p
            for rank in {math.floor(position), math.ceil(position)}:
                if rank < below or rank >= below + finite:
                    wanted[c, rank] = -math.inf if rank < below else math.inf
                elif (c, rank) not in wanted:
                    wanted[c, rank] = None
                    intervals.setdefault((c, low, high, below, finite), []).append(rank)
    while intervals:
        narrowed = _narrow(doubles, intervals, wanted, bins)
        stuck = [key for key in narrowed if key in intervals]
        if stuck:
            raise ArithmeticError(f"the interval {stuck[0]} does not get smaller")
        intervals = narrowed
    drop_path(spark, path)

    result = {}
    for col, c in zip(columns, names):
        values, n = [], sum(ends[c][:3])
        for p in probs:
            position = (n - 1) * p
            part = position - math.floor(position)
            low, high = (wanted.get((c, f(position)), math.nan) for f in (math.floor, math.ceil))
            values.append(low if low == high or not part else low * (1 - part) + high * part)
        result[col] = values
    return result


def _ends(doubles: DataFrame, names: list[str]) -> dict[str, tuple]:
    """Per column how many are -inf, finite and +inf, and the finite minimum and maximum."""
    cells = F.posexplode(F.array(*[F.col(c) for c in names]))
    x = F.col("x")
    finite = F.abs(x) < F.lit(math.inf)
    rows = doubles.select(cells.alias("i", "x")).filter(x.isNotNull() & ~F.isnan(x)).groupBy("i").agg(
        F.count_if(x == -math.inf).alias("below"), F.count_if(finite).alias("finite"),
        F.count_if(x == math.inf).alias("above"), F.min(F.when(finite, x)).alias("low"),
        F.max(F.when(finite, x)).alias("high")).collect()
    found = {r["i"]: tuple(r)[1:] for r in rows}
    return {c: found.get(i, (0, 0, 0, None, None)) for i, c in enumerate(names)}


def _narrow(doubles: DataFrame, intervals: dict, wanted: dict, bins: int) -> dict:
    """One pass: resolve intervals of a single value, shrink the others to one bin or value."""
    open_intervals = {}
    for key, ranks in intervals.items():
        c, low, high, _, _ = key
        if low == high:
            for rank in ranks:
                wanted[c, rank] = low
        else:
            open_intervals[key] = ranks
    if not open_intervals:
        return {}
    cells = []
    keys = list(open_intervals)
    for i, (c, low, high, _, n) in enumerate(keys):
        # Halves keep the width finite for intervals as wide as the double range.
        wide = math.isinf(high - low)
        step = ((F.col(c) / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) if wide
                else (F.col(c) - F.lit(low)) / F.lit(high - low))
        cell = F.least(F.floor(step * bins), F.lit(bins - 1)).cast("int")
        few = n <= FEW
        cells.append(F.when(F.col(c).between(low, high), F.struct(
            F.lit(i).alias("i"), (F.lit(0) if few else cell).alias("b"),
            (F.col(c) if few else F.lit(None).cast("double")).alias("v"), F.col(c).alias("x"))))
    rows = (
        doubles.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
        .groupBy("s.i", "s.b", "s.v")
        .agg(F.count(F.lit(1)).alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi"))
        .collect()
    )
    by_interval: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["i"], r["lo"])):
        by_interval.setdefault(row["i"], []).append(row)
    narrowed: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        c, _, _, below, _ = key
        for row in by_interval.get(i, []):
            inside = [r for r in open_intervals[key] if below <= r < below + row["n"]]
            if inside:
                narrowed.setdefault((c, row["lo"], row["hi"], below, row["n"]), []).extend(inside)
            below += row["n"]
    return narrowed
