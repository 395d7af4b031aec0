"""What the training-data operators share: row keys, word rules, written intermediates."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidewatch
from tidewatch.session import CLEANUP, drop_path, scratch_path, shuffles_removed  # noqa: F401

_SHIPPED: set[str] = set()
#: Paths written by the operators that run within ``alone``, innermost last.
_WRITTEN: list[list[str]] = []
#: How they are compressed: some hold all texts.
CODEC = "zstd"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z in lower case and every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number per row, so that repeated ids stay apart.

    The number follows from the partition and the place in it: ``docs`` has to be a table scan
    or another plan that gives the same partitions each time it is run.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    So the shuffles of the writing are read by nothing else, and their files go with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if _WRITTEN:
        _WRITTEN[-1].append(path)
        writer = writer.option("compression", CODEC)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` describes, written; all that was written on the way to it is dropped."""
    _WRITTEN.append([])
    try:
        out = written(make(), name)
    finally:
        before = _WRITTEN.pop()
    for path in before[:-1]:
        drop_path(out.sparkSession, path)
    return out


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` written once with a number per row: jobs that read it see the same numbers.

    A scan is cut by the cores there are when it is planned, so numbers given anew in each job
    may differ if an executor comes or goes between them.
    """
    return written(with_row(docs, name), "rows")


def rows_of(docs: DataFrame, row: str | None) -> DataFrame:
    """``docs`` with its stored column ``row`` as _row, or with numbers of this scan."""
    return with_row(docs) if row is None else docs.withColumn("_row", F.col(row))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for a broadcast if it has no more than ``rows`` rows; else Spark decides.

    It is counted, so it should be a written table.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session.

    Functions that run there are found by their module; a cluster that has the package installed
    or was given it by ``--py-files`` does without.
    """
    context, root = spark.sparkContext, Path(tidewatch.__file__).parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-code-"), "tidewatch_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
