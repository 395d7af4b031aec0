"""Exact dedup by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, text_of, with_row, written


def exact_dedup(docs: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """Groups of equal texts and the one row of each that stays.

    Every input partition belongs to one of ``runs`` runs. A run holds one entry per distinct
    SHA-256 of the normalised text (A to Z lower-cased, null as empty), with the largest
    identifier and the number of rows. In each round ``fan_in`` runs are merged into one; the
    whole digest is compared at every level and the identifier to keep is carried on. A merge is
    spread over the digests, so neither a run nor a group of copies is ever one task. The winners
    go back along the first runs: a group that holds a third of all rows meets its winner in
    ``runs`` places rather than in one.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Rows of one
    group that share the largest doc_id: exactly one is kept. A null doc_id counts as the
    smallest. Empty table: no rows. Other columns of ``docs`` are not looked at.
    """
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    digests = written(
        with_row(docs).select(
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), "_row", "doc_id",
            F.unhex(F.sha2(ascii_lower(text_of()), 256)).alias("sha")), "digests")
    first = digests.groupBy("run", "sha").agg(
        F.max(F.struct("doc_id", "_row")).alias("keep"), F.count("*").alias("n"))
    merged, left = first, runs
    while left > 1:
        merged = merged.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "sha").agg(
            F.max("keep").alias("keep"), F.sum("n").alias("n"))
        left = -(-left // fan_in)
    winners = merged.select("sha", "keep", "n")
    back = first.select("run", "sha").join(winners, "sha")
    return digests.join(back, ["run", "sha"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("_row") == F.col("keep._row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
