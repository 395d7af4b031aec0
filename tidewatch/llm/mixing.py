"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, rows_of, text_of, written

_STATE = ("_row long, doc_id long, source string, source_size long, target double, size long, "
          "base long, p double, leaf long, draw double, done boolean")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float,
                   most: float) -> DataFrame:
    """source, source_size, target: the words each source shall give.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times
    all words. A target stops at ``most`` times its source; the excess is shared again by weight.
    That is one water level: targets are min(cap, level * weight), and the level follows from
    the sources sorted by the level at which they reach their cap. The table has one row per
    source, so the ordering windows see sources, not documents.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    caps = sums.withColumn(
        "w", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    # With the sources before this one at their caps, the others would stand at this level.
    levels = caps.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.max(free).over(everything)
    # The first free source sets the level; later ones stand at it too.
    return levels.select("source", "source_size", F.least(
        F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _settle(pa_: float, wa: float, pb: float, wb: float, draw: float) -> tuple[float, float]:
    """Move expected words between two fractional rows until one of them is whole.

    ``pa_ * wa + pb * wb`` stays as it is, and both keep their expectation.
    """
    up, down = min((1 - pa_) * wa, pb * wb), min(pa_ * wa, (1 - pb) * wb)
    if draw * (up + down) < down:
        return (1.0 if up == (1 - pa_) * wa else pa_ + up / wa), \
            (0.0 if up == pb * wb else pb - up / wb)
    return (0.0 if down == pa_ * wa else pa_ - down / wa), \
        (1.0 if down == (1 - pb) * wb else pb + down / wb)


def _whole(p: float) -> bool:
    return p < 1e-9 or p > 1 - 1e-9


def _pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, source): all but at most one row of each group become whole.

    Holds one batch and one open row.
    """
    schema, group, kept = None, None, None
    for batch in batches:
        schema = pa.schema([pa.field(f.name, f.type) for f in batch.schema])
        out = []
        for row in batch.to_pylist():
            if (row["leaf"], row["source"]) != group:
                group = (row["leaf"], row["source"])
                if kept is not None:
                    out.append(kept)
                kept = row
                continue
            if kept is None:
                kept = row
                continue
            p, q = _settle(kept["p"], kept["size"], row["p"], row["size"], row["draw"])
            for one, value in ((kept, p), (row, q)):
                one["done"] = _whole(value)
                one["p"] = float(round(value)) if one["done"] else value
            left = [one for one in (kept, row) if not one["done"]]
            out += [one for one in (kept, row) if one["done"]]
            kept = left[0] if left else None
        yield pa.RecordBatch.from_pylist(out, schema)
    if kept is not None:
        yield pa.RecordBatch.from_pylist([kept], schema)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                most: float = 2.0, leaf_rows: int = 4096, fan_in: int = 16,
                seed: int = 7, row: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    Every document of a source wants target / source size copies: the whole part at once, the
    rest is a fractional probability. Rows of a source are dealt to leaves by a hash of their
    id. In a leaf, pairs of fractional rows exchange expected words, at random and without
    changing their sum or either's expectation, until one of them is whole; a leaf ends with one
    fractional row at most. Those residuals of ``fan_in`` leaves meet in the next round, and so
    on up a tree whose root leaves one row per source. It is rounded, and the words this gains
    or loses are set off by turning over the one row of the source whose size is nearest. So a
    hot source is spread over all leaves, and no more than a batch is ever held.

    Returns one row per input row: _row (the stored column ``row``, or as ``with_row`` numbers them), doc_id, size,
    source_size, target, copies, taken (= copies * size <= most * size). All draws are hashes of
    ids: a rerun agrees. Empty or null texts have size 0 and no copies. Null is a source of its
    own. Rows whose doc_id is null or repeated are separate rows.
    """
    if not weights or min(weights) <= 0 or share < 0 or share > most:
        raise ValueError("weights must be positive and share between 0 and most")
    sizes = written(rows_of(docs, row).select(
        "_row", F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, most)
    leaves = 1
    while leaves * leaf_rows < sizes.count():
        leaves *= fan_in
    key = F.coalesce(F.col("doc_id"), -F.col("_row") - 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Spark decides how to join: the targets are one row per source.
    rows = sizes.withColumnRenamed("source", "s").join(
        targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = (rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
            .withColumn("base", F.floor(F.col("rate") + 1e-9))
            .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
            .withColumn("leaf", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(leaves))))

    def draw(level: int):
        return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    fields = [f.split()[0] for f in _STATE.split(", ")]
    whole = F.col("p") < 1e-9
    start = rows.withColumn("done", whole).withColumn("draw", draw(0)).withColumn(
        "p", F.when(whole, 0.0).otherwise(F.col("p"))).select(*fields)
    rounds, todo, level = [], start.filter("NOT done"), 0
    while True:
        out = written(
            todo.repartition("leaf", "source").sortWithinPartitions(
                "leaf", "source", F.xxhash64(key, F.lit(seed), F.lit(level)), "doc_id", "size", "_row")
            .mapInArrow(_pivot, _STATE), f"pivot{level}")
        rounds.append(out.filter("done"))
        todo, level = out.filter("NOT done"), level + 1
        if leaves == 1:
            break
        leaves //= fan_in
        todo = todo.withColumn("leaf", F.floor(F.col("leaf") / fan_in)).withColumn("draw", draw(level))
        todo = todo.select(*fields)
    # The root: at most one fractional row per source.
    root = todo.withColumn("off", F.col("size") * (F.col("p") - F.round("p"))).withColumn("p", F.round("p"))
    drawn = rounds[0]
    for part in rounds[1:]:
        drawn = drawn.unionByName(part)
    mixed = drawn.unionByName(start.filter("done")).unionByName(root.select(*fields))
    # ``off`` words are missing (above 0) or too many: the nearest row that can turn over does.
    off = root.select(F.col("source").alias("s"), F.col("_row").alias("r"), "off")
    turns = drawn.join(off, F.col("source").eqNullSafe(F.col("s"))).filter(
        ((F.col("off") > 0) & (F.col("p") == 0)) | ((F.col("off") < 0) & (F.col("p") == 1)))
    gap = F.abs(F.abs("off") - F.col("size"))
    turned = turns.filter(gap < F.abs("off")).groupBy("s").agg(
        F.min(F.struct(gap.alias("gap"), "doc_id", "_row")).alias("best")).select(F.col("best._row").alias("t"))
    mixed = mixed.join(turned, F.col("_row") == F.col("t"), "left").withColumn(
        "copies", F.col("base") + F.when(F.col("t").isNull(), F.col("p")).otherwise(1 - F.col("p")))
    return mixed.select("_row", "doc_id", "size", "source_size", "target",
                        F.col("copies").cast("long").alias("copies"),
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))
