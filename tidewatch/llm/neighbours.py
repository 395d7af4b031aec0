"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written


@dataclass(frozen=True)
class Router:
    """A linear classifier from vectors to cells, and how many cells a query looks at."""

    mean: np.ndarray
    scale: float
    weights: np.ndarray                 # dimension x cells
    bias: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.bias)

    def order(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` likeliest cells of each vector, likeliest first."""
        score = (vectors - self.mean) / self.scale @ self.weights + self.bias
        return np.argsort(-score, axis=1, kind="stable")[:, :most]


def vectors_of(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 1)


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences."""
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries):
        d = vectors - q
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row, block by block."""
    k = min(k, len(vectors) - 1)
    norms = (vectors ** 2).sum(axis=1)
    out = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 512):
        block = vectors[a:a + 512]
        d = norms - 2 * block @ vectors.T
        d[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        out[a:a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 40) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` (a power of two) of equal size, few links cut.

    Each part is halved in turn: the slowest mode of the walk on its links, found by power
    iteration, is split at its median.
    """
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label, rng = np.zeros(n, np.int64), np.random.default_rng(3)
    while label.max(initial=0) + 1 < parts:
        inside = label[a] == label[b]
        x, y = a[inside], b[inside]
        degree = np.bincount(x, minlength=n) + 1.0
        size = np.bincount(label, degree)
        mode = rng.standard_normal(n)
        for _ in range(rounds):
            mode -= (np.bincount(label, mode * degree) / size)[label]
            mode = 0.5 * mode + 0.5 * (np.bincount(x, mode[y], minlength=n) + mode) / degree
            mode /= np.sqrt(np.bincount(label, mode ** 2) + 1e-300)[label]
        order = np.lexsort((mode, label))
        place = np.empty(n, np.int64)
        starts = np.concatenate([[0], np.cumsum(np.bincount(label))])
        place[order] = np.arange(n) - starts[label[order]]
        label = 2 * label + (place >= (np.bincount(label)[label] + 1) // 2)
    return label


def fit_router(train: np.ndarray, check: np.ndarray, cells: int, k: int, target: float,
               degree: int = 16, epochs: int = 30) -> Router:
    """Partition ``train`` by its neighbour graph, learn the cells, set the probes on ``check``.

    ``probes`` is the least number of likeliest cells in which a share ``target`` of the k
    nearest neighbours of rows of ``check``, which was not learned from, are found.
    """
    mean = train.mean(axis=0)
    scale = float(train.std()) or 1.0
    rng = np.random.default_rng(5)
    weights, bias = np.zeros((train.shape[1], cells)), np.zeros(cells)
    if cells > 1:
        label = balanced_parts(neighbour_graph(train, degree), cells)
        x = (train - mean) / scale
        moments = [np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(weights), np.zeros_like(bias)]
        step = 0
        for epoch in range(epochs):
            rate = 0.05 * (1 - epoch / epochs)
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                logits = x[rows] @ weights + bias
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                p /= len(rows)
                step += 1
                for j, (value, grad) in enumerate(((weights, x[rows].T @ p + 1e-4 * weights), (bias, p.sum(axis=0)))):
                    m, v = moments[j], moments[j + 2]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad ** 2 - v)
                    value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    router = Router(mean, scale, weights, bias, cells)
    if cells == 1 or len(check) < 2:
        return router
    ranked = router.order(check, cells)
    rank = np.empty_like(ranked)
    np.put_along_axis(rank, ranked, np.arange(cells)[None, :], axis=1)
    near = neighbour_graph(check, k)
    asked = np.take_along_axis(rank, ranked[:, 0][near], axis=1).ravel()
    reached = np.cumsum(np.bincount(asked, minlength=cells)) / len(asked)
    return Router(mean, scale, weights, bias, min(cells, int(np.searchsorted(reached, target)) + 1))


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (array<double>), h1, h2 of the rows that take part, each (id, vector) once.

    Left out: null ids, and vectors that are null, empty, zero or hold a null or a non-finite
    component, or have another length than most (of equally many the longer).
    """
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(
        F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (length["d"] if length else 0))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("v"), "v")})


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding", sample: int = 8192, most_cells: int = 512,
            target: float = 0.97, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Equal vectors are one class, known by its ``k + 1`` smallest ids: no other id of a class can
    be among a query's nearest, so nothing is lost and copies are compared once. Two samples of
    at most ``sample`` classes each, by hash, are fitted on: the neighbour graph of the one is cut
    into balanced cells and a linear classifier learns them; the other sets the number of cells a
    query looks at, so that ``target`` of the neighbours are reached. All classes are indexed, in
    their likeliest cell; cells number about half the root of the classes (to ``most_cells``). A
    cell is cut into blocks of about ``block`` classes and its queries into blocks too, so the
    distances of a hot cell are many tasks. Each gives its k + 1 nearest, which are merged.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in doubles), nearest
    first, ties to the smaller id; a row never finds its own id. Rows of one id with equal vectors
    count once; with other vectors each is a query of its own with its own list, and a candidate of
    its own, so an id may stand twice in a list. Empty table: no rows.
    """
    rows = written(usable(embeddings, id_column, vector_column), "vectors")
    few = Window.partitionBy("h1", "h2").orderBy("vec_id")
    classes = written(
        rows.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v"))
        .withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "classes")
    queries = rows.filter(F.col("vec_id") % every == 0).select("h1", "h2", F.col("vec_id").alias("query_id"))
    n = classes.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return embeddings.sparkSession.createDataFrame([], empty)
    cells = 1
    while cells * 2 <= min(most_cells, np.sqrt(n) / 2, sample / 8):
        cells *= 2
    # The smallest hashes: a rerun draws the same. The filter leaves few more than are taken.
    share = min(1.0, 2.5 * sample / n)
    draw = F.pmod(F.xxhash64("h2", "h1"), F.lit(1 << 30)) / float(1 << 30)
    drawn = classes.filter(draw < share).select("h1", "h2", "v", draw.alias("draw")).orderBy("draw", "h1", "h2").limit(
        2 * sample).toArrow()
    taken = vectors_of(drawn.column("v"))
    router = fit_router(taken[::2], taken[1::2], cells, k, target)
    sent = embeddings.sparkSession.sparkContext.broadcast(router)

    def route(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = sent.value.order(vectors_of(batch.column("v")), most)
                cell = pa.ListArray.from_arrays(np.arange(0, order.size + 1, most, np.int32), order.ravel().astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cells"])
        return run

    fields = classes.schema.simpleString()[7:-1]
    index = written(classes.mapInArrow(route(1), fields + ",cells:array<bigint>").withColumn(
        "cell", F.element_at("cells", 1)).drop("cells"), "cells")
    asked = written(
        classes.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        .mapInArrow(route(router.probes), fields + ",cells:array<bigint>")
        .select("h1", "h2", "v", F.explode("cells").alias("cell")), "asked")
    # At most ``most_cells`` rows each; beyond one block a cell is cut.
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    loads = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_block).alias("loads"))
    plan = sizes.join(loads, "cell")
    mark = F.xxhash64("h2", F.lit("block"), "h1")
    left = index.join(F.broadcast(plan), "cell").select(
        "cell", F.pmod(mark, F.col("blocks")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)).alias("q"), "ids", "v")
    right = asked.join(F.broadcast(plan), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), F.pmod(mark, F.col("loads")).alias("q"), "h1", "h2", "v")

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = {"h1": [], "h2": [], "vec_id": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            vectors, asks = vectors_of(mine.column("v")), vectors_of(theirs.column("v"))
            ids = mine.column("ids").to_pylist()
            h1, h2 = theirs.column("h1").to_pylist(), theirs.column("h2").to_pylist()
            for i, q in enumerate(asks):
                d = distances(q[None], vectors)[0]
                near = np.arange(len(d))
                if len(d) > k + 1:           # every class as near as the (k + 1)-th
                    near = np.flatnonzero(d <= np.partition(d, k)[k])
                best = sorted((float(d[j]), x) for j in near for x in ids[j])[:k + 1]
                out["h1"] += [h1[i]] * len(best)
                out["h2"] += [h2[i]] * len(best)
                out["vec_id"] += [x for _, x in best]
                out["score"] += [s for s, _ in best]
        return pa.table(out, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = left.groupBy("cell", "b", "q").cogroup(right.groupBy("cell", "b", "q")).applyInArrow(
        compare, "h1 long, h2 long, vec_id long, score double")
    by_class = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
    best = found.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= k + 1).groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.distinct().join(best, ["h1", "h2"]).select(
        "query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
