"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours' neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, written
from tidewatch.llm.components import components
from tidewatch.llm.neighbours import vectors_of

_CODE_BITS = 62
_CANDIDATES = "u long, w long, p double"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def priority(u: np.ndarray, w: np.ndarray, cosine: np.ndarray, near: float) -> np.ndarray:
    """The cosine; for near pairs 2 and a number below 1 that only the pair decides.

    So a list that near neighbours fill holds a random choice of them, and the links of a dense
    group hang together instead of falling into tight circles.
    """
    lo, hi = np.minimum(u, w).astype(np.uint64), np.maximum(u, w).astype(np.uint64)
    drawn = _mixed(_mixed(lo) + hi) >> np.uint64(11)
    return np.where(cosine >= near, 2 + drawn.astype(np.float64) / (1 << 53), cosine.astype(np.float64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, also where squares would overflow or vanish."""
    if not len(vectors):
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _with_classes(embeddings: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_row, vec_id, h1, h2; null hashes: takes no part) and classes (node, copies, v).

    A class is all rows of one vector, known by its first row.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = numbered(embeddings.select(F.col(id_column).cast("long").alias("vec_id"),
                                      F.col(vector_column).cast("array<double>").alias("v")))
    fit = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    length = fit.filter("fine").groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    takes = F.col("fine") & (F.size(v) == (length["d"] if length else 0))
    rows = written(fit.select("_row", "vec_id", "v", F.when(takes, F.xxhash64("v")).alias("h1"),
                              F.when(takes, F.xxhash64(F.lit("v"), "v")).alias("h2")), "rows")
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("_row").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.drop("v"), written(classes, "classes")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in single precision, enough to look for neighbours with."""
    for batch in batches:
        if batch.num_rows:
            u = unit(vectors_of(batch.column("v"))).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, u.shape[1]), pa.int32()), u.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "x"])


def _seeded(nodes: DataFrame, near: float, seed: int, reach: int) -> DataFrame:
    """First candidates: each node and the next ``reach`` in the order of its random signs.

    Signs of random projections, read as one number, put vectors that agree in many of the first
    signs side by side. The order is cut into tasks by ranges, never by equal signs.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column("x"), np.float32)
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], _CODE_BITS)).astype(np.float32)
                codes = (x @ planes > 0) @ (1 << np.arange(_CODE_BITS, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["node", "x", "code"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column("node").to_numpy(), vectors_of(batch.column("x"), np.float32)
            known = len(ids)
            ids, x = np.concatenate([ids, own]), x if last is None else np.concatenate([last, x])
            u, w, s = [], [], []
            for step in range(1, reach + 1):
                at = np.arange(max(0, known - step), len(ids) - step)
                u.append(ids[at])
                w.append(ids[at + step])
                s.append(np.einsum("ij,ij->i", x[at], x[at + step]))
            u, w, s = (np.concatenate(part) for part in (u, w, s))
            p = priority(u, w, s, near)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, w])), pa.array(np.concatenate([w, u])),
                                              pa.array(np.concatenate([p, p]))], names=["u", "w", "p"])
            ids, last = ids[-reach:], x[-reach:]

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.mapInArrow(code, "node long, x array<float>, code long").repartitionByRange(
        tasks, "code", "node").sortWithinPartitions("code", "node").mapInArrow(pair, _CANDIDATES)


def _merged(lists: DataFrame | None, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best neighbours of every node: u, w, p, fresh (not in ``lists``), worst."""
    found = candidates.withColumn("fresh", F.lit(True))
    if lists is not None:
        found = found.unionByName(lists.select("u", "w", "p", F.lit(False).alias("fresh")))
    by_node = Window.partitionBy("u").orderBy(F.desc("p"), "w")
    best = found.repartition("u").groupBy("u", "w").agg(F.max("p").alias("p"), F.min("fresh").alias("fresh")).withColumn(
        "r", F.row_number().over(by_node)).filter(F.col("r") <= k)
    # A list that is not full takes whatever comes.
    worst = F.min(F.when(F.col("r") == k, F.col("p"))).over(Window.partitionBy("u"))
    return written(best.withColumn("worst", F.coalesce(worst, F.lit(-2.0))).drop("r"), "lists")


def _neighbours_of_neighbours(nodes: DataFrame, lists: DataFrame, near: float, k: int) -> DataFrame:
    """Candidates: all pairs in the list of a node and in lists it is in, one of them fresh.

    A node that very many lists hold takes the ``k`` freshest and nearest of them, so no group has
    more than 2 k members; the other pairs meet at their other neighbours.
    """
    by_node = Window.partitionBy("v").orderBy(F.desc("fresh"), F.desc("p"), "u")
    back = lists.select(F.col("w").alias("v"), "u", "p", "fresh").withColumn("r", F.row_number().over(by_node)).filter(
        F.col("r") <= k).drop("r")
    around = lists.select(F.col("u").alias("v"), F.col("w").alias("u"), "p", "fresh").unionByName(back).groupBy("v", "u").agg(
        F.max("fresh").alias("fresh"))
    around = around.withColumn("some", F.max("fresh").over(Window.partitionBy("v"))).filter("some").drop("some")
    worst = lists.groupBy("u").agg(F.first("worst").alias("worst"))
    members = around.join(nodes.select(F.col("node").alias("u"), "x"), "u").join(worst, "u").select("v", "u", "fresh", "worst", "x")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            v = held.column("v").to_numpy()
            if len(v) and v[0] != v[-1]:
                cut = int(np.searchsorted(v, v[-1]))
                yield from pairs(held.slice(0, cut), v[:cut])
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held, held.column("v").to_numpy())

    def pairs(table: pa.Table, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, fresh = table.column("u").to_numpy(), table.column("fresh").to_numpy()
        worst, x = table.column("worst").to_numpy(), vectors_of(table.column("x"), np.float32)
        bounds = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
        left, right, cosine = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                i, j = np.nonzero(fresh[a:b, None] | fresh[None, a:b])
                left.append(i + a)
                right.append(j + a)
                cosine.append((x[a:b] @ x[a:b].T)[i, j])
        if left:
            left, right, cosine = (np.concatenate(part) for part in (left, right, cosine))
            p = priority(u[left], u[right], cosine, near)
            good = (left != right) & (p > worst[left])
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[left[good]]), pa.array(u[right[good]]), pa.array(p[good])], names=["u", "w", "p"])

    return members.repartition("v").sortWithinPartitions("v").mapInArrow(join, _CANDIDATES)


def _descend(nodes: DataFrame, lists: DataFrame | None, near: float, k: int, seeds: range, reach: int, rounds: int,
             settled: float) -> DataFrame:
    """Neighbour lists: random orders first, then rounds until few entries change."""
    found = None
    for seed in seeds:
        more = _seeded(nodes, near, seed, reach)
        found = more if found is None else found.unionByName(more)
    lists = _merged(lists, found, k)
    size = lists.count()
    for _ in range(rounds):
        lists = _merged(lists, _neighbours_of_neighbours(nodes, lists, near, k), k)
        if lists.filter("fresh").count() <= settled * size:
            break
    return lists


def _verified(classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose cosine in double precision is ``least`` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", unit(vectors_of(batch.column("va"))), unit(vectors_of(batch.column("vb"))))
                yield batch.select(["a", "b"]).filter(pa.array(s >= least))

    of = classes.select("node", "v")
    return pairs.join(of.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(
        of.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb").mapInArrow(
        check, "a long, b long")


def _counted_whole(classes: DataFrame, members: DataFrame, least: float, chunk: int) -> DataFrame:
    """node, links of all ``members`` (node, root), each compared with all of its component.

    A component is cut into chunks and every two of them are a task, which gives one sum for each
    of its nodes: pairs are never rows.
    """
    sized = members.groupBy("root").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    rows = members.join(sized, "root").join(classes.select("node", "copies", "v"), "node").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "copies", "v")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        part, node, copies = (table.column(c).to_numpy() for c in ("part", "node", "copies"))
        x = unit(vectors_of(table.column("v")))
        first = part == part.min()
        links = np.zeros(len(node), np.int64)
        one, two = np.flatnonzero(first), np.flatnonzero(first if first.all() else ~first)
        for k in range(0, len(one), 1024):
            rows = one[k:k + 1024]
            hit = x[rows] @ x[two].T >= least
            if first.all():
                hit[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
            links[rows] += hit @ copies[two]
            if not first.all():
                links[two] += copies[rows] @ hit
        return pa.table([pa.array(node), pa.array(links)], schema=schema)

    # A chunk paired with itself holds one part, with another both.
    return dealt.groupBy("root", "lo", "hi").applyInArrow(count, "node long, links long").groupBy("node").agg(
        F.sum("links").alias("links"))


def _links(classes: DataFrame, lists: DataFrame, least: float, near: float, k: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked nodes, and (node, links): rows of other vectors linked to a node."""
    pairs = lists.filter("p >= 2").select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b")).distinct()
    edges = written(_verified(classes, pairs, least), "edges")
    roots = written(components(edges), "roots")
    # A list full of near neighbours may lack some: those of its component are all compared.
    full = lists.filter("p >= 2").groupBy("u").count().filter(F.col("count") >= k).select(F.col("u").alias("node"))
    dense = written(roots.join(full, "node").select("root").distinct(), "dense")
    whole = _counted_whole(classes, roots.join(dense, "root", "left_semi"), least, chunk)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    listed = both.join(roots.join(dense, "root", "left_anti"), "node").join(
        classes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("links"))
    return roots, written(whole.unionByName(listed), "links")


def audit(classes: DataFrame, links: DataFrame, least: float, sample: int) -> tuple[int, int]:
    """(links found, links there are) of ``sample`` nodes, drawn by hash and compared with all nodes."""
    drawn = classes.select("node", "v", F.xxhash64("node", F.lit("audit")).alias("h")).orderBy("h", "node").limit(sample)
    table = drawn.toArrow()
    if not table.num_rows:
        return 0, 0
    asked = classes.sparkSession.sparkContext.broadcast((table.column("node").to_numpy(), unit(vectors_of(table.column("v")))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, x = asked.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column("node").to_numpy()
                hit = (unit(vectors_of(batch.column("v"))) @ x.T >= least) & (own[:, None] != nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(batch.column("copies").to_numpy() @ hit)], names=["node", "links"])

    there = classes.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("there"))
    found = there.join(links, "node", "left").agg(F.sum(F.coalesce("links", F.lit(0))), F.sum("there")).first()
    return found[0] or 0, found[1] or 0


def near_vectors(embeddings: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding",
                 k: int = 8, reach: int = 4, orders: int = 3, rounds: int = 6, settled: float = 0.01, sample: int = 512,
                 target: float = 0.98, tries: int = 3, chunk: int = 2048) -> DataFrame:
    """Components of vectors whose cosine is ``least`` or more, found by NN-descent.

    Equal vectors are one class. Lists of the ``k`` best neighbours start from ``orders`` random
    orders and are refined by joining the neighbours of each node with one another, until a round
    changes less than a share ``settled`` of the entries. Neighbours that are near enough are
    verified in double precision and linked. A list full of such links is saturated: it is enlarged
    to all of its component, by exact comparison chunk by chunk that counts and emits no pairs
    (work grows with the square of such a component, rows with its square / ``chunk``). A bounded
    ``sample`` of classes is compared with all classes; while fewer than ``target`` of its links
    are found, lists are doubled and refined from further orders, at most ``tries`` times in all.

    One row per input row: vec_id, n_links (other rows linked directly, equal vectors included),
    component_id (smallest vec_id reachable, itself included), kept (vec_id = component_id; a
    component without ids: true). Vectors that are null, empty, zero, hold a null or a non-finite
    component or have another length than most (of equally many the longer) link with nothing.
    Rows with equal ids are rows of their own; other columns are not read; empty table: no rows.
    """
    rows, classes = _with_classes(embeddings, id_column, vector_column)
    nodes = written(classes.mapInArrow(_units, "node long, x array<float>"), "units")
    near = least - 1e-5                 # single precision is off by less
    lists, size = None, k
    for turn in range(tries):
        seeds = range(1 + turn * orders, 1 + (turn + 1) * orders)
        lists = _descend(nodes, lists, near, size, seeds, reach, rounds, settled)
        roots, links = _links(classes, lists, least, near, size, chunk)
        found, there = audit(classes, links, least, sample)
        if found >= target * there:
            break
        size *= 2
    known = classes.select("h1", "h2", "node", "copies").join(roots, "node", "left").join(links, "node", "left").select(
        "h1", "h2", F.coalesce("root", "node").alias("root"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = rows.join(known, ["h1", "h2"], "left")
    first = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("first"))
    apart = F.col("root").isNull()
    component = F.when(apart, F.col("vec_id")).otherwise(F.col("first"))
    return named.join(first, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
