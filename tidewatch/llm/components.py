"""Connected components of link tables, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b): root is the smallest node it reaches.

    Each round writes its links to the shared folder. In a large star every neighbour above a
    node is linked to the node's smallest neighbour; in a small star those below it are. Minima
    are combined before the shuffle, and the links of a node with very many of them are joined,
    which Spark splits, never gathered. Rounds grow with the logarithm of a component's breadth.
    """
    state = written(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                    .filter("lo <> hi").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = state.select(F.col("hi").alias("n"), F.col("lo").alias("v")).unionByName(
            state.select(F.col("lo").alias("n"), F.col("hi").alias("v")))
        least = both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("v > n").join(least, "n").select(
            F.least("v", "m").alias("lo"), F.greatest("v", "m").alias("hi")).filter("lo <> hi").distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select("m", "lo", "hi")
        state = written(small.select(F.col("m").alias("lo"), "hi").unionByName(
            small.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct(), "links")
        # Stars do not change any more: each node hangs on one root, and no root hangs on another.
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
