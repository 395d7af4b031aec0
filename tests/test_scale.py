"""Tables of one large file, draws of a forest's rows, trees walked by columns."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tidewatch.operators.isolation_forest import grow_tree, halves, lowest_draws, pack_forest, walk
from tidewatch.session import spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_many_row_groups_is_not_shuffled(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    # Incompressible, so that the file is larger than a core's least share.
    noise = np.random.default_rng(1).integers(0, 1 << 62, 600_000 * cores)
    table = pa.table({"x": noise})
    pq.write_table(table, tmp_path / "many.parquet", row_group_size=20_000, use_dictionary=False)
    pq.write_table(table.slice(0, 1000), tmp_path / "one.parquet")
    many, one = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("many", "one"))
    assert "Exchange" not in _plan(spread(many))
    assert spread(many).count() == len(noise)
    assert cores == 1 or "Exchange" in _plan(spread(one))


def test_draws_are_those_of_the_digest():
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    a, b = halves(pa.array(digests).slice(7, 400))
    pairs = [(int(d[:8], 16), int(d[8:16], 16)) for d in digests[7:407]]
    assert list(zip(a.tolist(), b.tolist())) == pairs
    for limit in (1, 1 << 24, 1 << 30):
        assert lowest_draws(a, b, 100, limit).to_pylist() == [
            [t for t in range(100) if (p + t * q) % (1 << 32) < limit] for p, q in pairs]
    assert len(lowest_draws(*halves(pa.array([], pa.string())), 100, 5)) == 0


def test_walk_finds_the_leaf_of_every_tree():
    rng = np.random.default_rng(3)
    for width, psi, depth in ((4, 64, 6), (2, 5, 3), (1, 2, 1), (3, 1, 1)):
        rows = [r for t in range(5) for r in grow_tree(rng.integers(0, 9, (psi, width)).astype(float), t, 1, depth)]
        nodes = pd.DataFrame(rows, columns=["tree", "node", "depth", "feature", "threshold", "n", "path"])
        by_place = {(r[0], r[1]): r for r in rows}
        x = rng.integers(-2, 12, (200, width)).astype(float)
        x[0], x[1] = np.inf, -np.inf

        def path(tree, row):
            _, node, _, feature, threshold, _, length = by_place[tree, 1]
            while feature >= 0:
                _, node, _, feature, threshold, _, length = by_place[tree, 2 * node + int(row[feature] > threshold)]
            return length

        wanted = [sum(path(t, row) for t in range(5)) / 5 for row in x]
        assert np.allclose(walk(pack_forest(nodes), x), wanted, rtol=0, atol=1e-12)


def test_few_documents_with_many_lines_are_not_broadcast(spark):
    from tidewatch.llm.line_dedup import dedup_lines

    lines = [[f"row {d} has its own words number {d * 40 + i} here" for i in range(40)] for d in range(3)]
    docs = spark.createDataFrame([(d, "\n".join(text)) for d, text in enumerate(lines)], "doc_id long, text string")
    seen = [dedup_lines(docs, ["doc_id"], most=most, per_edit=5).orderBy("doc_id").collect() for most in (3, 100_000)]
    assert seen[0] == seen[1]


def test_line_numbers_are_bounded_by_lines(spark, monkeypatch):
    from tidewatch.llm import line_dedup
    from tidewatch.llm.common import numbered

    docs = numbered(spark.createDataFrame([(0, "\n".join(f"a b c d {i}" for i in range(50)))], "doc_id long, text string"))
    seen = line_dedup.line_table(docs)
    firsts = seen.groupBy("h1").agg(line_dedup.F.min(line_dedup._first()).alias("first"))
    marked = []
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda df: marked.append(df) or df)
    assert line_dedup._words_of(docs, firsts, 49).count() == 50 and not marked
    assert line_dedup._words_of(docs, firsts, 50).count() == 50 and marked
