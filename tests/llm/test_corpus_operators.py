"""Mixing, token files, search and packing beside plain versions and round trips."""

import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import HARD, WORD, documents, prose, stored
from pyspark.sql import functions as F

import public_tokenizers
from tidewatch.llm.mixing import _pivot, _settle, mix_sources, source_targets
from tidewatch.llm.neighbours import balanced_parts, nearest, neighbour_graph
from tidewatch.llm.packing import Shard, Statistics, pack_documents
from tidewatch.llm.token_files import Index, _pack_index, build_hash, find_slots, read_token_files, write_token_files
from tidewatch.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def plain_ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


# -- mixing ------------------------------------------------------------------------------------

def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: most * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 50}, {"z": 7, "é": 90, "Z": 4000, "b": 0, None: 1},
    {f"s{i}": (i * 37) % 211 for i in range(20)}, {"one": 12}, {"a": 0, "b": 0}])
def test_targets_beside_the_resharing_loop(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def mix(spark, rows, path, clash=False, **settings):
    docs = stored(spark, documents(spark, rows, clash), path)
    return mix_sources(docs, **settings).collect()


def test_mix_comes_near_its_targets(spark, tmp_path):
    rows = [(i, prose(i, 1 + (i * 7919) % 90), None, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    got = mix(spark, rows, tmp_path / "a", leaf_rows=16, fan_in=4)
    again = mix(spark, rows[::-1], tmp_path / "b", leaf_rows=16, fan_in=4)
    plain = lambda found: sorted((r.doc_id, r.size, r.target, r.taken) for r in found)
    assert plain(got) == plain(again) and len(got) == len(rows)          # whatever the partitions are
    source = {r[0]: r[3] for r in rows}
    taken, target = {}, {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken == r.copies * r.size <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    other = mix(spark, rows, tmp_path / "c", seed=8)
    assert plain(other) != plain(got)


@pytest.mark.parametrize("clash", [False, True])
def test_mix_of_hard_rows(spark, tmp_path, clash):
    got = mix(spark, HARD, tmp_path / "d", clash)
    assert len(got) == len(HARD)
    want = sorted((-10**9 if d is None else d, len(WORD.findall(t or ""))) for d, t, *_ in HARD)
    assert sorted((-10**9 if r.doc_id is None else r.doc_id, r.size) for r in got) == want
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mix_sources(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mix_sources(documents(spark, []), share=3.0)


def test_a_step_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p, q, w, v = *rng.uniform(0.01, 0.99, 2), *rng.integers(1, 500, 2)
        draws = [_settle(p, w, q, v, d) for d in np.linspace(0.0005, 0.9995, 1000)]
        for a, b in (draws[0], draws[-1]):
            assert abs(a * w + b * v - p * w - q * v) < 1e-6
            assert min(a, 1 - a, b, 1 - b) < 1e-9 and -1e-9 < min(a, b) and max(a, b) < 1 + 1e-9
        assert abs(np.mean([a for a, _ in draws]) - p) < 2e-3


def test_a_group_ends_with_one_open_row_over_batches():
    rng = np.random.default_rng(3)
    rows = [{"_row": i, "doc_id": i, "source": "ab"[i % 50 > 20], "source_size": 1, "target": 1.0, "size": int(rng.integers(1, 40)),
             "base": 0, "p": float(rng.uniform(0.05, 0.95)), "leaf": i // 50, "draw": float(rng.random()), "done": False} for i in range(150)]
    batches = [pa.RecordBatch.from_pylist(rows[i:i + 13]) for i in range(0, 150, 13)]
    out = [r for b in _pivot(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["_row"] for r in out) == list(range(150))
    groups = {}
    for r in out:
        groups.setdefault((r["leaf"], r["source"]), []).append(r)
    for members in groups.values():
        before = sum(rows[r["_row"]]["p"] * r["size"] for r in members)
        assert sum(not r["done"] for r in members) <= 1
        assert abs(sum(r["p"] * r["size"] for r in members) - before) < 1e-5


# -- tokens ------------------------------------------------------------------------------------

ODD = ["", "Don't STOP!!, it's 3.14, ok.", "<|endoftext|> a <|ENDOFTEXT|>b<|startoftext|>", "ΟΔΥΣΣΕΥΣ Σ. ς", "İstanbul, ẞ. ﬁn",
       "été, é. ̈́ Å ẛ̣.", "a b c　d  e\u0085f\x1cg", "tab\tnew\nline\r\n\x0b\x0c end",
       "日本語、です。 混ぜる.", "a.,b ., ,. ...", "​﻿ x.́ , ý,", "Ǆ ǅ. ª º, ²³. Ⅷ, ½.", "\U0001f600. 𝔘𝔫, 𞤀."]


def test_ids_are_the_tokenizers_own(tokenizer):
    texts = [*ODD, *(t or "" for _, t, *_ in HARD), " ".join(ODD), *ODD]
    for most in (300_000, 5):
        enc = Encoder(TOKENIZER, most=most)
        for _ in range(2):
            got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_a_tokenizer_that_keeps_spaces():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), Encoder(path)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(ODD)] == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        slots = find_slots(build_hash(keys), keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        build_hash(np.array([5, 5], np.uint64))


@pytest.mark.parametrize("n", [1, 5, 223, 5000])
def test_index_reads_a_few_places_of_its_file(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64)).astype(np.uint64)
    columns = [rng.integers(0, 1 << 31, len(keys)) for _ in range(4)]
    raw, reads = _pack_index(keys, *columns), []
    index = Index(lambda at, length: reads.append(length) or raw[at:at + length])
    slots = index.slots(keys)
    assert sorted(slots) == list(range(len(keys))) and (slots == find_slots(build_hash(keys), keys)).all()
    found = index.entries(slots)
    assert all((found[c] == column).all() for c, column in zip(("mark", "shard", "at", "n"), columns, strict=True))
    assert sum(reads) < 200 + 8 * 64 + 160 * len(keys)
    reads.clear()
    for key in keys[:50]:
        index.entries(index.slots(np.array([key])))
    assert len(reads) <= 4 * min(50, len(keys)) + 8 and max(reads) == 32       # whatever the size
    assert len(index.slots(np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize("clash", [False, True])
def test_token_files_round_trip(spark, tmp_path, tokenizer, clash):
    docs = stored(spark, documents(spark, [*HARD, *((100 + i, t) for i, t in enumerate(ODD))], clash), tmp_path / "d")
    rows = sorted(((d, t) for d, t, *_ in [*HARD, *((100 + i, t) for i, t in enumerate(ODD))]), key=lambda r: (r[0] is not None, r[0] or 0))
    path = str(tmp_path / "files")
    assert write_token_files(docs, path, TOKENIZER, 2, shard_ids=500, index_keys=4) == len(rows)
    keys = spark.createDataFrame([(d, sum(x[0] == d for x in rows[:i])) for i, (d, _) in enumerate(rows)] + [(12345, 0), (7, 3)],
                                 "doc_id long, copy long")
    got = sorted(read_token_files(spark, path, keys).collect(), key=lambda r: r.start)
    assert got == sorted(read_token_files(spark, path, keys, once=1).collect(), key=lambda r: r.start)
    at = 0
    assert len(got) == len(rows)                       # strangers give no row
    for r, (doc, text) in zip(got, rows):
        ids = plain_ids(tokenizer, text, 2)
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("ids-*.bin")))
    assert np.frombuffer(raw, "<u2").tolist() == [i for _, t in rows for i in plain_ids(tokenizer, t, 2)]


def test_token_files_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(7, f"text {i} of one id") for i in range(60)] + [(None, f"no id {i}") for i in range(60)]
    files = []
    for i, some in enumerate((rows, rows[::-1])):
        path = tmp_path / f"f{i}"
        write_token_files(stored(spark, documents(spark, some, partitions=1 + 4 * i), tmp_path / f"d{i}"), str(path), TOKENIZER, 2)
        files.append(b"".join(p.read_bytes() for p in sorted(path.glob("ids-*.bin"))))
    assert files[0] == files[1]


def test_token_files_of_no_documents(spark, tmp_path):
    assert write_token_files(documents(spark, []), str(tmp_path / "f"), TOKENIZER, 2) == 0
    assert read_token_files(spark, str(tmp_path / "f"), spark.createDataFrame([(1, 0)], "doc_id long, copy long")).count() == 0


# -- packing -----------------------------------------------------------------------------------

def check_packing(spark, tokenizer, rows, docs, window=2048, **settings):
    pieces = pack_documents(docs, TOKENIZER, 1, window=window, **settings).collect()
    by_row, by_sequence = {}, {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_row.setdefault((r["_row"], r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    got = []
    for (_, doc), parts in by_row.items():
        parts.sort(key=lambda r: r.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        ids = [i for p in parts for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert {p.doc_tokens for p in parts} == {len(ids)}
        got.append((doc, ids))
    assert sorted(got, key=str) == sorted(((d, plain_ids(tokenizer, t, 1)) for d, t, *_ in rows), key=str)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        n = sum(p.length for p in parts)
        assert n <= window and n & (n - 1) == 0        # no padding at all
    return pieces


@pytest.mark.parametrize("clash", [False, True])
def test_packing_of_hard_rows(spark, tmp_path, tokenizer, clash):
    docs = stored(spark, documents(spark, HARD, clash), tmp_path / "d")
    check_packing(spark, tokenizer, HARD, docs)


def test_packing_over_shards_and_windows(spark, tmp_path, tokenizer):
    rows = [(i, prose(i, (i * 31) % 120)) for i in range(250)] + [(1000 + i, "the same copy " * 9) for i in range(120)]
    docs = stored(spark, documents(spark, rows), tmp_path / "d")
    check_packing(spark, tokenizer, rows, docs, window=256, shard_tokens=1500)
    check_packing(spark, tokenizer, rows, docs, window=64, shard_documents=7, most=2)
    with pytest.raises(ValueError):
        pack_documents(docs, TOKENIZER, 1, window=100)
    assert pack_documents(documents(spark, []), TOKENIZER, 1).count() == 0


def test_related_texts_share_windows(spark, tmp_path, tokenizer):
    topics = ["mill river stone wheel", "bread oven flour yeast", "sail harbour anchor tide"]
    rows = [(i, prose(i, 60, topics[i % 3].split())) for i in range(90)]
    docs = stored(spark, documents(spark, rows, partitions=1), tmp_path / "d")
    pieces = check_packing(spark, tokenizer, rows, docs, window=512)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p.doc_id % 3)
    same = sum(max(x.count(t) for t in range(3)) for x in by_sequence.values())
    assert same / len(pieces) > 0.8


def test_bm25_beside_a_plain_version():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint32) for _ in range(25)]
    mean = np.mean([len(d) for d in docs])
    whole = Statistics(25, mean, np.array([sum(t in x for x in docs) for t in range(30)]))
    shard = Shard(docs, whole.idf, mean)
    shard.unused[3] = False
    scores = {}
    for j, d in enumerate(docs):
        total = 0.0
        for t in set(docs[3].tolist()):
            df = sum(t in x for x in docs)
            tf = int((d == t).sum())
            if tf and df > 1:
                total += np.log1p((25 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        scores[j] = total
    want = sorted((j for j in scores if j != 3 and scores[j] > 0), key=lambda j: -scores[j])
    got = shard.neighbours(3, terms=30, most=25)
    assert [round(scores[j], 9) for j in got] == [round(scores[j], 9) for j in want]
    # A pair scores alike in a shard that holds but a part of the documents.
    part = Shard(docs[3:12], whole.idf, mean)
    part.unused[0] = False
    assert [j + 3 for j in part.neighbours(0, terms=30, most=25)] == [j for j in got if 3 <= j < 12]


def test_statistics_are_those_of_all_documents(spark, tmp_path, tokenizer, monkeypatch):
    from tidewatch.llm import packing

    seen = []
    told = packing._statistics
    monkeypatch.setattr(packing, "_statistics", lambda *a: seen.append(told(*a)) or seen[-1])
    rows = [*HARD, *((1000 + i, prose(i, i % 90)) for i in range(300))]
    pack_documents(stored(spark, documents(spark, rows, partitions=7), tmp_path / "d"), TOKENIZER, 1).count()
    texts = [plain_ids(tokenizer, t, 1) for _, t, *_ in rows]
    df = np.zeros(len(seen[0].df), np.int64)
    for t in texts:
        df[np.unique(t)] += 1
    assert seen[0].n == len(rows) and (seen[0].df == df).all()
    assert abs(seen[0].mean - np.mean([len(t) for t in texts])) < 1e-9


# -- search ------------------------------------------------------------------------------------

def plain_nearest(vectors, every, k):
    out = {}
    for i, (q, v) in enumerate(vectors):
        if q % every == 0:
            found = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), j) for j, w in vectors if j != q)
            out[q] = found[:k]
    return out


def test_search_on_a_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(60)] + [(1000 + i, [1.0] * 6) for i in range(40)]
    odd = [(500, None), (600, []), (700, [0.0] * 6), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (900, [float("nan")] * 6),
           (910, [float("inf")] * 6), (None, [1.0] * 6), (920, [1.0, 2.0]), (1000, [1.0] * 6)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumns({"h1": F.lit("x"), "v": F.lit(1), "cell": F.lit(0)})
    got = {}
    for r in nearest(df, every=10, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = plain_nearest(vectors, 10, 10)
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [j for _, _, j in found] == [j for _, j in want[q]]
        assert np.allclose([s for _, s, _ in found], [s for s, _ in want[q]], atol=1e-12, rtol=0)


def test_search_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain_nearest(rows, 10, 10)
    got = {}
    for r in nearest(df, every=10, sample=256, block=64, query_block=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_search_of_repeated_ids_with_other_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [5.0]), (3, [2.0]), (3, [4.0]), (7, [9.0])],
                               "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, k=2).collect())
    assert got == [(0, 1, 3, 1.0), (0, 1, 3, 1.0), (0, 2, 3, 3.0), (0, 2, 3, 3.0)]


def test_search_with_too_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty).columns == ["query_id", "rank", "vec_id", "score"] and nearest(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert nearest(one).count() == 0
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in nearest(three).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (50, 4)) for c in range(0, 40, 10)])
    label = balanced_parts(neighbour_graph(x, 8), 4)
    assert np.bincount(label).tolist() == [50] * 4
    assert sum(np.bincount(label[i * 50:(i + 1) * 50]).max() for i in range(4)) >= 190


def test_crc_of_ids(spark):
    ids = np.array([1, 70000, 3], "<u4").tobytes()
    row = spark.createDataFrame([(bytearray(ids),)], "ids binary").select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(ids)


def test_marks_beside_a_plain_version():
    from tidewatch.llm.packing import _marks

    rng = np.random.default_rng(6)
    races = rng.exponential(size=(2, 50))
    texts = [rng.integers(0, 50, n).astype("<u2") for n in (0, 1, 7, 300, 0, 40)]
    got, df = _marks([t.tobytes() for t in texts], np.dtype("<u2"), races)
    assert df.tolist() == [sum(i in t for t in texts) for i in range(50)]
    for i, t in enumerate(texts):
        tokens, counts = np.unique(t, return_counts=True)
        for race, marks in zip(races, got):
            assert marks[i] == (tokens[(race[tokens] / counts).argmin()] if len(t) else -1)


def test_encoder_starts_no_threads_of_its_own():
    code = ("import os; import sys; from tidewatch.llm.tokens import Encoder; "
            "enc = Encoder(sys.argv[1]); before = len(os.listdir('/proc/self/task')); "
            "enc.encode(['Some words, %d.' % i for i in range(500)]); print(len(os.listdir('/proc/self/task')) - before)")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, TOKENIZER], env=env, cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["0"]


def test_encoder_with_a_small_store_equals_the_tokenizer(tokenizer):
    enc = Encoder(TOKENIZER, most=40, letters=200)
    texts = [prose(i, 30) + f" end{i}. {i},{i} .. , x%, Éß. ΣΑΣ a.,b" for i in range(40)] + ["", ".", " , "]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
