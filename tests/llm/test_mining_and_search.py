"""Phrase mining, lexical search and embedding near-duplicates beside plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ASCII, HARD, documents, prose, stored
from pyspark.sql import types as T

from tidewatch.llm.common import ship
from tidewatch.llm.embedding_dedup import near_vectors
from tidewatch.llm.lexical_search import Corpus, Shard, search, terms_of
from tidewatch.llm.phrases import collocations, phrase_graph, words_of

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("_row", T.StringType()), T.StructField("node", T.StringType())])


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    ship(spark)


# --- phrases -----------------------------------------------------------------------------------

def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_collocations(rows, least, top=2000):
    counts, sizes = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            sizes[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        found = []
        for p, a in often.items():
            if not longer[p] or 100 * longer[p] < 80 * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def spoken(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("a b c d e Ä".split()) + draw.choice(["  ", " ", "\t", " ", ". ", "\n"]) for _ in range(n))


def texts():
    rows = [r + (None,) * (4 - len(r)) for r in HARD]
    rows += [(100 + i, spoken(i, 150), ["en", "de", None, "line\nfeed"][i % 4], "s") for i in range(24)]
    passage = " ".join(f"w{i}" for i in range(60))
    return rows + [(200 + i, f"{prose(i, 5)} {passage}", "en", None) for i in range(9)]


@pytest.mark.parametrize("settings", [{}, {"bits": 16}, {"letters": 50}])
def test_collocations_equal_plain_counts(spark, settings):
    rows = texts()
    got = collocations(documents(spark, rows, clash=True), 5, **settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5)


def test_collocations_top_and_ties(spark):
    rows = texts()
    got = collocations(documents(spark, rows), 2, top=7).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 2, 7)


def test_paths_hold_whole_passages(spark):
    graph = phrase_graph(documents(spark, texts()), 9)
    found = {r["passage"]: r["weight"] for r in graph.paths.filter("lang = 'en'").collect()}
    assert found[" ".join(f"w{i}" for i in range(60))] == 9
    counted = {(r["lang"], r["phrase"]): r["f"] for r in graph.counts.collect()}
    every = Counter()
    for _, text, lang, _ in texts():
        for w in pieces(text):
            every.update((lang or "und", " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert counted == {p: a for p, a in every.items() if a >= 9}


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None), (2, ""), (None, " .,; \n")]), 1).collect() == []


def test_words_keep_their_pieces():
    words = words_of([b"One  two.three", b"\tfour five\x0bsix ", b""])
    assert bytes(words.letters) == b"one two three four five six "
    assert [words.piece[i] == words.piece[i + 1] for i in range(5)] == [True, False, False, True, False]


# --- lexical search ----------------------------------------------------------------------------

def plain_search(rows, items, k=10):
    docs = [(i, Counter(w), len(w)) for i, w in ((r[0], terms_of(r[1])) for r in rows) if w]
    n_docs, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, w, _ in docs for t in w)
    out = []
    for item, text in set(items):
        scores = []
        for doc, w, n in docs:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * w[t] // (1000 * w[t] + 8 * m))
                        for t in terms_of(text))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    assert terms_of("Über-ÄRGER a_b [X] 4711\x7f") == ["Über".encode(), "ÄrgeR".encode().replace(b"R", b"r"), b"a", b"b", b"x", b"4711"]


@pytest.mark.parametrize("settings", [{}, {"first_splits": 1, "most_documents": 3}, {"block_bytes": 40}])
def test_search_equals_plain_scores(spark, settings):
    rows = HARD + [(300 + i, prose(i, 3 + 7 * i % 50)) for i in range(80)] + [(400, prose(1, 9)), (399, prose(1, 9))]
    items = [(1, "mill River stone"), (1, "mill River stone"), (2, "the the the and bridge"), (3, None), (4, ""), (5, "nowhere"),
             (None, "alpha epsilon 4711"), (1, "cloud"), (6, "one two three four")]
    got = search(documents(spark, rows, clash=True), spark.createDataFrame(items, ITEM), **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "mill")], ITEM)
    assert search(documents(spark, []), items).collect() == []
    assert search(documents(spark, [(1, None), (2, " - ")]), items).collect() == []
    assert search(documents(spark, [(1, "mill")]), items.limit(0)).collect() == []


def test_intervals_find_the_best(spark):
    """A shard's search gives the best k, whatever is split at a time, and visits fewer than all."""
    draw = np.random.default_rng(2)
    n_docs, n_terms = 2000, 30
    held = [np.flatnonzero(draw.random(n_terms) < 1 / (1 + np.arange(n_terms))) for _ in range(n_docs)]
    ends = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    terms = np.concatenate(held)
    counts = draw.integers(1, 9, len(terms))
    n = draw.integers(20, 400, n_docs)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in np.bincount(terms, minlength=n_terms)])
    shard = Shard(Corpus(n_docs, int(n.sum()), weights), np.arange(n_docs), n, ends, terms, counts)
    asked, repeats = np.array([2, 7, 11, 29]), np.array([1, 2, 1, 1])
    m = 25 + 75 * n * n_docs // n.sum()
    scores = np.zeros(n_docs, np.int64)
    for doc in range(n_docs):
        for t, tf in zip(terms[ends[doc]:ends[doc + 1]], counts[ends[doc]:ends[doc + 1]], strict=True):
            for a, r in zip(asked, repeats, strict=True):
                scores[doc] += r * weights[t] * (10 ** 9 * int(tf) // (1000 * int(tf) + 8 * int(m[doc]))) if a == t else 0
    tenth = np.sort(scores)[-10]
    for width in (1, 4, 64):
        docs, found = shard.search(asked, repeats, 10, width=width)
        assert dict(zip(docs.tolist(), found.tolist(), strict=True)) == {d: scores[d] for d in np.flatnonzero(scores >= tenth)}
        assert shard.done < n_docs / 2


# --- embeddings --------------------------------------------------------------------------------

def plain_links(vectors, least=0.95):
    """vec_id, n_links, component of rows with ids of their own."""
    fit = [(i, np.array(v, float)) for i, v in vectors
           if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = Counter(len(v) for _, v in fit).most_common(1)[0][0] if fit else 0
    fit = [(i, v / np.abs(v).max()) for i, v in fit if len(v) == width]
    near = {i: {j for j, w in fit if j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= least} for i, v in fit}
    out = []
    for i, _ in vectors:
        reached, edge = {i}, [i]
        while edge:
            edge = [x for e in edge for x in near.get(e, ()) if x not in reached and not reached.add(x)]
        out.append((i, len(near.get(i, ())), min(reached), min(reached) == i))
    return sorted(out)


def clusters(seed=4, dim=12):
    draw = np.random.default_rng(seed)
    rows = []
    for size in [1] * 60 + [2] * 20 + [3, 5, 9, 17, 120]:
        centre = draw.standard_normal(dim)
        rows += [(centre + 0.03 * draw.standard_normal(dim)).tolist() for _ in range(size)]
    rows += [rows[-1]] * 30 + [(np.array(rows[3]) * 1e200).tolist()]
    return list(enumerate(rows, 1))


def vectors(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], VECTOR).repartition(partitions)


@pytest.mark.parametrize("settings", [{}, {"chunk": 32, "k": 4}])
def test_near_vectors_equal_all_pairs(spark, settings):
    rows = clusters() + [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, None] * 6), (1004, [float("nan")] * 12),
                         (1005, [float("inf")] + [0.0] * 11), (1006, [1.0])]
    got = near_vectors(vectors(spark, rows), **settings)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == plain_links(rows)


def test_near_vectors_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [0.0, 3.0]), (9, [-1.0, 0.0]), (5, [1.0, 0.1])]
    got = sorted((tuple(r) for r in near_vectors(stored(spark, vectors(spark, rows), tmp_path / "v")).collect()), key=repr)
    assert got == sorted([(7, 3, 5, False), (7, 3, 5, False), (None, 3, 5, False), (None, 0, None, True), (9, 0, 9, True),
                          (5, 3, 5, True)], key=repr)


def test_near_vectors_of_nothing(spark):
    assert near_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors(vectors(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
