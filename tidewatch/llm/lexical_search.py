"""Ranked lexical search: best-first over document intervals bounded by range maxima."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: A to Z in lower case; every ASCII character that is no letter or digit as a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all beyond ASCII."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_CLEAN).split()


@dataclass(frozen=True)
class Items:
    """Some items to search for: their terms as numbers, with how often an item has each."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]]) -> "Items":
        vocabulary, terms, repeats = {}, [], []
        for _, text in rows:
            own = [vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)]
            found, n = np.unique(np.array(own, np.int64), return_counts=True)
            terms.append(found)
            repeats.append(n.astype(np.int64))
        return cls([i for i, _ in rows], vocabulary, terms, repeats)


def _count(items: Items):
    """Per document its number of terms, and which of the items' terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.vocabulary.get
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            keep, sizes, ends, terms, counts = [], [], [0], [], []
            for row in range(batch.num_rows):
                words = terms_of(texts[row].as_py())
                if not words:
                    continue
                known = np.fromiter((x for x in map(number, words) if x is not None), np.int64)
                found, n = np.unique(known, return_counts=True)
                keep.append(row)
                sizes.append(len(words))
                terms.append(found.astype(np.int32))
                counts.append(n.astype(np.int32))
                ends.append(ends[-1] + len(found))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32()) for x in (terms, counts)]
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 *[pa.ListArray.from_arrays(offsets, x) for x in flat]], names=["doc_id", "n", "terms", "counts"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n.astype(np.int64))], names=["term", "df"])


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of each of the items' terms."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def build(cls, counts: DataFrame, items: Items) -> "Corpus":
        documents, terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(items.vocabulary), np.int64)
        for term, n in counts.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = n
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()]
        return cls(documents, terms, np.array(weights, np.int64))


class Shard:
    """Posting lists of some documents, each with a sparse table of range maxima.

    The lists stand one behind another, by term and then by document. Level j of the table has,
    for each posting, the place of the greatest impact among it and the 2**j - 1 behind it; what
    reaches over the end of a list is never asked for.
    """

    def __init__(self, corpus: Corpus, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.ids, self.size = ids, len(ids)
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        tf = counts.astype(np.int64)
        m = 25 + 75 * n * corpus.documents // corpus.terms
        impact = corpus.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        self.keys = terms.astype(np.int64) * self.size + doc
        order = np.argsort(self.keys)
        self.keys, self.impact = self.keys[order], impact[order]
        self.begins = np.searchsorted(self.keys, np.arange(len(corpus.weights) + 1) * self.size)
        longest = int(np.diff(self.begins).max(initial=1))
        best = np.arange(len(self.keys), dtype=np.int32)
        table, step = [best], 1
        while 2 * step <= longest:
            before = table[-1]
            best = before.copy()
            a, b = before[:-step], before[step:]
            best[:-step] = np.where(self.impact[a] >= self.impact[b], a, b)
            table.append(best)
            step *= 2
        self.table = np.stack(table)
        self.level = np.zeros(longest + 2, np.int64)
        self.level[1:] = np.floor(np.log2(np.arange(1, longest + 2)))

    def bounds(self, begin: np.ndarray, end: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the lists' range maxima, and the document of the greatest one, per interval."""
        length = end - begin
        level = self.level[np.maximum(length, 1)]
        a = np.minimum(begin, len(self.keys) - 1)
        left = self.table[level, a]
        right = self.table[level, np.minimum(np.maximum(end - (1 << level), 0), len(self.keys) - 1)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        value = np.where(length > 0, self.impact[best] * repeats, 0)
        top = value.argmax(axis=1)
        return value.sum(axis=1), self.keys[best[np.arange(len(best)), top]] % self.size

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int = 1, splits: int | None = None,
               width: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the ``k`` best that score ``least`` or more, and their ties.

        The intervals of highest bound, up to ``width`` at a time, are split at their document of
        maximum impact, which is scored; the rest to its left and right are intervals again. What
        is bounded below the k-th score is left. With ``splits`` the search stops early.
        """
        has = self.begins[terms + 1] > self.begins[terms]
        terms, repeats = terms[has], repeats[has]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores
        begin, end = self.begins[terms][None], self.begins[terms + 1][None]
        bound, doc = self.bounds(begin, end, repeats)
        self.done = 0
        while len(bound) and (splits is None or self.done < splits):
            if len(bound) > width:
                order = np.argpartition(-bound, width)
                now, later = order[:width], order[width:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            a, b, d = begin[now], end[now], doc[now]
            self.done += len(now)
            want = terms * self.size + d[:, None]
            at = np.searchsorted(self.keys, want)
            held = self.keys[np.minimum(at, len(self.keys) - 1)] == want
            score = (np.where(held, self.impact[np.minimum(at, len(self.keys) - 1)], 0) * repeats).sum(axis=1)
            docs, scores = np.concatenate([docs, d]), np.concatenate([scores, score])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            good = scores >= least
            docs, scores = docs[good], scores[good]
            left_right = np.concatenate([a, at + held]), np.concatenate([at, b])
            fresh, their = self.bounds(*left_right, repeats)
            begin = np.concatenate([begin[later], left_right[0]])
            end = np.concatenate([end[later], left_right[1]])
            bound, doc = np.concatenate([bound[later], fresh]), np.concatenate([doc[later], their])
            open_ = bound >= least
            begin, end, bound, doc = begin[open_], end[open_], bound[open_], doc[open_]
        return docs, scores


def _best(ids: pa.Array, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by smaller id, null ids last."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return np.lexsort((ids.fill_null(0).to_numpy(), missing, -scores))[:k]


def _look(corpus: Corpus, items: Items, least: np.ndarray, k: int, splits: int | None, most_documents: int, most_postings: int):
    """The ``k`` best documents per item of a task's rows, shard by shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, documents, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                documents += part.num_rows
                postings += len(part.column("terms").flatten())
                if documents >= most_documents or postings >= most_postings:
                    yield pa.Table.from_batches(held)
                    held, documents, postings = [], 0, 0
        if documents:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least.copy()
        ids = {i: pa.array([], pa.int64()) for i in range(len(items.ids))}
        scores = {i: np.zeros(0, np.int64) for i in ids}
        for table in shards(batches):
            table = table.combine_chunks()
            lists = table.column("terms").chunk(0)
            shard = Shard(corpus, np.arange(table.num_rows), table.column("n").to_numpy(),
                          np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]),
                          lists.flatten().to_numpy(), table.column("counts").chunk(0).flatten().to_numpy())
            named = table.column("doc_id").chunk(0)
            for i in ids:
                docs, found = shard.search(items.terms[i], items.repeats[i], k, int(floor[i]), splits)
                if not len(docs):
                    continue
                ids[i] = pa.concat_arrays([ids[i], named.take(pa.array(docs))])
                scores[i] = np.concatenate([scores[i], found])
                best = _best(ids[i], scores[i], k)
                ids[i], scores[i] = ids[i].take(pa.array(best)), scores[i][best]
                if len(best) == k:
                    floor[i] = max(floor[i], scores[i][-1])
        item = np.repeat(np.array(list(ids), np.int64), [len(s) for s in scores.values()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.concat_arrays(ids.values()), pa.array(np.concatenate(list(scores.values())))],
            names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: Items, k: int, first_splits: int, most_documents: int, most_postings: int) -> DataFrame:
    spark = docs.sparkSession
    counts = written(docs.mapInArrow(_count(items), _COUNTS), "terms")
    corpus = Corpus.build(counts, items)
    schema = "item int, doc_id long, score long"
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def look(least: np.ndarray, splits: int | None) -> DataFrame:
        found = counts.mapInArrow(_look(corpus, items, least, k, splits, most_documents, most_postings), schema)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    least = np.ones(len(items.ids), np.int64)
    if corpus.terms:
        sure = look(least, first_splits).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        for row in sure.filter(F.col("n") == k).collect():
            least[row["item"]] = row["score"]
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return look(least, None).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", query_id: str = "item_id",
           text: str = "text", block_bytes: int = 1 << 20, first_splits: int = 64, most_documents: int = 8192,
           most_postings: int = 1 << 20) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0, exactly.

    One pass over the texts counts the items' terms. Tasks cut these counts into shards (of so many
    documents or postings) of posting lists with range-maximum sparse tables. For an item an
    interval of documents is bounded by the sum of its lists' maxima; intervals are split best
    first until none can beat the k-th score. A first look of few splits in every shard gives each
    item a score that k documents surely reach, from which the whole search starts.

    Scores are whole numbers: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document
    with n of L terms has m = 25 + 75 n N div L, and each occurrence of a term in the item adds
    w (10**9 tf div (1000 tf + 8 m)). Equal scores go by smaller id, null ids last.

    Returns item_id, rank (from 1), doc_id, score. Null and empty texts have no terms: they count
    in nothing and find nothing. Rows with equal document ids are documents of their own; equal
    rows of ``queries`` are one item, other rows with the same id are ranked apart. Other columns
    are not read; empty tables give no rows. Items go to the executors in blocks of about
    ``block_bytes``, and the texts are read once per block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter(
        F.octet_length("text") > 0).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = Items.build(sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0] is None, r)))
        found = found.unionByName(_search_block(rows, items, k, first_splits, most_documents, most_postings))
    return found
