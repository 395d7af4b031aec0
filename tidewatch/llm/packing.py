"""Packing documents into sequences of related texts by lexical retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of, with_row, written
from tidewatch.llm.tokens import encoder

_K1, _B = 1.2, 0.75
#: Texts whose token ids are sorted at once.
MARKED = 64


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of all documents: their number, mean length, and how many hold each term."""

    n: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        out = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        out[self.df < 2] = 0.0              # a term of one document finds nobody
        return out


class Shard:
    """A part of the BM25 index: postings of a bounded number of documents, and who is unused.

    Weights are by the statistics of the whole table, so a pair scores alike in any shard.
    """

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(documents)
        lengths = np.array([len(d) for d in documents], np.int64)
        # Sorted pairs (term, document): their runs are the postings and the frequencies.
        pairs = np.concatenate(documents).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(n), lengths).astype(np.uint64)
        pairs.sort()
        at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        tf = np.diff(np.append(at, len(pairs)))
        term = (pairs[at] >> np.uint64(32)).astype(np.int64)
        self.document = (pairs[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.begin = np.searchsorted(term, np.arange(len(idf) + 1))
        self.idf = idf
        norm = _K1 * (1 - _B + _B * lengths / mean)
        self.weight = self.idf[term] * tf * (_K1 + 1) / (tf + norm[self.document])
        self.documents, self.unused = documents, np.ones(n, bool)

    def neighbours(self, seed: int, terms: int, most: int) -> list[int]:
        """Unused documents by falling BM25 score for the seed's rarest terms; ties by number."""
        own = np.unique(self.documents[seed])
        if len(own) > terms:
            own = own[np.argpartition(-self.idf[own], terms)[:terms]]
        own = own[self.idf[own] > 0]
        if not len(own):
            return []
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in own.tolist()]
        found = np.concatenate([self.document[s] for s in spans])
        score = np.bincount(found, np.concatenate([self.weight[s] for s in spans]), len(self.unused))
        score[~self.unused] = 0.0
        best = np.argpartition(-score, most)[:most] if len(score) > most else np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


class _Packer:
    """Fills windows of one task in turn; a piece never crosses a window's end."""

    def __init__(self, first: int, window: int):
        self.sequence, self.filled, self.window = first, 0, window
        self.rows: list[tuple[int, int, int, int, int]] = []    # document, start, length, sequence, offset

    def put(self, document: int, length: int) -> bool:
        """Place a document; True if it closed a window and went on in the next."""
        start, crossed = 0, False
        while start < length:
            if self.filled == self.window:
                self.sequence, self.filled, crossed = self.sequence + 1, 0, start > 0
            n = min(length - start, self.window - self.filled)
            self.rows.append((document, start, n, self.sequence, self.filled))
            start, self.filled = start + n, self.filled + n
        return crossed

    @property
    def room(self) -> int:
        return self.window - self.filled


def _pack_shard(packer: _Packer, shard: Shard, terms: int, most: int) -> None:
    """Seeds in order; a seed's unused neighbours fill the rest of its window."""
    lengths = [len(d) for d in shard.documents]
    for seed in range(len(lengths)):
        if not shard.unused[seed]:
            continue
        queue = [seed]
        while queue:
            current = queue.pop()
            if not shard.unused[current]:
                continue
            shard.unused[current] = False
            packer.put(current, lengths[current])
            while packer.room:
                near = shard.neighbours(current, terms, most)
                if not near:
                    break
                crossed = None
                for other in near:
                    shard.unused[other] = False
                    if packer.put(other, lengths[other]):
                        crossed = other
                    if crossed is not None or not packer.room:
                        break
                if crossed is None:
                    if packer.room:          # all neighbours are in: ask for more
                        continue
                    break
                current = crossed            # the rest of it is the seed of the next window


def _tail(rows: list, window: int) -> list:
    """The open last window as sequences of powers of two, which need no padding."""
    if not rows:
        return []
    last = rows[-1][3]
    whole = [r for r in rows if r[3] != last]
    open_rows = [r for r in rows if r[3] == last]
    left = sum(r[2] for r in open_rows)
    if left == window:
        return rows
    out, sequence, room, offset = whole, last, 1 << (left.bit_length() - 1), 0
    for document, start, n, _, _ in open_rows:
        while n:
            take = min(n, room - offset)
            out.append((document, start, take, sequence, offset))
            start, n, offset = start + take, n - take, offset + take
            if offset == room:
                left -= room
                sequence, offset, room = sequence + 1, 0, 1 << max(0, left.bit_length() - 1)
    return out


def _marks(texts: list[bytes], dtype: np.dtype, races: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each race and text the token id that wins it, times divided by counts; -1 if empty.

    Also how many of the texts hold each token id.
    """
    lengths = [len(x) // dtype.itemsize for x in texts]
    ids = np.frombuffer(b"".join(texts), dtype).astype(np.uint64)
    pairs = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths) << np.uint64(32) | ids
    out = [np.full(len(texts), -1, np.int64) for _ in races]
    if not len(pairs):
        return out, np.zeros(races.shape[1], np.int64)
    pairs.sort()
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(at, len(pairs)))
    text = (pairs[at] >> np.uint64(32)).astype(np.int64)
    token = (pairs[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    for race, winner in zip(races, out, strict=True):
        times = race[token] / counts
        best = np.minimum.reduceat(times, begin)
        first = np.flatnonzero(times == np.repeat(best, np.diff(np.append(begin, len(text)))))[::-1]
        winner[text[first]] = token[first]      # of equal times the smallest id is written last
    return out, np.bincount(token, minlength=races.shape[1])


def _statistics(encoded: DataFrame, terms: int, end_id: int) -> Statistics:
    """The frequencies that every run of texts left beside its first row, summed.

    Tasks add theirs up, Spark sums by term: no more rows than the vocabulary has reach the driver.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for token, count in zip(batch.column("tokens").to_pylist(), batch.column("holders").to_pylist(), strict=True):
                df[np.frombuffer(token, "<u4")] += np.frombuffer(count, "<u2")
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    found = encoded.filter(F.col("tokens").isNotNull()).select("tokens", "holders").mapInArrow(
        partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    total = encoded.agg(F.count("*").alias("n"), F.sum("n_ids").alias("ids")).first()
    df = np.zeros(terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    df[end_id] = total["n"]                 # behind every document
    return Statistics(total["n"], (total["ids"] or 0) / max(total["n"], 1) + 1, df)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048,
                   query_terms: int = 16, most: int = 16, shard_tokens: int = 1 << 20,
                   shard_documents: int = 8192) -> DataFrame:
    """Sequences of at most ``window`` ids from whole texts, related texts side by side.

    1. Every text is encoded, with ``end_id`` behind it, and marked with two of its token ids, each
       drawn in proportion to its count by random numbers that all texts share: texts with like
       words are likely to draw the same, whatever their lengths.
    2. Documents are dealt by ranges of the marks and a hash of their id, so that like texts come
       to one task and marks held by a third of all rows are cut like any other range.
    3. A task reads its documents in order and indexes ``shard_tokens`` ids (or
       ``shard_documents`` documents) at a time with BM25. The first unused document is a seed; its unused neighbours by its
       ``query_terms`` rarest terms follow, best first, until the window is full. The one that
       crosses the end is cut, and its rest is the next seed. The open window goes on into the
       next shard; at the end of a task it is cut into sequences of powers of two. So no sequence
       is padded, and a task holds one shard, however long its range is.

    Returns one row per piece: _row, doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (binary, little-endian unsigned 32-bit). A null text is empty: its end id is packed. Rows of
    equal ids are documents of their own. Empty table: no rows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        races = np.random.default_rng(1).exponential(size=(2, enc.size))
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                found = enc.encode(part.column("text").to_pylist())
                # Few texts at a time are sorted within the processor's cache.
                some = [_marks(found[i:i + MARKED], enc.dtype, races) for i in range(0, len(found), MARKED)]
                marks, df = [np.concatenate(m) for m in zip(*(m for m, _ in some), strict=True)], sum(df for _, df in some)
                token, rest = np.flatnonzero(df), [None] * (len(found) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("doc_id"), *map(pa.array, marks),
                     pa.array([len(x) // enc.dtype.itemsize for x in found], pa.int64()), pa.array(found, pa.binary()),
                     pa.array([token.astype("<u4").tobytes(), *rest], pa.binary()),
                     pa.array([df[token].astype("<u2").tobytes(), *rest], pa.binary())],
                    names=["_row", "doc_id", "mark", "second", "n_ids", "ids", "tokens", "holders"])

    encoded = written(with_row(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        encode, "_row long, doc_id long, mark long, second long, n_ids long, ids binary, tokens binary, holders binary"), "encoded")
    enc = encoder(tokenizer_path)
    dtype, whole = enc.dtype, _statistics(encoded, max(enc.size, end_id + 1), end_id)
    # As many numbers as the vocabulary has.
    sent = docs.sparkSession.sparkContext.broadcast((whole.idf, whole.mean))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = sent.value
        packer = _Packer(TaskContext.get().partitionId() << 40, window)
        keys, held, size = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Pack what is held; rows of windows that are closed go out with their ids."""
            nonlocal keys, held, size
            if held:
                begin = len(packer.rows)
                _pack_shard(packer, Shard(held, idf, mean), query_terms, most)
                for i in range(begin, len(packer.rows)):
                    document, *rest = packer.rows[i]
                    packer.rows[i] = ((*keys[document], held[document]), *rest)
                keys, held, size = [], [], 0
            open_ = packer.sequence if packer.room and not last else None
            ready = [r for r in packer.rows if r[3] != open_]
            packer.rows = [r for r in packer.rows if r[3] == open_]
            if last:
                ready = _tail(ready, window)
            for k in range(0, len(ready), 4096):
                yield _pieces(ready[k:k + 4096])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_row", "doc_id", "ids"))
            for row, doc, raw in zip(*columns, strict=True):
                ids = np.empty(len(raw) // dtype.itemsize + 1, np.uint32)
                ids[:-1], ids[-1] = np.frombuffer(raw, dtype), end_id
                keys.append((row, doc))
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens or len(held) >= shard_documents:
                    yield from flush(False)
        yield from flush(True)

    dealt = encoded.withColumn("salt", F.xxhash64("doc_id", "_row")).repartitionByRange("mark", "second", "salt")
    return dealt.sortWithinPartitions("mark", "second", "salt").select("_row", "doc_id", "ids").mapInArrow(
        pack, "_row long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(rows: list) -> pa.RecordBatch:
    whose, start, length, sequence, offset = zip(*rows, strict=True)
    ids = [w[2][s:s + n].astype("<u4").tobytes() for w, s, n in zip(whose, start, length, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([w[0] for w in whose], pa.int64()), pa.array([w[1] for w in whose], pa.int64()),
         *(pa.array(x, pa.int64()) for x in (start, length, [len(w[2]) for w in whose], sequence, offset)),
         pa.array(ids, pa.binary())],
        names=["_row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
