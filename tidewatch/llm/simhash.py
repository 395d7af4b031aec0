"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import rows_of, written
from tidewatch.llm.components import components
from tidewatch.llm.golay import keys

_SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 majority bits over the XXH64 of all word shingles; no words: 0.

    Words are runs of other than ASCII white space after lower-casing A to Z (on UTF-8 bytes, so
    nothing else changes). Fewer words than ``shingle``: the whole sequence is the one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):          # a long text in parts
        hashes = np.array([digest(joined[a:b], _SEED) for a, b in
                           zip(begins[k:k + (1 << 16)].tolist(), last[k:k + (1 << 16)].tolist(), strict=False)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
            names=["_row", "doc_id", "fp"])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for k in range(0, len(fps), 2048):
            part = fps[k:k + 2048]
            found, owner = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[owner])], names=["key", "fp"])


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _spanning(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links between distinct fingerprints, each compared once reached."""
    links, left = [], fps
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            hit = _differing(left, node) <= bits
            if hit.any():
                found = left[hit]
                links.append((np.full(len(found), node), found))
                frontier, left = np.concatenate([frontier, found]), left[~hit]
    return links


def _verify(bits: int, chunk: int, few: int = 16):
    """Rows sorted by key: links between the fingerprints of a key, at most one per row and key.

    Runs of up to ``few`` rows are compared row by row at once over the batch. Longer ones give a
    spanning forest. A run longer than ``chunk`` is cut into chunks; its rows go on with their
    chunk's number, for pairs of chunks to be compared elsewhere.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        big, cut = None, 0               # the key being cut, and its next chunk

        def compare(key: np.ndarray, fp: np.ndarray):
            links = []
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(starts, len(key)))
            length = np.repeat(lengths, lengths)
            place = np.arange(len(key)) - np.repeat(starts, lengths)
            short = length <= few
            for step in range(1, few):
                i = np.flatnonzero(short & (place + step < length))
                if not len(i):
                    break
                near = _differing(fp[i].view(np.uint64), fp[i + step].view(np.uint64)) <= bits
                links.append((fp[i[near]], fp[i[near] + step]))
            for s, n in zip(starts[lengths > few].tolist(), lengths[lengths > few].tolist(), strict=True):
                links += [(a.view(np.int64), b.view(np.int64)) for a, b in _spanning(fp[s:s + n].view(np.uint64), bits)]
            if links:
                a, b = (np.concatenate(x) for x in zip(*links, strict=True))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield _out(pairs[:, 0], pairs[:, 1], None)

        def whole(key: np.ndarray, fp: np.ndarray, last: bool):
            """Compare the runs that are whole; keep the last run open, or cut it if too long."""
            nonlocal rest_key, rest_fp, big, cut
            end = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
            if big is not None and end and key[0] == big:     # the end of a run that was cut
                stop = int(np.searchsorted(key[:end], big, side="right"))
                yield _out(key[:stop], fp[:stop], cut)
                key, fp, end, big, cut = key[stop:], fp[stop:], end - stop, None, 0
            if end:
                yield from compare(key[:end], fp[:end])
            rest_key, rest_fp = key[end:], fp[end:]
            while len(rest_key) > chunk:
                if big != rest_key[0]:
                    big, cut = rest_key[0], 0
                yield _out(rest_key[:chunk], rest_fp[:chunk], cut)
                rest_key, rest_fp, cut = rest_key[chunk:], rest_fp[chunk:], cut + 1

        for batch in batches:
            yield from whole(np.concatenate([rest_key, batch.column("key").to_numpy()]),
                             np.concatenate([rest_fp, batch.column("fp").to_numpy()]), False)
        if len(rest_key):
            yield from whole(rest_key, rest_fp, True)

    return verify


def _out(a: np.ndarray, b: np.ndarray, part: int | None) -> pa.RecordBatch:
    parts = pa.nulls(len(a), pa.int64()) if part is None else pa.array(np.full(len(a), part, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), parts], names=["a", "b", "part"])


def _chunk_pairs(found: DataFrame, bits: int) -> DataFrame:
    """Links within keys too long for one comparison: every pair of chunks is a task of its own."""
    rows = found.filter("part IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("fp"), "part")
    parts = rows.groupBy("key").agg(F.max("part").alias("last"))
    pairs = rows.join(parts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp")

    def compare(group):
        import pandas as pd

        links = _spanning(np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64), bits)
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True)) if links else ([], [])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).astype("int64")

    return pairs.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def fingerprint_links(fingerprints: DataFrame, bits: int = 4, chunk: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` differing in at most ``bits`` bits.

    Every fingerprint gives keys by the Golay code (``golay.keys``, complete up to 4 bits); equal
    keys meet and are verified on all 64 bits. Per key a spanning forest is emitted, so links
    number at most one per key of a fingerprint, however many near copies there are.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the keys are complete up to 4 differing bits")
    # Eight bytes become some 170 keys: not as few tasks as the fingerprints alone would get.
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by a hash of fp: by fp itself they are dealt already, to few tasks.
    emitted = fingerprints.select("fp").repartition(tasks, F.xxhash64("fp")).mapInArrow(_emit_keys, "key long, fp long")
    found = written(emitted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
        _verify(bits, chunk), "a long, b long, part long"), "golay")
    return found.filter("part IS NULL").select("a", "b").unionByName(_chunk_pairs(found, bits)).distinct()


def simhash_groups(docs: DataFrame, bits: int = 4, row: str | None = None) -> DataFrame:
    """Near-duplicate groups of whole texts.

    One row per input row: _row, doc_id, fp, fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable by links of at most ``bits`` differing bits), group_size (rows),
    is_kept (one row per group, the first with the smallest doc_id). Equal fingerprints meet once,
    so copies never multiply. Null and empty texts have fingerprint zero. Null doc_ids are rows of
    their own; a group of nothing else has a null component_id. Empty table: no rows. _row is the stored
    column ``row``, or as ``with_row`` numbers the rows.
    """
    rows = written(rows_of(docs, row).select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprints, "_row long, doc_id long, fp long"), "fingerprints")
    classes = rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"),
        F.count("*").alias("n"))
    roots = components(fingerprint_links(classes.select("fp"), bits))
    classes = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    groups = classes.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("group_size"))
    named = classes.select("fp", "root").join(groups, "root").select("fp", "kept", "group_size")
    return rows.join(named, "fp").select(
        "_row", "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("kept.doc_id").alias("component_id"), "group_size",
        (F.col("_row") == F.col("kept._row")).alias("is_kept"))
