"""Token-id files with a minimal perfect hash index over document keys.

A folder holds payload files ``ids-PPPPPP-SSSS.bin`` (raw little-endian ids, documents in
ascending doc_id order over all files in name order), index files ``index-BBBBBB.mph`` and the
tables ``shards`` (file, its first id's place) and ``layout`` (widths and counts).
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of, written
from tidewatch.llm.tokens import encoder

MAGIC = b"TWMPH002"
_BITS = 224                             # of a block, behind four bytes that number the keys ahead
_ENTRY = np.dtype([("mark", "<u4"), ("shard", "<i8"), ("at", "<i8"), ("n", "<i8")])
_GAMMA = 1.5
_MASK = (1 << 64) - 1


# -- minimal perfect hash ---------------------------------------------------------------------

def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slots of 64-bit keys in one level of a hash, by a 64-bit finaliser."""
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _MASK)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray, levels: int = 64) -> list[np.ndarray]:
    """Bit arrays, one per level. A key sits in the first level where its slot is its alone."""
    out, left = [], keys
    while len(left):
        if len(out) == levels:
            raise ValueError("two document keys share a 64-bit hash; write with another seed")
        size = max(8, int(_GAMMA * len(left)))
        slots = _place(left, len(out), size)
        alone = np.bincount(slots, minlength=size) == 1
        out.append(alone)
        left = left[~alone[slots]]
    return out


def find_slots(bits: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key, 0 to n - 1; a key that was not built in may get any, or -1."""
    out, base, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, alone in enumerate(bits):
        slots = _place(keys[left], level, len(alone))
        ranks = np.cumsum(alone)
        hit = alone[slots]
        out[left[hit]] = base + ranks[slots[hit]] - 1
        base += int(ranks[-1])
        left = left[~hit]
    return out


def _blocks(alone: np.ndarray, before: int) -> np.ndarray:
    """A level's bits in blocks of 32 bytes, each with the number of keys ahead of it."""
    count = -(-len(alone) // _BITS)
    bits = np.zeros(count * _BITS, bool)
    bits[:len(alone)] = alone
    bits = bits.reshape(count, _BITS)
    ahead = (before + np.cumsum(bits.sum(1)) - bits.sum(1)).astype("<u4")
    return np.hstack([ahead.view(np.uint8).reshape(count, 4), np.packbits(bits, axis=1)])


def _pack_index(keys, marks, shards, offsets, counts) -> bytes:
    bits = build_hash(keys)
    entries = np.empty(len(keys), _ENTRY)
    slots = find_slots(bits, keys)
    for name, column in zip(_ENTRY.names, (marks, shards, offsets, counts), strict=True):
        entries[name][slots] = column
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<QI", len(keys), len(bits)))
    out.write(np.array([len(b) for b in bits], "<u8").tobytes())
    before = 0
    for b in bits:
        out.write(_blocks(b, before).tobytes())
        before += int(b.sum())
    out.write(entries.tobytes())
    return out.getvalue()


class Index:
    """Looks keys up in an index file: one block a level and one entry for each key.

    ``read(at, length)`` gives bytes of the file. A key is found in about two levels on average whatever
    the size of the bucket, so few keys cost few short reads; for many keys ``read`` is over bytes
    that were read at once.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 20)
        if head[:8] != MAGIC:
            raise ValueError("not an index of token files")
        self.n, levels = struct.unpack_from("<QI", head, 8)
        self.sizes = np.frombuffer(read(20, 8 * levels), "<u8").tolist()
        self.begins = np.cumsum([20 + 8 * levels, *(32 * -(-size // _BITS) for size in self.sizes)]).tolist()

    def _rows(self, begin: int, width: int, numbers: np.ndarray) -> np.ndarray:
        raw = b"".join(self.read(begin + width * i, width) for i in numbers.tolist())
        return np.frombuffer(raw, np.uint8).reshape(len(numbers), width)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """As ``find_slots``, from the blocks."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            places = _place(keys[left], level, size)
            blocks = self._rows(self.begins[level], 32, places // _BITS)
            bits, inside = np.unpackbits(blocks[:, 4:], axis=1), places % _BITS
            ahead = np.where(np.arange(_BITS) < inside[:, None], bits, 0).sum(1)
            hit = bits[np.arange(len(left)), inside] == 1
            rank = np.ascontiguousarray(blocks[:, :4]).view("<u4")[:, 0].astype(np.int64) + ahead
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out

    def entries(self, slots: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self._rows(self.begins[-1], _ENTRY.itemsize, slots)).view(_ENTRY)[:, 0]


# -- files ------------------------------------------------------------------------------------

def _files(path: str):
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    return fs, root


class _Shard:
    """One payload file, written under another name and moved into place when whole.

    A repeated task writes the same bytes, so it does not matter whose file stays.
    """

    def __init__(self, fs, root: str, number: int):
        self.fs, self.path = fs, f"{root}/{_name(number)}"
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.ids = fs.open_output_stream(self.part), 0

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _name(shard: int) -> str:
    return f"ids-{shard >> 20:06d}-{shard & 0xFFFFF:04d}.bin"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      shard_ids: int = 1 << 25, index_keys: int = 1 << 16, seed: int = 11) -> int:
    """Encode whole texts and write them with their index; gives the number of documents.

    Documents are dealt by ranges of doc_id and a hash of the text and sorted by both, so that file
    order is id order, a repeated task writes rows of one id in the same order, and an id with very
    many rows is dealt to many tasks; every task streams its range into files of at least ``shard_ids`` ids each. The index is cut into
    buckets of about ``index_keys`` keys by hash, each one task and one file: bit arrays of a
    minimal perfect hash, a 32-bit fingerprint per key that tells strangers, file, place and
    length. Keys are (doc_id, number among rows of that id), so repeated ids stay apart; a null
    doc_id comes first. A null text is empty and holds the end id only. An empty table makes
    empty tables and no file.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn(
        "digest", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        enc = encoder(tokenizer_path)
        kind = enc.dtype if end_id < 1 << 16 else np.dtype("<u4")
        last = np.array([end_id], kind).tobytes()
        number, shard = TaskContext.get().partitionId() << 20, None
        for batch in batches:
            found = enc.encode(batch.column("text").to_pylist())
            if kind != enc.dtype:
                found = [np.frombuffer(x, enc.dtype).astype(kind).tobytes() for x in found]
            shards, offsets, counts = [], [], []
            for raw in found:
                if shard is None:
                    shard = _Shard(fs, root, number)
                shard.out.write(raw + last)
                n = len(raw) // kind.itemsize + 1
                shards.append(number)
                offsets.append(shard.ids)
                counts.append(n)
                shard.ids += n
                if shard.ids >= shard_ids:
                    shard.close()
                    number, shard = number + 1, None
            yield pa.record_batch([batch.column("doc_id"), pa.array(shards, pa.int64()),
                                   pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                                  names=["doc_id", "shard", "at", "n"])
        if shard is not None:
            shard.close()

    order = ["doc_id", "digest"]
    entries = written(ids.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").mapInArrow(
        write, "doc_id long, shard long, at long, n long"), "token-entries")
    # One row per file; the files are in order, so their sums give every file's first place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    entries.groupBy("shard").agg(F.sum("n").alias("ids")).select(
        "shard", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    ).write.parquet(f"{path}/shards")
    total = entries.count()
    buckets = max(1, -(-total // index_keys))
    order = Window.partitionBy("doc_id").orderBy("shard", "at")
    keyed = entries.withColumn("copy", (F.row_number().over(order) - 1).cast("long"))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        fs, root = _files(path)
        raw = _pack_index(group["key"].to_numpy(np.int64).view(np.uint64), group["mark"].to_numpy(),
                          *(group[c].to_numpy() for c in ("shard", "at", "n")))
        bucket = int(group["bucket"].iloc[0])
        target = f"{root}/index-{bucket:06d}.mph"
        part = f"{target}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(raw)
        fs.move(part, target)
        return pd.DataFrame({"bucket": [bucket], "keys": [len(group)]})

    _keyed(keyed, buckets, seed).groupBy("bucket").applyInPandas(
        index, "bucket long, keys long").write.parquet(f"{path}/buckets")
    spark.createDataFrame([(total, buckets, seed, tokenizer_width(tokenizer_path, end_id))],
                          "documents long, buckets long, seed long, width int"
                          ).write.parquet(f"{path}/layout")
    return total


def tokenizer_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes per id in the payload files."""
    return max(encoder(tokenizer_path).dtype.itemsize, 2 if end_id < 1 << 16 else 4)


def _keyed(df: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Bucket, 64-bit key and 32-bit fingerprint of (doc_id, copy)."""
    return df.withColumns({
        "key": F.xxhash64("doc_id", "copy", F.lit(seed)),
        "mark": F.pmod(F.xxhash64(F.lit(seed + 1), "copy", "doc_id"), F.lit(1 << 32)),
        "bucket": F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed + 2)), F.lit(buckets))})


def read_token_files(spark: SparkSession, path: str, keys: DataFrame, once: int = 1 << 12) -> DataFrame:
    """Documents by key, from the files: doc_id, copy, start, n_tokens, ids (binary).

    ``keys`` has doc_id and copy. The index gives each key's file, place and length in constant
    time, by a few short reads; a bucket asked for more than one key in ``once`` bytes of it is read
    whole. Keys that are not in the files have another fingerprint and give no row (a stranger
    passes with a chance of 2^-32). ``ids`` are little-endian unsigned 32-bit integers.
    """
    layout = spark.read.parquet(f"{path}/layout").first()
    shards = spark.read.parquet(f"{path}/shards").select("shard", "base")
    width = layout["width"]

    def look_up(group: pd.DataFrame) -> pd.DataFrame:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        name = f"{root}/index-{int(group['bucket'].iloc[0]):06d}.mph"
        file = fs.get_file_info(name)
        if file.type == pyarrow.fs.FileType.NotFound:
            return pd.DataFrame({"doc_id": [], "copy": [], "shard": [], "at": [], "n": []})
        with fs.open_input_file(name) as f:
            read = lambda at, length: f.read_at(length, at)
            if len(group) * once > file.size:       # many keys: cheaper read as a whole
                raw = f.read_at(file.size, 0)
                read = lambda at, length: raw[at:at + length]
            index = Index(read)
            slots = index.slots(group["key"].to_numpy(np.int64).view(np.uint64))
            known = np.flatnonzero(slots >= 0)
            entries = index.entries(slots[known])
        right = entries["mark"] == group["mark"].to_numpy()[known]
        rows, entries = group.iloc[known[right]], entries[right]
        return pd.DataFrame({c: rows[c].to_numpy() for c in ("doc_id", "copy")} | {c: entries[c] for c in ("shard", "at", "n")})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        f, opened = None, None
        for batch in batches:
            out, size = [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n")), strict=True)
            begin = 0
            for i, (shard, at, n) in enumerate(rows):
                if shard != opened:
                    f, opened = fs.open_input_file(f"{root}/{_name(shard)}"), shard
                raw = f.read_at(n * width, at * width)
                out.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                size += n
                if size >= 1 << 22:
                    yield _with_ids(batch.slice(begin, i + 1 - begin), out)
                    out, size, begin = [], 0, i + 1
            yield _with_ids(batch.slice(begin), out)

    found = _keyed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")),
                   layout["buckets"], layout["seed"]).groupBy("bucket").applyInPandas(
        look_up, "doc_id long, copy long, shard long, at long, n long")
    placed = found.join(shards, "shard").select(
        "doc_id", "copy", "shard", "at", "n", (F.col("base") + F.col("at")).alias("start"))
    spans = placed.repartition("shard", F.floor(F.col("at") / (1 << 22))).sortWithinPartitions("shard", "at")
    return spans.mapInArrow(
        read, "doc_id long, copy long, start long, n_tokens long, ids binary")


def _with_ids(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([batch.column(c) for c in ("doc_id", "copy", "start", "n")] + [pa.array(ids, pa.binary())],
                           names=["doc_id", "copy", "start", "n_tokens", "ids"])
