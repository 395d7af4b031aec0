"""Phrase collocations by a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of, written

#: Words of the longest phrase: an edge of the graph. Its nodes have one word less.
LONGEST = 4
_SPACE, _END = 32, 10
#: A to Z in lower case; what ends a piece as a line feed; tabs as spaces.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09",
                         b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_PRIME = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """All words of some texts, one space behind each, and the piece every word is in."""

    letters: np.ndarray
    begins: np.ndarray                  # one more than words: where the next would begin
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.piece)

    def hashes(self) -> np.ndarray:
        """A 64-bit number per word from its letters; unequal words may share one."""
        n = len(self.letters)
        powers = np.full(n + 1, _PRIME, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        back = np.full(n + 1, pow(_PRIME, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        begins = self.begins
        return mixed((sums[begins[1:] - 1] - sums[begins[:-1]]) * back[begins[:-1]])

    def spelled(self, first: np.ndarray, words: np.ndarray) -> pa.Array:
        """The phrases of so many ``words`` from the word ``first`` on."""
        begin, end = self.begins[first], self.begins[first + words] - 1
        sizes = end - begin
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self.letters[at]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[bytes]) -> Words:
    """Words (runs without spaces and tabs) of pieces (runs without ``.,;:!?`` and line ends)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_CLEAN), np.uint8)
    end = raw == _END
    gap = end | (raw == _SPACE)
    closes = np.empty(len(gap), bool)           # the first gap behind a word
    closes[:1], closes[1:] = False, gap[1:] & ~gap[:-1]
    keep = ~gap | closes
    letters = raw[keep].copy()
    letters[closes[keep]] = _SPACE
    begins = np.concatenate([[0], np.flatnonzero(closes[keep]) + 1])
    # The piece is known by the line feeds up to the gap behind a word, that gap left out.
    piece = (np.cumsum(end, dtype=np.int64) - end)[closes]
    return Words(letters, begins, piece)


def _by_lang(batches: Iterator[pa.RecordBatch], letters: int) -> Iterator[tuple[str, Words]]:
    """Words of texts of one language at a time, of about so many bytes (longer texts alone)."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(langs, texts, strict=True):
            rows.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= letters:
                yield lang, words_of(rows.pop(lang))
                size.pop(lang)
        for lang, own in rows.items():
            yield lang, words_of(own)


def _hashes(lang: str, words: Words) -> list[np.ndarray]:
    """Numbers of the phrases of one, two and three words that begin at each word."""
    seed = np.uint64(int.from_bytes(lang.encode(), "little") % (1 << 64))
    one = mixed(words.hashes() + mixed(np.array([seed], np.uint64)))
    found = [one]
    for k in range(1, LONGEST - 1):
        found.append(mixed(found[-1] * np.uint64(3) + np.append(one[k:], np.zeros(min(k, len(one)), np.uint64))))
    return found


def _reach(words: Words, hashes: list[np.ndarray], bitmaps: list[np.ndarray], bits: int) -> np.ndarray:
    """How many words on from each a phrase may go in its piece that is not surely rare.

    A phrase is surely rare if a part of it is, so four words need both their threes, three both
    their pairs; what no bitmap tells of may be frequent.
    """

    def often(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        return (bitmap[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)

    fits = np.append(words.piece[1:] == words.piece[:-1], False)
    reach = often(hashes[0], bitmaps[0]).astype(np.int8) if bitmaps else np.ones(len(words), np.int8)
    for k in range(2, LONGEST + 1):
        may = (reach == k - 1) & (np.append(reach[1:], 0) >= k - 1)
        if k == 2:
            may &= fits
        if k <= len(bitmaps) and k < LONGEST:
            may &= often(hashes[k - 1], bitmaps[k - 1])
        reach[may] = k
    return reach


def _frequent(docs: DataFrame, least: int, bits: int, letters: int, sent, sizes: list[int]) -> DataFrame:
    """bucket of phrases of the ``sizes`` met ``least`` times or more: size, part, places.

    A phrase that is not in such a bucket is surely rarer; one that is may be rare too.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_lang(batches, letters):
            if len(words):
                hashes = _hashes(lang, words)
                reach = _reach(words, hashes, sent.value, bits)
                met = [(hashes[k - 1][reach >= k] >> np.uint64(64 - bits)).astype(np.int64) | k << bits for k in sizes]
                found, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    often = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.col("bucket").bitwiseAND((1 << bits) - 1)
    return often.groupBy(F.shiftright("bucket", bits).cast("int").alias("size"), F.shiftright(place, 16).cast("int").alias("part")).agg(
        F.collect_list(place.bitwiseAND(0xFFFF).cast("int")).alias("places"))


def _bitmaps(parts: DataFrame, bits: int, sizes: list[int]) -> list[np.ndarray]:
    """Bitmaps of ``2 ** bits`` / 8 bytes on the driver, packed part by part on the executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for places in batch.column("places"):
                flags = np.zeros(1 << 16, bool)
                flags[places.values.to_numpy()] = True
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("size"), batch.column("part"), pa.array(packed, pa.binary())], names=["size", "part", "bytes"])

    whole = {k: np.zeros((1 << max(bits - 16, 0), (1 << 16) // 8), np.uint8) for k in sizes}
    for row in parts.mapInArrow(pack, "size int, part int, bytes binary").collect():
        whole[row["size"]][row["part"]] = np.frombuffer(row["bytes"], np.uint8)
    return [bitmap.ravel() for bitmap in whole.values()]


def _starts(docs: DataFrame, bits: int, letters: int, sent) -> DataFrame:
    """key (lang, line feed, phrase), n: what begins at each word, as far as it may be frequent.

    Four words are an edge. Fewer are where a path ends: its piece does, or all that follows is
    rare. No word at all counts all words.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_lang(batches, letters):
            if not len(words):
                continue
            reach = _reach(words, _hashes(lang, words), sent.value, bits)
            spelled = pa.BinaryArray.from_buffers(
                pa.binary(), len(words), [None, pa.py_buffer(words.begins.astype(np.int32)), pa.py_buffer(words.letters)])
            ids = spelled.dictionary_encode().indices.to_numpy().astype(np.int64)
            out = [(pa.array([""]), np.array([len(words)]))]
            for n in range(1, LONGEST + 1):
                first = np.flatnonzero(reach == n)
                key = ids[first]
                for k in range(1, n):
                    _, key = np.unique(key * (len(words) + 1) + ids[first + k], return_inverse=True)
                _, place, count = np.unique(key, return_index=True, return_counts=True)
                out.append((words.spelled(first[place], np.full(len(place), n)), count))
            phrases = pa.chunked_array([x for x, _ in out]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(pa.scalar(f"{lang}\n"), phrases, ""),
                 pa.array(np.concatenate([n for _, n in out]).astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(emit, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _words(phrase: str, first: int | str | Column, count: int | str | Column) -> Column:
    """At most ``count`` words of a phrase from word ``first`` on, which is counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


@dataclass(frozen=True)
class PhraseGraph:
    """What occurs ``least`` times: counts (lang, phrase, words, f) and the compacted graph.

    ``paths``: lang, passage, words, weight. A passage runs through nodes that nothing else enters
    or leaves, so all of it occurs ``weight`` times; it may be much longer than a phrase.
    """

    counts: DataFrame
    paths: DataFrame
    sizes: DataFrame                    # lang, n: all words


def phrase_graph(docs: DataFrame, least: int = 30, lang: str = "lang", text: str = "text",
                 bits: int = 27, letters: int = 1 << 20) -> PhraseGraph:
    """Count phrases of 1 to 4 words that occur ``least`` times or more in a language.

    Edges of the graph are phrases of four words within a piece, their nodes the three words they
    overlap in. Edges are summed by Spark, one row per distinct edge. What leaves a node and what
    ends in it gives the node's count; the same sums give two words and one. Paths of nodes with
    one way in and one out are compacted by pointer doubling; their counts are read off the paths.

    What is surely rare is left out first: buckets of words and pairs are counted, then those of
    three words of frequent pairs, and fixed bitmaps of ``2 ** bits`` buckets (16 MB each) that
    reach ``least`` are broadcast. A path ends where only rare phrases go on, which changes no
    other count, so counts are exact whatever the bitmaps let through.

    A null text is empty, a null language is ``und``. Other columns are not read. An empty table
    gives empty ones. Texts are read whole, about ``letters`` bytes at a time, longer ones alone. A
    passage lies within one piece of a text, so the rows of a path are bounded by the longest text.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    context = docs.sparkSession.sparkContext
    bitmaps = []
    for sizes in ([1, 2], [3]):
        bitmaps = bitmaps + _bitmaps(_frequent(rows, least, bits, letters, context.broadcast(bitmaps), sizes), bits, sizes)
    key = F.split("key", "\n")
    # A language may hold line feeds, a phrase none.
    sums = written(_starts(rows, bits, letters, context.broadcast(bitmaps)).select(
        F.array_join(F.slice(key, 1, F.size(key) - 1), "\n").alias("lang"), F.element_at(key, -1).alias("phrase"), "n")
        .withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))), "edges")
    edges = sums.filter(F.col("words") == LONGEST).drop("words")
    counts = {}
    flow = edges
    for k in range(LONGEST - 1, 0, -1):
        flow = written(
            flow.select("lang", _words("phrase", 1, k).alias("phrase"), "n")
            .unionByName(sums.filter(F.col("words") == k).drop("words"))
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n")), f"nodes-{k}")
        counts[k] = flow.filter(F.col("n") >= least)
    paths = _compacted(edges.filter(F.col("n") >= least), counts[LONGEST - 1])
    # Phrases of four words are the edges of the paths, those of three their inner nodes and all other nodes.
    places = paths.select("lang", F.col("weight").alias("n"), F.split("passage", " ").alias("w"), "words").select(
        "lang", "n", "w", F.explode(F.sequence(F.lit(1), F.col("words") - LONGEST + 1)).alias("at"))
    counts[LONGEST] = places.select("lang", F.array_join(F.slice("w", F.col("at"), LONGEST), " ").alias("phrase"), "n")
    inner = places.filter("at > 1").select("lang", F.array_join(F.slice("w", F.col("at"), LONGEST - 1), " ").alias("phrase"), "n")
    others = counts[LONGEST - 1].join(inner, ["lang", "phrase"], "left_anti")
    counts[LONGEST - 1] = inner.unionByName(others)
    every = None
    for k, found in counts.items():
        found = found.withColumn("words", F.lit(k))
        every = found if every is None else every.unionByName(found)
    sizes = sums.filter(F.col("words") == 0).select("lang", "n")
    return PhraseGraph(written(every.withColumnRenamed("n", "f"), "phrases"), paths, sizes)


def _compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths of the graph: lang, passage, words, weight; an edge that nothing continues is a path.

    An edge is followed by another if their node has no other way in or out, so all three occur
    equally often. Each round doubles how far back an edge has looked for the first of its path.
    A text is finite, so no path is a circle: it is entered where a piece begins.
    """
    node = LONGEST - 1
    into = edges.select("lang", _words("phrase", 2, node).alias("node"), "n", F.col("phrase").alias("before"))
    out = edges.select("lang", _words("phrase", 1, node).alias("node"), "n", "phrase")
    links = into.join(nodes.select("lang", F.col("phrase").alias("node"), "n"), ["lang", "node", "n"]).join(
        out, ["lang", "node", "n"]).select("lang", "phrase", "before")
    state = written(edges.join(links, ["lang", "phrase"], "left").select(
        "lang", "phrase", "n", F.coalesce("before", "phrase").alias("head"),
        F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps")), "paths")
    while not state.filter("steps > 0").isEmpty():
        back = state.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        doubled = written(state.join(back, ["lang", "head"]).select(
            "lang", "phrase", "n", F.col("further").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), "more"), "paths")
        state = doubled.drop("more")
        if doubled.filter("more > 0").isEmpty():
            break
    last = F.struct("steps", F.substring_index("phrase", " ", -1).alias("word"))
    return state.groupBy("lang", "head").agg(
        F.max("n").alias("weight"), F.sort_array(F.collect_list(last)).alias("all")).select(
        "lang", F.concat_ws(" ", "head", F.transform(F.slice("all", 2, F.size("all")), lambda x: x["word"])).alias("passage"),
        (F.size("all") + LONGEST - 1).alias("words"), "weight")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorbed: int = 80, **settings) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words by how much they stand together.

    A phrase that occurs ``a >= least`` times is cut in two in every way; of a cut whose parts
    occur l and r times the score is floor(2000000 a / (l + r)), the lowest cut counts (of equal
    ones the first). A phrase is dropped if a longer one that occurs ``least`` times holds its
    words and occurs ``absorbed`` percent as often or more. Order: score, a (both descending),
    phrase by its UTF-8 bytes. Returns lang, rank, phrase, a, l, r, n, score; n is the number of
    words of the language. Nulls, other columns and empty tables: see ``phrase_graph``.
    """
    graph = phrase_graph(docs, least, **settings)
    counts = graph.counts
    phrases = counts.filter("words > 1")
    cuts = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(
        F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _words("phrase", 1, "k").alias("head"), _words("phrase", F.col("k") + 1, LONGEST).alias("tail"))
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = "decimal(38,0)"
    # Of decimals without places, div is exact and gives a long.
    score = F.expr(f"cast(2000000 as {wide}) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    within = phrases.filter("words > 2").select("lang", "words", "phrase", "f", F.explode(F.sequence(
        F.lit(2), F.col("words") - 1)).alias("size")).select("lang", "phrase", "f", "size", F.explode(F.sequence(
            F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")).select(
        "lang", _words("phrase", "at", "size").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stays = scored.join(within, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | F.expr(f"cast(100 as {wide}) * longer < cast({int(absorbed)} as {wide}) * a"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = stays.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language is not one task: the best of each share of it first.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(tasks))
    best = found.withColumn("_share", share).withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    return ranked.join(F.broadcast(graph.sizes.groupBy("lang").agg(F.sum("n").alias("n"))), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
