"""Licence scan by diagonal voting of word k-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import with_row
from tidewatch.llm.license_templates import NOTICES, PHRASES

#: A word: ASCII letters and digits and everything beyond ASCII, in UTF-8.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_BITS = 12                              # of a word's number in a k-gram's hash


def scan_words(text: str) -> list[bytes]:
    """Words of a text, A to Z lower-cased (bytes.lower leaves all other letters alone)."""
    return _WORDS.findall(text.encode().lower())


@dataclass(frozen=True)
class Templates:
    """Word numbers of phrases (2-grams) and notices (k-grams), and where each k-gram stands.

    The hash of a k-gram is its word numbers side by side in 62 bits, so it has no collisions.
    """

    words: dict[bytes, int]
    entries: list[tuple[int, int, int, int, str, bool]]   # gram, template, place, words, label, phrase
    k: int

    @classmethod
    def build(cls, phrases=PHRASES, notices=NOTICES, k: int = 5) -> "Templates":
        if k < 2 or k * _BITS > 62:
            raise ValueError(f"k must be between 2 and {62 // _BITS}")
        words, entries = {}, []
        texts = [(label, text, True) for text, label in phrases] + [(label, text, False) for label, text in notices]
        for template, (label, text, phrase) in enumerate(texts):
            ids = [words.setdefault(w, len(words) + 1) for w in scan_words(text)]
            step = 2 if phrase else k
            if len(ids) < step:
                raise ValueError(f"a template needs at least {step} words: {text!r}")
            for at in range(len(ids) - step + 1):
                gram = 0
                for i in ids[at:at + step]:
                    gram = gram << _BITS | i
                entries.append((gram, template, at, len(ids), label, phrase))
        if len(words) >= 1 << _BITS:
            raise ValueError(f"templates hold more than {(1 << _BITS) - 1} words")
        return cls(words, entries, k)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per template k-gram: a few hundred rows, whatever is scanned."""
        return spark.createDataFrame(
            self.entries, "gram long, template int, place int, size int, label string, phrase boolean")


def _rolling(templates: Templates):
    """Per document the number of words and the hashes of all its k-grams of template words."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, k = templates.words.get, templates.k
        grams_type = pa.list_(pa.struct([("at", pa.int64()), ("gram", pa.int64())]))
        for batch in batches:
            counts, ends, places, grams = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = scan_words(text or "")
                counts.append(len(words))
                ids = np.array(list(map(number, words, repeat(0))), np.int64)
                found = 0
                for step in (2, k):
                    if len(ids) < step:
                        continue
                    span = len(ids) - step + 1
                    at = np.flatnonzero(ids[:span])
                    for j in range(1, step):
                        at = at[ids[at + j] > 0]
                    gram = np.zeros(len(at), np.int64)
                    for j in range(step):
                        gram = gram << _BITS | ids[at + j]
                    places.append(at)
                    grams.append(gram)
                    found += len(at)
                ends.append(ends[-1] + found)
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (places, grams)],
                names=["at", "gram"])
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=grams_type)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(counts, pa.int64()), hits],
                names=["_row", "doc_id", "n_words", "hits"])

    return roll


def find_spans(docs: DataFrame, templates: Templates | None = None, slack: int = 8,
               least: float = 0.8) -> DataFrame:
    """Verified places of templates: one row per place, or one with a null template per document.

    All rolling k-gram hashes of a text are joined to template places (2-grams to phrases,
    ``k``-grams to notices; a k-gram with a word that no template has cannot match and is not
    sent). Hits of one template vote for the diagonal document place minus template place. A
    phrase stands where all its 2-grams vote. For notices, diagonals no more than ``slack`` words
    apart are merged, as an inserted or dropped word shifts the rest; the words of the template
    under the merged votes are counted, and a span with a share of at least ``least`` counts. Two
    spans of one template that do not overlap lie ``2 * least - 1`` of its words apart at least, so
    diagonals of short templates merge only below that: notices one behind another stay apart.

    Returns _row, doc_id, n_words, template, label, phrase, start, share.
    """
    templates = templates or Templates.build()
    spark = docs.sparkSession
    rows = with_row(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _rolling(templates), "_row long, doc_id long, n_words long, hits array<struct<at: bigint, gram: bigint>>")
    hits = rows.select("_row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select(
        "_row", "doc_id", "n_words", F.col("hit.at").alias("at"), F.col("hit.gram").alias("gram"))
    # A few hundred rows, fixed by the templates.
    votes = hits.join(F.broadcast(templates.table(spark)), "gram", "left")
    doc = ["_row", "doc_id", "n_words"]
    diagonals = votes.groupBy(*doc, "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"),
        F.collect_set("place").alias("places"))
    by_template = Window.partitionBy(*doc, "template").orderBy("diagonal")
    apart = F.ceil((2 * least - 1) * F.col("size")) - 1
    near = F.col("diagonal") - F.lag("diagonal").over(by_template) <= F.when(F.col("phrase"), 0).otherwise(
        F.least(F.lit(slack), apart))
    runs = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(by_template.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*doc, "template", "run").agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"),
        F.min("diagonal").alias("start"), F.flatten(F.collect_set("places")).alias("places"))
    under = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(
        p, p + F.when(F.col("phrase"), 2).otherwise(templates.k) - 1)))))
    # Votes count once per template word, and a run holds at most one template's words.
    share = F.when(F.col("template").isNotNull(), under / F.col("size"))
    verified = F.when(F.col("phrase"), F.size("places") == F.col("size") - 1).otherwise(share >= least)
    right = F.coalesce(verified, F.lit(False))
    return merged.select(*doc, *[F.when(right, F.col(c)).alias(c) for c in ("template", "label", "phrase")],
                         F.when(right, F.greatest(F.col("start"), F.lit(0))).alias("start"),
                         F.when(right, share).alias("share"))


def scan_licenses(docs: DataFrame, templates: Templates | None = None, slack: int = 8,
                  least: float = 0.8) -> DataFrame:
    """One row per document with what ``find_spans`` verified in it.

    doc_id, n_words, n_base (all places of phrases), first_word and last_word (smallest and
    largest start of a phrase, else null), base_labels and labels (distinct, sorted,
    comma-joined; empty if none), score (the largest share of a verified template, 1 for a
    phrase, 0 for nothing), n_notices. A null text is empty; rows with equal ids stay apart.
    """
    spans = find_spans(docs, templates, slack, least)
    base = F.col("phrase")

    def joined(column):
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    return spans.groupBy("_row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.max("share"), F.lit(0.0))).alias("score"),
        F.count(F.when(~base, 1)).alias("n_notices")).drop("_row")
