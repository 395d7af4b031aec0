"""Small document tables and plain versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
#: Columns that the operators use themselves.
CLASH = ["_row", "row", "run", "sha", "word", "line", "first", "n", "p", "leaf", "size", "score", "ids", "mark", "h1"]


def documents(spark, rows, clash=False, partitions=3):
    """A table of (doc_id, text[, lang[, source]]); with ``clash`` also columns that clash."""
    full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
    schema = DOCUMENT
    if clash:
        schema = T.StructType([*DOCUMENT.fields, *[T.StructField(c, T.StringType()) for c in CLASH]])
        full = [r + ("x",) * len(CLASH) for r in full]
    df = spark.createDataFrame(full, schema)
    return df.repartition(partitions) if partitions and full else df


def prose(seed, n, words="the of and a mill river stone light wind house grain bread road bridge cloud".split()):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


def stored(spark, df, path):
    """``df`` as files, so that it is read the same way each time."""
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


#: Nulls, empty and long texts, ties, repeated rows.
HARD = [
    (1, "Alpha beta gamma delta epsilon", "en", "a"), (2, "ALPHA beta gamma delta epsilon", "en", "a"),
    (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "fr", "b"), (None, "Alpha beta gamma delta epsilon", None, "a"),
    (7, "one two three", "en", None), (7, "one two three", "en", None), (7, "one two three", "en", None),
    (8, "Ärger Über Été 4711 !!", "de", "c"), (9, "x" * 5000, "en", "c"),
    (10, prose(1, 6000), "en", "c"), (11, "\n\n\n", "fr", "a"), (-5, "one two three four", "es", "a"),
]
