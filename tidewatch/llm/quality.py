"""Quality scores: document evidence shrunk through hosts and paths by empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import with_row, written
from tidewatch.llm.language_id import held_out

FEATURES = ["log_words", "word_length", "upper", "digits", "marks", "symbols", "stops", "beyond_ascii",
            "distinct_words", "repeated_lines", "line_words", "longest_word", "bare_words"]

# Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 full stops and commas, 5 exclamation
# and question marks, 6 other ASCII signs, 7 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,", 4), (b"!?", 5)):
    for _c in _chars:
        _CLASS[_c] = _kind
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 6
_CLASS[128:] = 7
_BARE = re.compile(rb"(?:^|(?<=\s))[^\s0-9A-Za-z\x80-\xff]+(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Shares and logarithms of a whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(8, np.int64)
    for k in range(0, len(raw), 1 << 22):
        kinds += np.bincount(_CLASS[np.frombuffer(raw, np.uint8, min(1 << 22, len(raw) - k), k)], minlength=8)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    size, n = max(1, int(kinds[1:].sum())), len(words)
    return [np.log1p(n), size / n, kinds[2] / size, kinds[3] / size, kinds[5] / size, kinds[6] / size,
            kinds[4] / size, kinds[7] / size, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))), np.log1p(max(map(len, words))), len(_BARE.findall(raw)) / n]


@dataclass(frozen=True)
class Evidence:
    """A logistic model of the features, and the share of good documents it was fitted to."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Evidence | None:
    """Ridge logistic regression by Newton steps; None unless both classes are there."""
    if len(set(y.tolist())) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        flat = pa.array(found.astype(np.float32).ravel())
        ends = pa.array(np.arange(0, flat.__len__() + 1, len(FEATURES)), pa.int32())
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(ends, flat)],
                                         names=[*names, "x"])


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _posteriors(groups: DataFrame, prior: Column, least: float, most: float) -> DataFrame:
    """``groups`` (good, n) with ``strength`` of their prior, by the method of moments.

    Group means scatter by sampling and by true differences; what is left of their variance after
    the sampling part gives the strength, in documents, with which a group is held at its prior.
    """
    off = (F.col("good") / F.col("n") - prior)
    one = groups.agg(
        F.sum(F.col("n") * off * off).alias("spread"), F.sum(prior * (1 - prior)).alias("noise"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("scale"))
    found = one.first()
    excess = max((found["spread"] - found["noise"]) / found["scale"], 1e-9) if found["scale"] else 1e-9
    return groups.withColumn("strength", F.lit(min(max(1 / excess - 1, least), most)))


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                  max_labelled: int = 20_000, least: float = 1.0, most: float = 10_000.0,
                  threshold: float = 0.5) -> DataFrame:
    """The chance that a document is good, from itself and from where it stands.

    1. Document: shares and counts of the whole text in a logistic model, fitted on at most about
       ``max_labelled`` labelled rows (by hash of doc_id; held-out fifths are not learned from).
    2. Sites: the chances of all documents are summed by host and path. A host's mean is shrunk
       to the mean of all documents, a path's to its host's, the more the fewer documents it
       has; the strengths follow from how much hosts, and paths within them, really differ.
    3. Both: the site's posterior, without the document itself, replaces the global prior in the
       document's odds.

    Returns one row per input row: _row, doc_id, score_document, host_mean, path_mean, quality,
    kept (quality at least ``threshold``). Null hosts and paths are values of their own. A text
    without words has chance 0 and is not kept. Labels that are null or disagree are left out;
    if not both classes are labelled, the document evidence is neutral (0.5). Sums per host are
    taken map-side, so a host with a third of all rows is a few sums.
    """
    keyed = with_row(docs).select("_row", F.col("doc_id").cast("long").alias("doc_id"),
                                  F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    rows = written(keyed.mapInArrow(_extract, "_row long, doc_id long, host string, path string, x array<float>"), "features")
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(
        "doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("doc_id", "y").filter(
        ~held_out(F.col("doc_id")))
    n = judged.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = judged.filter(draw < min(1.0, max_labelled / max(1, n))).join(rows.select("doc_id", "x"), "doc_id")
    sample = chosen.select("doc_id", "x", "y").limit(2 * max_labelled).toArrow().sort_by("doc_id")
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    evidence = fit_evidence(x, np.array(sample.column("y").to_pylist(), np.float64))

    if evidence is None:
        chance = F.lit(0.5)
    else:
        z = F.lit(evidence.bias)
        for i, (m, s, w) in enumerate(zip(evidence.mean, evidence.scale, evidence.weights, strict=True)):
            z = z + (F.element_at("x", i + 1).cast("double") - F.lit(float(m))) * F.lit(float(w / s))
        chance = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))))
    worded = F.element_at("x", 1) > 0
    scored = rows.select("_row", "doc_id", "host", "path", F.when(worded, chance).otherwise(0.0).alias("p"), worded.alias("worded"))

    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    overall = hosts.agg((F.sum("good") / F.sum("n")).alias("prior")).first()["prior"]
    prior = F.lit(0.5 if overall is None else float(overall))
    hosts = _posteriors(hosts, prior, least, most).select(
        F.col("host").alias("h"),
        ((F.col("good") + F.col("strength") * prior) / (F.col("n") + F.col("strength"))).alias("host_mean"))
    hosts = written(hosts, "hosts")
    within = _posteriors(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))), F.col("host_mean"), least, most)
    within = written(within.select(F.col("h"), F.col("path").alias("q"), "good", "n", "strength", "host_mean"), "sites")
    sited = scored.join(within, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    mean = (F.col("good") + F.col("strength") * F.col("host_mean")) / (F.col("n") + F.col("strength"))
    others = (F.col("good") - F.col("p") + F.col("strength") * F.col("host_mean")) / (F.col("n") - 1 + F.col("strength"))
    odds = _logit(F.col("p")) + _logit(others) - _logit(prior)
    quality = F.when(F.col("worded"), 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return sited.select("_row", "doc_id", F.col("p").alias("score_document"), "host_mean", mean.alias("path_mean"),
                        quality.alias("quality"), (quality >= threshold).alias("kept"))
