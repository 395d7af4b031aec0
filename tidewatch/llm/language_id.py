"""Language identification: known words first, character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: Letters in a row, after lower-casing.
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities per language. Sizes are bounded by the parameters of ``fit_languages``."""

    languages: list[str]
    prior: np.ndarray                   # languages
    words: dict[str, int]               # row of ``word_logp``
    word_logp: np.ndarray
    grams: dict[str, int]               # row of ``gram_logp``, all lengths
    gram_logp: np.ndarray
    longest: int

    def packed(self) -> "PackedModel":
        """The model as arrays by the items' hashes: what is broadcast, and held by each worker."""
        words = np.fromiter(map(_word_key, self.words), np.uint64, len(self.words))
        order = np.argsort(words)
        rows = np.fromiter(self.words.values(), np.int64, len(words))[order]
        keys, logp = [], []
        for length in range(1, self.longest + 1):
            own = [gram for gram in self.grams if len(gram) == length]
            found = np.array([_gram_keys(_points(gram), length)[0] for gram in own], np.uint64)
            by_key = np.argsort(found)
            keys.append(found[by_key])
            logp.append(self.gram_logp[[self.grams[gram] for gram in own]].reshape(len(own), -1)[by_key])
        return PackedModel(self.languages, self.prior, words[order], self.word_logp[rows], keys, logp)


@dataclass(frozen=True)
class PackedModel:
    """Sorted 64-bit hashes of words and of n-grams by length, and their log probabilities."""

    languages: list[str]
    prior: np.ndarray
    words: np.ndarray
    word_logp: np.ndarray
    grams: list[np.ndarray]
    gram_logp: list[np.ndarray]


def _word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_keys(points: np.ndarray, length: int) -> np.ndarray:
    """A hash of the n-gram that begins at each place and ends within ``points``."""
    keys = np.zeros(max(0, len(points) - length + 1), np.uint64)
    for k in range(length):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + points[k:k + len(keys)] + np.uint64(1)
    return keys


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted ``keys``; -1: nowhere."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def held_out(key: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def grams_of(word: str, length: int) -> list[str]:
    marked = f" {word} "
    return [marked[i:i + length] for i in range(len(marked) - length + 1)]


def _count_words(most: int):
    """Words per language within a task; a full counter is passed on, so memory is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, counter in counts.items():
                words = list(counter)
                for k in range(0, len(words), 1 << 16):
                    part = words[k:k + (1 << 16)]
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()),
                                           pa.array(part, pa.string()),
                                           pa.array([counter[w] for w in part], pa.int64())],
                                          names=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > most:
                yield from flush()
                counts = {}
        yield from flush()

    return count


def _table(rows: list, languages: list[str], smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """Rows (item, {lang: n}) as log frequencies per language."""
    where = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(rows), len(languages)))
    for i, (_, by_lang) in enumerate(rows):
        for lang, n in by_lang.items():
            counts[i, where[lang]] = n
    logp = np.log(counts + smooth) - np.log(counts.sum(axis=0) + smooth * max(1, len(rows)))
    return {row[0]: i for i, row in enumerate(rows)}, logp.astype(np.float32)


def fit_languages(docs: DataFrame, max_documents: int = 20_000, max_words: int = 200_000,
                  max_grams: int = 40_000, longest: int = 4, smooth: float = 0.5,
                  task_words: int = 100_000, max_languages: int = 1000) -> LanguageModel | None:
    """Words and n-grams of rows of ``docs`` (doc_id, text, lang) whose text and lang are not null.

    The model is fitted on a sample of about ``max_documents`` rows by a hash of doc_id: half of
    them in equal shares per language, so that a rare one is learned too, half in proportion. Words
    are counted in each task and summed by Spark. It keeps the ``max_words`` most frequent words
    (of those that tie at the border some, by hash) and, for each length up to ``longest``, the
    ``max_grams`` most frequent n-grams of those words, a word counting by the number of binary
    digits of its count. These bounds, times the number of languages (the ``max_languages`` with
    most rows), are what comes to the driver and is broadcast; other words are the unseen ones that
    back off. No rows: None.
    """
    docs = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    totals = sorted((r["lang"], r["n"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(max_languages).collect())
    if not totals:
        return None
    languages, rows = [lang for lang, _ in totals], sum(n for _, n in totals)
    prior = np.log(np.array([n for _, n in totals], float) / rows)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for lang, n in totals for x in (
        lang, min(1.0, max_documents * (0.5 / rows + 0.5 / len(languages) / n)))])
    # A language beyond the bound has no share.
    sample = docs.filter(draw < F.element_at(shares, F.col("lang")) if rows > max_documents else F.col("lang").isin(languages))
    counted = written(sample.select("text", "lang").mapInArrow(_count_words(task_words), "lang string, word string, n long")
                      .groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    words = _most_frequent(counted, max_words)
    index, logp = _table(words, languages, smooth)
    grams, gram_logp = {}, []
    for length in range(1, longest + 1):
        counts: dict[str, Counter] = {}
        for word, by_lang in words:
            for gram in grams_of(word, length):
                own = counts.setdefault(gram, Counter())
                for lang, n in by_lang.items():
                    own[lang] += n.bit_length()
        best = sorted(counts.items(), key=lambda item: (-sum(item[1].values()), item[0]))[:max_grams]
        rows_of, table = _table(best, languages, smooth)
        grams |= {gram: len(grams) + i for gram, i in rows_of.items()}
        gram_logp.append(table)
    return LanguageModel(languages, prior, index, logp, grams, np.concatenate(gram_logp), longest)


def _most_frequent(counts: DataFrame, most: int) -> list:
    """(word, {lang: n}) of the ``most`` most frequent words, those that tie at the border by hash.

    A histogram of the totals tells the border, so words need no global sort.
    """
    totals = written(counts.groupBy("word").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")), "lang-totals")
    down = Window.orderBy(F.desc("total"))
    histogram = totals.groupBy("total").agg(F.count("*").alias("words")).withColumn("upto", F.sum("words").over(down))
    border = histogram.filter(F.col("upto") > most).orderBy(F.desc("total")).first()
    if border is None:
        kept = totals
    else:
        ties = totals.filter(F.col("total") == border["total"]).orderBy(F.xxhash64("word"), "word").limit(
            most - (border["upto"] - border["words"]))
        kept = totals.filter(F.col("total") > border["total"]).unionByName(ties)
    return sorted((r["word"], r["by"]) for r in kept.select("word", "by").collect())


class Scorer:
    """Evidence of texts, by the distinct words of a batch; nothing is kept from batch to batch."""

    def __init__(self, model: LanguageModel | PackedModel, most: int = 50_000, backoff: float = 0.4):
        self.model = model if isinstance(model, PackedModel) else model.packed()
        self.most, self.penalty = most, np.log(backoff)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean over a word's places of the longest known n-gram that begins there.

        Every step to a shorter n-gram costs the log of the back-off factor, as in stupid
        back-off. A word with no known n-gram says nothing.
        """
        model, longest = self.model, len(self.model.grams)
        points = _points(" " + " ".join(words) + " ")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)                     # the space behind each word
        owner = np.repeat(np.arange(len(words)), sizes)
        places = np.arange(len(owner))              # a word's places: the space ahead and its letters
        open_ = np.ones(len(places), bool)
        sums, found = np.zeros((len(words), len(model.languages))), np.zeros(len(words), np.int64)
        for n in range(longest, 0, -1):
            at = places[open_ & (places + n - 1 <= ends[owner])]
            row = _places(model.grams[n - 1], _gram_keys(points, n)[at])
            hit = row >= 0
            at, row = at[hit], row[hit]
            open_[at] = False
            evidence = model.gram_logp[n - 1][row] + self.penalty * (longest - n)
            found += np.bincount(owner[at], minlength=len(words))
            for lang in range(len(model.languages)):
                sums[:, lang] += np.bincount(owner[at], evidence[:, lang], minlength=len(words))
        return sums / np.maximum(found, 1)[:, None]

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log probabilities per language of each word."""
        model = self.model
        row = _places(model.words, np.fromiter(map(_word_key, words), np.uint64, len(words)))
        out = np.empty((len(words), len(model.languages)))
        known = row >= 0
        out[known] = model.word_logp[row[known]]
        rest = np.flatnonzero(~known)
        for k in range(0, len(rest), self.most):
            part = rest[k:k + self.most]
            out[part] = self.unseen([words[i] for i in part])
        return out

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, ends = [], []
        for text in texts:
            words += words_of(text or "")
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # A word of digits and marks that count as word characters may hold no letter.
        letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
        word, stops = coded.indices.to_numpy(), np.array(ends, np.int64)
        by_word = self.evidence(distinct)
        lettered = np.append(0, np.cumsum(letters[word]))
        total = np.empty((len(texts), by_word.shape[1]))
        starts = np.append(0, stops[:-1])
        for lang in range(by_word.shape[1]):
            sums = np.append(0.0, np.cumsum(by_word[word, lang]))
            total[:, lang] = sums[stops] - sums[starts] + self.model.prior[lang]
        total -= total.max(axis=1, keepdims=True)
        chance = np.exp(total)
        best = chance.argmax(axis=1)
        score = chance.max(axis=1) / chance.sum(axis=1)
        told = lettered[stops] > lettered[starts]
        return ([self.model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), told.tolist(), strict=True)],
                np.where(told, score, 0.0).tolist())


def predict_languages(docs: DataFrame, model: LanguageModel | None, keep: list[str],
                      names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score (0 to 1), or ``names``, of every whole text.

    Evidence of a text is the prior plus, for each word, its log frequency per language; unseen
    words use n-grams. The score is the posterior of the language predicted. Ties go to the
    language that sorts first. A text that is null or has no letter, or any text when nothing was
    learned: ``und`` with score 0.
    """
    clash = set(names) & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.packed())
    extra = [] if "text" in keep else ["text"]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                langs, scores = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, *names])

    return docs.select(*keep, *extra).mapInArrow(predict, schema)


def identify(docs: DataFrame, keep: list[str], names: tuple[str, str] = ("lang_pred", "score"),
             **settings) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows of ``docs``."""
    learned = docs.filter(~held_out(F.col("doc_id")))
    return predict_languages(docs, fit_languages(learned, **settings), keep, names)
