"""Language ID, licence scan and quality beside plain versions and held-out rows."""

import re
import zlib

import numpy as np
import pytest
from helpers import ASCII, HARD, documents, prose, stored
from pyspark.sql import functions as F

from tidewatch.llm.language_id import Scorer, fit_languages, grams_of, held_out, identify, predict_languages, words_of
from tidewatch.llm.license_scan import Templates, find_spans, scan_licenses
from tidewatch.llm.quality import FEATURES, features, fit_evidence, score_quality

FRENCH = "le la du pain moulin lumière vent maison route pont nuage pierre rivière et des".split()


def held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 0


def mixed(n=120):
    rows = []
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        rows.append((i, prose(i, 20 + i, *([FRENCH] if lang == "fr" else [])), lang, f"s{i % 4}"))
    return rows


# -- language ----------------------------------------------------------------------------------

@pytest.mark.parametrize("clash", [False, True])
def test_languages_of_held_out_rows(spark, tmp_path, clash):
    rows = mixed()
    docs = stored(spark, documents(spark, rows, clash), tmp_path / "d")
    got = {r.doc_id: r for r in identify(docs, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    outside = [r for r in rows if held(r[0])]
    assert outside and all(got[r[0]].lang_pred == r[2] for r in outside)
    assert all(0 <= r.score <= 1 for r in got.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[r[0]] == held(r[0]) for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark, tmp_path):
    rows = mixed()
    wrong = [(d, t, "xx" if held(d) else lang, s) for d, t, lang, s in rows]
    a = identify(stored(spark, documents(spark, rows), tmp_path / "a"), ["doc_id"]).collect()
    b = identify(stored(spark, documents(spark, wrong), tmp_path / "b"), ["doc_id"]).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("clash", [False, True])
def test_languages_of_hard_rows(spark, tmp_path, clash):
    docs = stored(spark, documents(spark, [*HARD, (20, "2² ½ ---", "en")], clash), tmp_path / "d")
    got = identify(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(HARD) + 1
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert lettered or r.score == 0


def test_languages_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "some words", None), (2, None, "en")])
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify(docs, ["doc_id"]).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert identify(documents(spark, []), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        predict_languages(docs.withColumn("score", F.lit(1)), None, ["doc_id", "score"])


def test_scores_are_the_plain_sums(spark, tmp_path):
    docs = stored(spark, documents(spark, mixed(30)), tmp_path / "d")
    model = fit_languages(docs)
    texts = ["Le moulin et la zzrivière", "the windmillish house", "the the le", "", "qq xx"]
    langs, scores = Scorer(model).scores(texts)
    for text, lang, score in zip(texts, langs, scores):
        total = model.prior.copy()
        for word in words_of(text):
            if word in model.words:
                total += model.word_logp[model.words[word]]
                continue
            marked, found = f" {word} ", []
            for i in range(len(marked) - 1):
                for n in range(4, 0, -1):
                    if marked[i:i + n] in model.grams:
                        found.append(model.gram_logp[model.grams[marked[i:i + n]]] + (4 - n) * np.log(0.4))
                        break
            total += np.mean(found, axis=0) if found else 0
        p = np.exp(total - total.max())
        p /= p.sum()
        if text:
            assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-5
        else:
            assert (lang, score) == ("und", 0.0)
    assert grams_of("ab", 2) == [" a", "ab", "b "]
    many = Scorer(model, most=1)
    assert many.scores(texts) == many.scores(texts) == (langs, scores)


def test_model_keeps_the_most_frequent_words(spark, tmp_path):
    docs = stored(spark, documents(spark, mixed(30)), tmp_path / "d")
    full = fit_languages(docs)
    small = fit_languages(docs, max_words=5, max_grams=7)
    assert len(small.words) <= 5 and len(small.grams) <= 4 * 7 and set(small.words) <= set(full.words)


# -- licences ----------------------------------------------------------------------------------

SCAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_scan(text):
    words = SCAN.findall((text or "").translate(ASCII))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (1, "Released under the MIT License. mit-license! MIT\nLICENSE"), (2, "an apache apache license license"),
    (3, "GNU General Public License, General Public Licenses, general public license"), (4, "mitlicense mit  2 license"),
    (5, "the mit"), (6, "license"), (7, None), (7, None), (8, ""), (9, prose(3, 9000) + " mit license " + prose(4, 9000)),
    (None, "MIT license"), (11, "É Apache ẞ apache LICENSE İ mit license"), (12, "mit license " * 500),
]


@pytest.mark.parametrize("clash", [False, True])
def test_base_phrases_beside_brute_force(spark, tmp_path, clash):
    docs = stored(spark, documents(spark, LICENSED, clash), tmp_path / "d")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                  for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted(((i, *plain_scan(t)) for i, t in LICENSED), key=str)
    for r in scan_licenses(docs).collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.labels)


def test_notices_by_their_wording(spark):
    notice = """Redistribution and use, in source and binary forms, with or without modification,
        are permitted provided that the following conditions are met:"""
    words = notice.split()
    rows = [
        (1, prose(1, 50) + " " + notice.upper() + " " + prose(2, 50)),
        (2, prose(1, 50) + " " + " ".join(words[:10] + ["strictly"] + words[10:])),     # the diagonal shifts
        (3, " ".join(words[:8])),                                                       # too little of it
        (4, prose(5, 200)), (5, "Licensed under CC BY-NC 4.0."), (6, notice + " " + prose(3, 30) + " " + notice),
    ]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["bsd", "bsd", "", "", "cc-by-nc", "bsd"]
    assert got[1].score == 1.0 and 0.8 <= got[2].score <= 1 and got[6].n_notices == 2
    spans = find_spans(documents(spark, rows)).filter("doc_id = 1 AND template IS NOT NULL").collect()
    assert [(s.start, s.label) for s in spans] == [(50, "bsd")]


def test_short_notices_one_behind_another_stay_apart(spark):
    notice = "Licensed under CC BY 4.0."
    rows = [(1, " ".join([notice] * 4)), (2, notice + " and " + notice), (3, notice), (4, "CC BY 4.0"),
            (5, " ".join([notice] * 300))]
    spans = find_spans(documents(spark, rows)).filter("label = 'cc-by'").groupBy("doc_id").agg(
        F.sort_array(F.collect_list("start")).alias("starts"))
    got = {r.doc_id: r.starts for r in spans.collect()}
    assert got == {1: [0, 6, 12, 18], 2: [0, 7], 3: [0], 5: list(range(0, 1800, 6))}
    assert {r.doc_id: r.n_notices for r in scan_licenses(documents(spark, rows)).collect()} == {
        1: 4, 2: 2, 3: 1, 4: 0, 5: 300}


def test_templates_and_empty_tables(spark):
    assert scan_licenses(documents(spark, [])).count() == 0
    for wrong in ({"k": 1}, {"k": 6}, {"phrases": [("one", "x")]}):
        with pytest.raises(ValueError):
            Templates.build(**wrong)


# -- quality -----------------------------------------------------------------------------------

def judged_documents(n=200):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 40 + i % 30)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en", f"s{i % 3}"))
        labels.append((i, int(good)))
    return rows, labels


@pytest.mark.parametrize("clash", [False, True])
def test_quality_of_held_out_rows(spark, tmp_path, clash):
    rows, labels = judged_documents()
    docs = stored(spark, documents(spark, rows, clash), tmp_path / "d")
    got = {r.doc_id: r for r in score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == bool(y) for i, y in labels if held(i))


def test_sparse_sites_lean_to_their_parent(spark, tmp_path):
    rows, labels = judged_documents(400)
    rows = [(d, t, "en", "good" if d % 4 else "bad") for d, t, _, _ in rows] + [(900, prose(900, 50), "fr", "bad"), (901, prose(901, 50), "fr", "rare")]
    docs = stored(spark, documents(spark, rows), tmp_path / "d")
    got = {r.doc_id: r for r in score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    overall = np.mean([r.score_document for r in got.values()])
    assert got[4].host_mean < overall < got[1].host_mean          # hosts differ
    assert got[4].host_mean < got[900].path_mean < 1              # one good document moves its path a little
    assert got[901].quality < got[901].score_document + 0.5
    assert got[901].host_mean < got[901].score_document           # a host of one document is shrunk


@pytest.mark.parametrize("clash", [False, True])
def test_quality_of_hard_rows(spark, tmp_path, clash):
    docs = stored(spark, documents(spark, HARD, clash), tmp_path / "d")
    for labels in ([], [(1, 1), (1, 0), (None, 1), (9, None)], [(7, 1), (3, 0), (10, 1), (9, 0), (8, 0)]):
        got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == len(HARD)
        assert all(0 <= r.quality <= 1 and r.kept == (r.quality >= 0.5) for r in got)
        empty = {d for d, t, *_ in HARD if not (t or "").split()}
        assert all(r.quality == 0 and not r.kept for r in got if r.doc_id in empty)
    assert score_quality(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_features_and_the_fit():
    for text in (None, "", " \n"):
        assert features(text) == [0.0] * len(FEATURES)
    found = dict(zip(FEATURES, features("Ab cd! 12, | é\nAb cd! 12, | é")))
    assert found["repeated_lines"] == 0.5 and found["distinct_words"] == 0.5 and found["bare_words"] == 0.2
    x = np.random.default_rng(1).normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(float)
    model = fit_evidence(x, y)
    assert ((model.chance(x) > 0.5) == (y == 1)).mean() > 0.97
    assert fit_evidence(x, np.ones(300)) is None
