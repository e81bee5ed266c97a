"""Language ID: held-out accuracy, the order of backing off, awkward rows."""

from __future__ import annotations

import random

import cases
import numpy as np
from pyspark.sql import functions as F

from inkloom.llm import language
from inkloom.llm.common import fold
from inkloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op5_language_id"](spark, SF_DIR).filter("held_out")
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_known_word_goes_before_grams_and_long_grams_before_short():
    logs = lambda *x: np.log(np.array(x))
    model = language.LanguageModel(
        ["a", "b"], {"house": 0}, np.array([logs(0.9, 0.1)]),
        {"<hous": 0, "h": 1, "z": 2}, np.array([logs(0.1, 0.9), logs(0.9, 0.1), logs(0.9, 0.1)]),
    )
    assert model.scores("house", {})[0] == "a"  # its grams say b
    assert model.scores("houses", {})[0] == "b"  # <hous is longer than h
    assert model.scores("zzz", {})[0] == "a"
    assert model.scores("qqq", {}) == ("a", 0.5)  # nothing known: the first of equals
    assert model.scores(None, {}) == model.scores("12 34", {}) == ("und", 0.0)


def test_stage_rejects_what_has_no_language(spark):
    docs = cases.frame(spark)
    out = language.identified(docs)
    assert out.columns == docs.columns
    ids = [r[0] for r in out.collect()]
    assert not {0, 1, 2, 3} & set(ids) and ids.count(5) == 2
    assert set(range(10, 30)) <= set(ids)


def test_nothing_to_learn_from(spark):
    assert language.identified(cases.frame(spark, [])).count() == 0
    rows = [(1, "some text", None, None, None)]
    assert language.identified(cases.frame(spark, rows)).count() == 0


def test_numerals_are_no_letters():
    model = language.LanguageModel(["a", "b"], {"abc": 0}, np.log(np.array([[0.9, 0.1]])), {}, np.zeros((0, 2)))
    assert [model.scores(t, {})[0] for t in ("½ ② ² Ⅷ", "½", "_ 7")] == ["und"] * 3
    assert language.words_of("abc½ x²y Ⅷ") == {"abc": 1, "x": 1, "y": 1}


def invented(rng, letters, words=400):
    return ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(words)]


def test_a_language_of_few_rows_keeps_its_features(spark):
    """Five languages, one of 50 rows against thousands; few features in all."""
    rng = random.Random(3)
    shapes = ["etaoin", "srhldc", "umfpgw", "ybvkxj", "qzetsr"]
    vocabulary = [invented(rng, s) for s in shapes]
    rows, k = [], 0
    for lang, count in enumerate([1500, 1500, 1500, 1500, 50]):
        for _ in range(count):
            rows.append((k, " ".join(rng.choices(vocabulary[lang], k=12)), f"l{lang}", None, None))
            k += 1
    docs = cases.frame(spark, rows, extra=False)
    model = language.fit_languages(docs, max_words=500, max_grams=300)
    held = docs.filter(fold(F.col("doc_id"), 3) == 1).collect()
    for lang in range(5):
        own = [r for r in held if r.lang == f"l{lang}"]
        assert sum(model.scores(r.text, {})[0] == r.lang for r in own) / len(own) > 0.95
    counts = [sum(w in model.words for w in set(v)) for v in vocabulary]
    assert min(counts) >= 80 and len(model.words) <= 500


def test_query_on_awkward_rows(spark, tmp_path):
    cases.frame(spark, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_language_id"](spark, str(tmp_path)).collect()
    assert len(rows) == len(cases.documents()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 5}) == 1
