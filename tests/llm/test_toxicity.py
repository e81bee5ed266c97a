"""Toxicity: held-out accuracy, an interaction that no sum can tell, awkward rows."""

from __future__ import annotations

import cases
import numpy as np

from inkloom.llm import toxicity
from inkloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic is not null")
    rows = QUERIES["op10_toxicity"](spark, SF_DIR).filter("held_out").join(labels, "doc_id").collect()
    hits = [r.predicted == r.toxic for r in rows]
    marked = [r.predicted for r in rows if r.toxic]
    assert len(rows) > 500 and sum(hits) / len(hits) > 0.95 and sum(marked) / len(marked) > 0.8


def test_pairs_are_learned_that_single_weights_cannot_tell():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, on in ((1, a), (2, b)) if on] + [3 + int(rng.integers(0, 20))], np.int32))
        labels.append(float(a == b == 1 or (a == 0 and b == 0)))
    model = toxicity.FactorizationMachine.blank(5, 4)
    model.chosen[:] = True
    model.fit(rows, np.array(labels), epochs=30, rate=0.1, penalty=1e-4, seed=1)
    right = [(model.score(r) >= 0.5) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert sum(right) / len(right) > 0.95


def fitted(rows, labels):
    model = toxicity.FactorizationMachine.blank(10, 4)
    model.choose(rows, labels, min_rows=3, min_z=4.0)
    model.fit(rows, labels, epochs=8, rate=0.1, penalty=1e-4, seed=1)
    return model


def test_pairs_of_words_alike_in_both_labels_are_learned():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, on in ((1, a), (2, b)) if on] + list(3 + rng.choice(300, 25)), np.int32))
        labels.append(float(a == b))
    rows, labels = [np.unique(r) for r in rows], np.array(labels)
    model = fitted(rows[:2400], labels[:2400])
    right = [(model.score(r) >= 0.5) == bool(y) for r, y in zip(rows[2400:], labels[2400:], strict=True)]
    assert sum(right) / len(right) > 0.9


def test_an_insult_of_few_toxic_rows_counts():
    rng = np.random.default_rng(6)
    rows = [np.unique(10 + rng.choice(300, 10)).astype(np.int32) for _ in range(1200)]
    labels = np.array([float(k % 2) for k in range(1200)])
    for k in range(1, 21, 2):
        rows[k] = np.append(np.int32(1), rows[k])
    model = fitted(rows, labels)
    plain = rows[500:700]
    with_it = [model.score(np.append(np.int32(1), r)) for r in plain]
    assert np.mean([a > model.score(r) for a, r in zip(with_it, plain, strict=True)]) == 1.0
    assert model.linear[1] * model.scale[1] > 0.2


def test_long_training_texts_are_read_whole(spark):
    filler = [f"w{k}" for k in range(3000)]
    # The word of highest hash is the one that tells.
    filler.sort(key=lambda w: toxicity.terms_of(w, 18)[0])
    told = filler.pop()
    rows = [(k, " ".join([*filler, *([told] if k % 2 else [])])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    at = toxicity.terms_of(told, 18)[0]
    assert model.chosen[at] and model.linear[at] > 0.2


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame(
        [(k, 1, int(k % 2)) for k in range(10, 30)] + [(5, None, None), (10, 1, 1), (None, 1, 1), (999, 0, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    model = toxicity.fit_toxicity(docs, labels)
    plain = cases.frame(spark, extra=False)
    rows = plain.select("doc_id", toxicity.toxicity_of(spark, model)("text").alias("s")).collect()
    assert len(rows) == plain.count() and all(0 <= r.s <= 1 for r in rows)
    empty = toxicity.fit_toxicity(docs, labels.filter("doc_id < 0"))
    assert {r.s for r in plain.select(toxicity.toxicity_of(spark, empty)("text").alias("s")).collect()} == {0.5}
    assert toxicity.fit_toxicity(cases.frame(spark, []), labels).bias == 0.0


def test_the_bound_is_on_rows_not_on_ids(spark):
    """One doc_id with 3,000 texts, and one text 3,000 times, leave the sample near its bound."""
    rows = [(1, f"text {k} of the hot one") for k in range(3000)] + [(2, "the same text")] * 3000
    rows += [(k, f"own text {k}") for k in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id bigint, toxic int")
    drawn = toxicity.training_rows(docs, labels, folds=1, held_out=1, max_rows=400).collect()
    # All 99 clean rows, the one text of id 2 among them, and about 200 of 3,098 toxic ones.
    assert len({(r.doc_id, r.text) for r in drawn}) == len(drawn)
    assert sum(r.toxic == 0 for r in drawn) == 99
    assert 150 < sum(r.toxic == 1 for r in drawn) < 250
