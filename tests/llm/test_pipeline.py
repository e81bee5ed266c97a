"""The pipeline over the smallest tables, stage by stage against brute force."""

from __future__ import annotations

import pytest

import corpus_pipeline
from inkloom.llm.decontaminate import normal
from inkloom.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF_DIR)))
    return out


def test_stages_keep_columns_and_rows_of_the_input(stages):
    assert len(stages) == 6
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == COLUMNS
        old, new = ({r.doc_id for r in x.collect()} for x in (before, after))
        assert new and new <= old
    assert stages[2].count() == stages[1].count()  # line dedup drops lines, not documents


def test_no_item_is_left_and_clean_documents_stay(spark, stages):
    items = [normal(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages[4].collect()}
    for row in stages[3].collect():
        assert (row.doc_id in left) == (not any(i in normal(row.text) for i in items))


def test_mix_takes_no_more_than_twice(stages):
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert rows and all(0 < r.mix_taken <= 2 * len(text[r.doc_id].split()) for r in rows)
    assert sum(r.mix_taken for r in rows) == pytest.approx(1.5 * sum(len(t.split()) for t in text.values()), rel=0.03)


def test_run_is_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(stages[5].collect())
