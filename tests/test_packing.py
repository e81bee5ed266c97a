"""Packing of documents that come in several rows, against the packing of whole texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import packing
from inkloom.operators.chunks import chunks

AWKWARD = [
    "", " ", ". . .", "no end at all", "One. Two! Three?  \n\n\n four.\r\nfive\r\n\r\nsix.", "a." * 60 + " b", "x" * 130,
    "Wait... \"What?\" he said.) Then\t\t\x0b more.\f And\x0b. So \n\n\n\n \n\n!", "word " * 60 + ". Next one. " * 30,
    "  \n\n  " + "lead. " * 50 + "\n" * 90 + "tail", ("long " * 30 + "\n\n" + " " * 80 + "Short. ") * 4,
]


def texts(rng: random.Random) -> list[str]:
    tokens = ["a", "bc", "word", "longer-word", ".", "!", "?", ". ", "! ", "?) ", '." ', " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "é", "x" * 45]
    drawn = ["".join(rng.choices(tokens, k=rng.randrange(250))) for _ in range(25)]
    prose = [" ".join(rng.choices(["alpha", "be", "gamma.", "delta!", "of"], k=400)) for _ in range(4)]
    return AWKWARD + drawn + prose


def parted(rng: random.Random, text: str, most: int) -> list[str]:
    found = []
    while text:
        n = rng.randint(1, most)
        found.append(text[:n])
        text = text[n:]
    return found or [""]


@pytest.mark.parametrize("limit, strict, most", [(40, False, 9), (40, False, 300), (90, False, 40), (0, True, 60), (1, False, 25)])
def test_equals_the_packing_of_whole_texts(spark, monkeypatch, limit, strict, most):
    rng = random.Random(limit + most)
    whole = [(None if not k else k, t) for k, t in enumerate(texts(rng))]
    rows = [(key, n, piece) for key, text in whole for n, piece in enumerate(parted(rng, text, most))]
    rows += [(None, 10**6, None), (900, 0, None), (901, 0, "")]
    rng.shuffle(rows)
    parts = spark.createDataFrame(rows, "doc_id bigint, part bigint, text string")
    got = packing.chunks_of_parts(parts, limit, strict=strict, slab_chars=1)
    wanted = chunks(spark.createDataFrame(whole, "doc_id bigint, text string"), limit, strict=strict)
    assert got.schema.simpleString() == wanted.schema.simpleString()
    tell = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert tell(got) == tell(wanted)


def test_no_rows_and_text_keys(spark):
    shape = "name string, n int, body string, text int"
    names = {"key": "name", "order": "n", "text": "body"}
    assert packing.chunks_of_parts(spark.createDataFrame([], shape), **names).count() == 0
    rows = spark.createDataFrame([("b", 2, "two. Three.", 1), ("b", 1, "One ", 1), ("a", 1, "x", 1)], shape)
    got = packing.chunks_of_parts(rows, 6, **names).orderBy("name", "part_no").collect()
    assert [(r.part_no, r.text) for r in got if r.name == "a"] == [(1, "x")]
    whole = spark.createDataFrame([("b", "One two. Three.")], "name string, body string")
    wanted = chunks(whole, 6, key="name", text="body").orderBy("part_no").collect()
    assert [r.text for r in got if r.name == "b"] == [r.text for r in wanted]


def test_one_document_is_packed_by_many_tasks(spark):
    """A document with all rows: no task sees more of it than a slab and what ends its last chunk."""
    rng = random.Random(5)
    text = " ".join(rng.choices(["alpha", "beta.", "gamma", "delta!", "epsilon"], k=40_000))
    parts = packing.text_parts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 1000)
    assert parts.count() > 200
    slab, limit = 5000, 300
    tasks, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    inner = packing._packed

    def watched(limit, slab_chars, kind, keys, table, entry):
        tasks.add(1)
        if sum(table["_size"].to_pylist()) > slab_chars + 2 * limit:
            seen.add(1)
        return inner(limit, slab_chars, kind, keys, table, entry)

    packing._packed = watched
    try:
        got = packing.chunks_of_parts(parts, limit, slab_chars=slab)
        found = [r.text for r in got.orderBy("part_no").collect()]
    finally:
        packing._packed = inner
    assert tasks.value > len(text) / slab - 1 and seen.value == 0
    whole = chunks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), limit)
    assert found == [r.text for r in whole.orderBy("part_no").collect()]
    assert got.agg(F.max("n_chars")).first()[0] <= limit


def test_short_documents_need_no_slabs(spark):
    """Only documents longer than a row go to the slabs; short ones are packed without a Python group each."""
    rng = random.Random(7)
    lengths = [(k, 20 + 3 * k) for k in range(40)] + [(None, 50), (100, 4000), (101, 3000)]
    whole = [(key, " ".join(rng.choices(["alpha", "beta.", "gamma", "delta!"], k=n))) for key, n in lengths]
    documents = spark.createDataFrame(whole, "doc_id bigint, text string")
    slab, limit = 5000, 300
    groups = spark.sparkContext.accumulator(0)
    inner = packing._packed

    def watched(*given):
        groups.add(1)
        return inner(*given)

    packing._packed = watched
    try:
        got = packing.chunks_of_parts(packing.text_parts(documents, 70), limit, slab_chars=slab).collect()
    finally:
        packing._packed = inner
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, chunks(documents, limit).collect()), key=repr)
    assert 2 <= groups.value <= sum(len(text) // slab + 2 for key, text in whole if key in (100, 101))
