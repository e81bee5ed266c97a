"""Decontamination against a plain edit-distance search."""

from __future__ import annotations

import random

import cases
import pytest

from inkloom.llm import decontaminate
from inkloom.llm.decontaminate import Matcher, edit_budget, myers, normal, pattern_bits, pieces

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from a quiet hill at dawn"


def search(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(above[j - 1] + (p != c), above[j] + 1, row[-1] + 1))
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(out)), rng.randrange(3)
        if what == 0:
            out[k] = rng.choice("abcxyz")
        elif what == 1:
            out.insert(k, rng.choice("abcxyz"))
        else:
            del out[k]
    return "".join(out)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 120)))
        assert myers(pattern_bits(pattern), len(pattern), text)[0] == min(len(pattern), search(pattern, text))


def test_every_match_within_the_budget_is_found():
    rng = random.Random(2)
    item, share = normal(ITEM), 0.1
    matcher = Matcher([(7, item)], share)
    budget = edit_budget(len(item), share)
    filler = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50))
    for edits in range(0, budget + 6):
        for _ in range(10):
            text = f"{filler} {edited(rng, item, edits)} {filler}"
            best = search(f" {item} ", f" {normal(text)} ")
            found = matcher.matches(text)
            assert bool(found) == (best <= budget)
            if found:
                assert found[0][:2] == (7, best)


def test_pieces_cover_the_item():
    for n, k in ((1, 0), (5, 9), (81, 4), (394, 19)):
        item = "".join(chr(97 + j % 26) for j in range(n))
        assert "".join(p for _, p in pieces(item, k)) == item


def test_spans_point_into_the_text(spark):
    text = f"Intro?! {ITEM.upper().replace(' ', ' -- ')}... outro"
    docs = cases.frame(spark, [(1, text, None, None, None), (2, "nothing of it", None, None, None), (3, None, None, None, None)])
    bench = spark.createDataFrame([(4, ITEM), (5, None), (None, ITEM), (6, "..."), (8, "absent words here")], "item_id bigint, text string")
    (row,) = decontaminate.contaminated(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.distance) == (1, 4, 0)
    assert normal(text[row.start : row.stop]) == normal(ITEM)
    kept = decontaminate.uncontaminated(docs, bench)
    assert sorted(r[0] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_items_of_null_ids_are_found(spark):
    docs = cases.frame(spark, [(1, f"so {ITEM} it goes", None, None, None), (2, "clean", None, None, None)])
    bench = spark.createDataFrame([(None, ITEM), (8, "absent words here")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]
    assert [r.doc_id for r in decontaminate.uncontaminated(docs, bench).collect()] == [2]


@pytest.mark.parametrize("size", [1, 5000])
def test_blocks_of_items_do_not_change_the_result(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", size)
    docs = cases.frame(spark)
    bench = spark.createDataFrame([(1, cases.FRENCH), (2, cases.ENGLISH), (3, "zz")], "item_id bigint, text string")
    got = cases.collected(decontaminate.contaminated(docs, bench), "doc_id", "item_id")
    wanted = [(k, 2 if k % 2 else 1) for k in range(10, 30)] + [(5, 2), (5, 2)]
    assert got == sorted(wanted, key=repr)
    empty = bench.filter("item_id < 0")
    assert decontaminate.contaminated(docs, empty).count() == 0
    assert decontaminate.uncontaminated(docs, empty).count() == docs.count()


@pytest.mark.parametrize("kept", [1, 4])
def test_many_items_are_one_scan(spark, monkeypatch, kept):
    """20,000 items in five blocks, of which fewer are held at once: all are found, in one scan."""
    monkeypatch.setattr(decontaminate, "BLOCKS_KEPT", kept)
    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randrange(10**6)}" for _ in range(8))) for k in range(20_001)]
    texts = [f"before {items[k][1]} between {items[-1 - k][1]} after" for k in range(0, 10_000, 500)]
    docs = cases.frame(spark, [(k, t, None, None, None) for k, t in enumerate([*texts, "clean"])])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench)
    wanted = sorted((k, i) for k in range(20) for i in (500 * k, 20_000 - 500 * k))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == wanted
    assert found._jdf.queryExecution().optimizedPlan().toString().count("find(") == 1
    assert [r.doc_id for r in decontaminate.uncontaminated(docs, bench).collect()] == [20]


def test_short_items_are_whole_words(spark):
    texts = ["a party of eyes", "the art of it", "yes", "Say: YES!", "smart", "art", "no art, yes", "partial art-y yesterday"]
    docs = cases.frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, "art"), (2, "Yes"), (3, "of it")], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 3), (2, 2), (3, 2), (5, 1), (6, 1), (6, 2), (7, 1)]
    assert all(r.distance == 0 and normal(texts[r.doc_id][r.start : r.stop]) in ("art", "yes", "of it") for r in found)
    assert sorted(r.doc_id for r in decontaminate.uncontaminated(docs, bench).collect()) == [0, 4]


def test_no_documents(spark):
    bench = spark.createDataFrame([(1, "art")], "item_id bigint, text string")
    docs = cases.frame(spark, [])
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.uncontaminated(docs, bench).count() == 0


def test_items_of_every_length_against_the_table():
    """Random items of 1 to 60 characters in random texts: found if and only if within the budget."""
    rng = random.Random(9)
    for _ in range(300):
        item = normal(" ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))))
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(30))
        if rng.random() < 0.6:
            text = f"{text} {edited(rng, item, rng.randint(0, 3))} {text}"
        best = search(f" {item} ", f" {normal(text)} ")
        found = Matcher([(1, item)], 0.1).matches(text)
        assert bool(found) == (best <= edit_budget(len(item), 0.1))
        assert not found or found[0][1] == best
