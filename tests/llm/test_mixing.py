"""The source mix: targets by hand, schedule properties, awkward rows."""

from __future__ import annotations

from collections import defaultdict

import cases
import pytest

from inkloom.llm import mixing


def filled(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Targets by repeated resharing of what capped sources leave."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, budget = {}, set(names), share * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * budget / whole > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * budget / whole for s in free}
        target |= {s: most * sizes[s] for s in over}
        budget -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_targets_equal_repeated_resharing(spark):
    for sizes in ({"a": 100, "b": 900, None: 50}, {"a": 10, "ä": 10, "z": 1000, "Z": 3}, {"x": 0, "y": 7}, {"x": 0}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(filled(sizes))


def words(n: int) -> str:
    return "w " * n


def rows(n=300):
    return [(k, words(k % 90), None, "hot" if k % 3 else f"s{k % 5}", None) for k in range(n)]


def test_schedule_meets_targets_and_never_takes_a_word_three_times(spark):
    docs = cases.frame(spark, rows())
    taken = mixing.taken_words(docs).collect()
    assert sorted(r.doc_id for r in taken) == list(range(300))
    source, got = {r[0]: r[3] for r in rows()}, defaultdict(int)
    for r in taken:
        assert r.size == r.doc_id % 90 and 0 <= r.taken <= 2 * r.size
        got[source[r.doc_id]] += r.taken
    for r in taken:
        assert got[source[r.doc_id]] == pytest.approx(r.target, rel=0.02)
    assert sorted(taken) == sorted(mixing.taken_words(docs.repartition(5)).collect())


def test_schedule_pieces_add_up_and_slots_are_spread(spark):
    docs = cases.frame(spark, rows())
    pieces = mixing.schedule(docs).collect()
    got, uses = defaultdict(int), defaultdict(int)
    for p in pieces:
        got[p.doc_id] += p.words
        for w in range(p.first_word, p.first_word + p.words):
            uses[p.doc_id, w] += 1
    assert dict(got) == {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken}
    assert max(uses.values()) <= 2
    # A source's slots come at its rate in any stretch of the schedule, not in one run.
    slots = sorted({(p.slot, p.s) for p in pieces})
    share = {s: sum(x == s for _, x in slots) / len(slots) for s in {s for _, s in slots}}
    for at in range(0, len(slots) - 100, 100):
        part = slots[at : at + 100]
        assert all(abs(sum(x == s for _, x in part) - 100 * f) < 6 for s, f in share.items())


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    taken = mixing.taken_words(docs).collect()
    assert len(taken) == docs.count()
    assert all(r.taken == 0 for r in taken if r.doc_id in (0, 1, 2))
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "mix_target", "mix_taken"]
    assert all(r.mix_taken > 0 for r in mixed.collect())
    assert mixing.taken_words(cases.frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.taken_words(cases.frame(spark, [(1, None, None, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mixed_rows_of_one_id_have_their_own_words(spark):
    """Rows of one id, of none and alike rows: what each has is what the schedule takes from it."""
    table = [(1, words(1), None, "a", None), (1, words(300), None, "a", None)]
    table += [(None, words(k), None, "b", k) for k in (1, 40, 500)] + [(None, words(2), None, "c", None)]
    table += [(7, words(50), None, "d", None)] * 20 + [(8, None, None, "d", None)]
    docs = cases.frame(spark, table)
    mixed = mixing.mixed(docs).collect()
    assert all(0 < r.mix_taken <= 2 * len(r.text.split()) for r in mixed)
    taken = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.taken_words(docs).collect() if r.taken)
    assert sorted((r.doc_id or -1, len(r.text.split()), r.mix_taken) for r in mixed) == taken
    assert mixing.mixed(cases.frame(spark, [])).count() == 0


def test_schedule_runs_without_python(spark):
    for frame in (mixing.taken_words(cases.frame(spark, rows())), mixing.mixed(cases.frame(spark, rows()))):
        plan = frame._jdf.queryExecution().toString()
        assert not any(name in plan for name in ("Python", "Pandas", "MapInArrow"))
