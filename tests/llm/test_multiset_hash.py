"""Fingerprints: order, insertion and deletion, likeness, edits of neighbours."""

from __future__ import annotations

import hashlib
import random

import cases
from pyspark.sql import functions as F

from inkloom.llm import multiset_hash as mh


def summed(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sums = frame.select("id", mh.multiset_sum(mh.numbers_of(mh.units_of(F.col("t")))).alias("s"))
    return sums


def prints(sums):
    return [r.p for r in sums.select("id", mh.fingerprint(F.col("s")).alias("p")).orderBy("id").collect()]


def sentences(rng, n):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 6))) + "." for _ in range(n)]


def test_order_of_paragraphs_does_not_matter_and_content_does(spark):
    own = sentences(random.Random(1), 40)
    turned = own[::-1]
    got = prints(summed(spark, ["\n".join(own), "\n".join(turned), "\n".join(own[:-1]), "\n".join([*own, own[0]]), "", None, " \n\t"]))
    assert got[0] == got[1] and len({*got}) == 4 and got[4] == got[5] == got[6]


def test_insertion_and_deletion(spark):
    own = sentences(random.Random(2), 30)
    sums = summed(spark, ["\n".join(own[:20]), "\n".join(own[20:]), "\n".join(own)])
    a, b, whole = (sums.filter(f"id = {k}").select(F.col("s").alias(f"s{k}")) for k in range(3))
    row = a.crossJoin(b).crossJoin(whole).select(
        mh.fingerprint(mh.combined(F.col("s0"), F.col("s1"))).alias("both"),
        mh.fingerprint(F.col("s2")).alias("whole"),
        mh.combined(F.col("s2"), F.col("s1"), -1).alias("left"),
        F.col("s0").alias("first"),
    ).first()
    assert row.both == row.whole
    # A lane that units left again may stay as a zero.
    assert [x for x in row.left.bins if x % 65536] == [x for x in row.first.bins if x % 65536]
    assert (row.left.n, row.left.dense) == (row.first.n, row.first.dense)


def test_likeness_follows_the_share_of_equal_units(spark):
    rng = random.Random(3)
    for n in (20, 300, 4000):
        own, others = sentences(rng, n), sentences(rng, n)
        shares = (0.0, 0.25, 0.75, 0.95, 1.0)
        texts = ["\n".join(own)] + ["\n".join(own[: int(n * s)] + others[int(n * s) :]) for s in shares]
        sums = summed(spark, texts)
        first = sums.filter("id = 0").select(F.col("s").alias("a"))
        rows = sums.filter("id > 0").crossJoin(first)
        got = [r.l for r in rows.select("id", mh.likeness(F.col("a"), F.col("s")).alias("l")).orderBy("id").collect()]
        assert got[-1] == 1.0 and got[0] < 0.35
        assert all(abs(g - s) < 0.3 for g, s in zip(got, shares, strict=True)), (n, got)


def test_likeness_of_very_long_texts(spark):
    rng = random.Random(4)
    n = 200_000
    own, others = ([f"{side}{k} {k % 97} a b." for k in range(n)] for side in "xy")
    texts = [own, others, own[: n * 3 // 4] + others[n * 3 // 4 :], sentences(rng, 50)]
    sums = summed(spark, ["\n".join(t) for t in texts])
    first = sums.filter("id = 0").select(F.col("s").alias("a"))
    near = mh.likeness(F.col("a"), F.col("s")).alias("l")
    got = [r.l for r in sums.filter("id > 0").crossJoin(first).orderBy("id").select(near).collect()]
    assert all(abs(g - wanted) < 0.1 for g, wanted in zip(got, (0, 0.75, 0), strict=True)), got


def test_sums_of_parts_and_edits_are_those_of_the_texts(spark):
    rng = random.Random(5)
    docs = []
    for k in range(60):
        own = [x + rng.choice(["\n", " ", "\n\n", "\t", "  "]) for x in sentences(rng, rng.randrange(30))]
        docs.append((k, "".join(own).replace(".", rng.choice([".", "", "!", "é."])), None, None, None))
    found = {r.doc_id: r for r in mh.with_edits(cases.frame(spark, docs)).collect()}
    texts = [t for _, t, *_ in docs]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % 60][: len(t) // 4] for k, t in enumerate(texts)]
    whole = prints(summed(spark, texts + edited))
    assert [found[k].fingerprint for k in range(60)] == whole[:60]
    assert [found[k].edited_fingerprint for k in range(60)] == whole[60:]


def test_edits_of_awkward_rows(spark):
    rows = cases.documents()
    found = mh.with_edits(cases.frame(spark)).collect()
    assert len(found) == len(rows)
    distinct = {}
    for doc_id, text, *_ in rows:
        distinct.setdefault((doc_id, text or ""), None)
    order = sorted(distinct, key=lambda k: (k[0] is not None, k[0] or 0))
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    wanted = []
    for doc_id, text, *_ in rows:
        text = text or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[doc_id, text][1][:q]
        wanted.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(wanted, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert mh.with_edits(cases.frame(spark, [])).count() == 0


def test_documents_in_range_partitions_find_the_next_one(spark):
    rows = [(k * 37 % 101, f"text of {k * 37 % 101} " * 5, None, None, None) for k in range(101)]
    found = {r.doc_id: r.edited_sha256 for r in mh.with_edits(cases.frame(spark, rows).repartition(7)).collect()}
    text = {r[0]: r[1] for r in rows}
    for k, t in text.items():
        edited = t[: len(t) - len(t) // 4] + text[(k + 1) % 101][: len(t) // 4]
        assert found[k] == hashlib.sha256(edited.encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = mh.with_edits(cases.frame(spark, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
