"""Line dedup against a brute-force rewrite, and the perfect hash it stands on."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import cases
import numpy as np
import pytest

from inkloom.llm import line_dedup
from inkloom.llm.perfect_hash import PerfectHash


def key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line))


def brute(rows, min_chars=40, min_docs=5):
    where = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                where[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [
            x for x in lines
            if len(key(x)) < min_chars or len(where[key(x)]) < min_docs or max(where[key(x)]) == doc_id
        ]
        digest = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(stay), digest))
    return sorted(out, key=repr)


def test_equals_brute_force_on_awkward_rows(spark):
    found = line_dedup.dedup_lines(cases.frame(spark))
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert cases.collected(found, *names) == brute(cases.documents())


def test_hot_lines_are_dealt_over_shards(spark, monkeypatch):
    # Forty shards for a few dozen rows: the common line has far more than a shard's share.
    monkeypatch.setattr(line_dedup, "ROWS_A_SHARD", 1)
    found = line_dedup.dedup_lines(cases.frame(spark))
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert cases.collected(found, *names) == brute(cases.documents())


def test_rewritten_table_keeps_rows_and_columns(spark):
    docs = cases.frame(spark)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r[1] or "") for r in out.collect())


def test_empty_table(spark):
    assert line_dedup.dedup_lines(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_survives_bytes(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    own = PerfectHash.from_bytes(*PerfectHash.build(keys).to_bytes())
    assert sorted(own.slots(keys).tolist()) == list(range(len(keys)))
