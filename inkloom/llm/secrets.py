"""Secret scans: patterns for known shapes, and two character Markov models for the rest.

One model is trained on strings labelled random, the other on strings labelled ordinary; both are
first order over the token alphabet. A token whose mean log-likelihood ratio per character is
high looks random and becomes a span of its own. Labelled random are the values that the patterns
find and strings drawn evenly from the alphabets that keys are written in; labelled ordinary are
the other words of the texts. Both come from a bounded sample.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.common import pick
from inkloom.session import cut_lineage

# The patterns of known shapes and the least length of each.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

#: What can be a secret without a known shape.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Fewer different characters are a rule or a pattern, not a drawn string.
MIN_DISTINCT = 8
KINDS = ("assign", "access", "hex", "markov")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the known shapes, leftmost and non-overlapping within a kind; ends exclusive.

    A hex run is as long as it can be, so its least length can stand in the pattern. An assigned
    value that is too short still uses up its text, so there it is checked after the match.
    """
    spans: list[Span] = []
    # A plain search for the names is ten times cheaper than the pattern.
    lower = text.lower()
    if any(name in lower for name in ASSIGN_NAMES):
        spans += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        spans += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_CHARS
        ]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@dataclass
class RandomnessModel:
    """Log-likelihood ratio, random over ordinary, of each first character and each pair."""

    first: np.ndarray
    pairs: np.ndarray
    threshold: float = 0.5

    def ratio(self, token: str) -> float:
        """Mean log-likelihood ratio per character of an ASCII token."""
        codes = np.frombuffer(token.encode("ascii"), np.uint8)
        total = self.first[codes[0]] + self.pairs[codes[:-1], codes[1:]].sum()
        return float(total) / len(codes)

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Tokens that look random and do not overlap a span that is there already."""
        found = []
        starts = [a for _, a, _ in taken]
        reach = list(accumulate((b for _, _, b in taken), max))
        for m in TOKEN.finditer(text):
            start, end = m.span()
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            token = m.group()
            if len(set(token)) >= MIN_DISTINCT and self.ratio(token) > self.threshold:
                found.append(("markov", start, end))
        return found


def trained(random: list[str], ordinary: list[str], threshold: float = 0.5) -> RandomnessModel:
    """Counts of firsts and pairs of each label, plus one half, as log ratios.

    Labels without samples leave a flat model, and two flat models a ratio of zero everywhere.
    """

    def logs(samples: list[str]) -> tuple[np.ndarray, np.ndarray]:
        first, pairs = np.full(128, 0.5), np.full((128, 128), 0.5)
        for sample in samples:
            codes = np.frombuffer(sample.encode("ascii"), np.uint8)
            if len(codes):
                first[codes[0]] += 1
                np.add.at(pairs, (codes[:-1], codes[1:]), 1)
        return np.log(first / first.sum()), np.log(pairs / pairs.sum(axis=1, keepdims=True))

    first_r, pairs_r = logs(random)
    first_o, pairs_o = logs(ordinary)
    return RandomnessModel(first_r - first_o, pairs_r - pairs_o, threshold)


def drawn_strings(count: int, seed: int = 5) -> list[str]:
    """Labelled random samples: 32 characters each, of base 64, base 62 and base 36 in turn."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (lower + lower.upper() + digits + "+/", lower + lower.upper() + digits, lower + digits)
    rng = np.random.default_rng(seed)
    return [
        "".join(alphabets[k % 3][c] for c in rng.integers(0, len(alphabets[k % 3]), 32))
        for k in range(count)
    ]


def values_of(text: str) -> list[str]:
    """What the patterns hold for secret in a text, without the key's name."""
    found = [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    found += [m.group() for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    return found + [m.group() for m in HEX.finditer(text)]


def fit_randomness(
    docs: DataFrame, *, max_docs: int = 10_000, max_samples: int = 20_000, drawn: int = 6_000,
    threshold: float = 0.5,
) -> RandomnessModel:
    """A model from samples labelled by the patterns, out of about ``max_docs`` texts.

    The texts are chosen by a hash; of either label the ``max_samples`` samples of smallest hash
    are used. Ordinary samples are words outside all spans that two of the chosen texts have at
    least, as a secret in one text is no ordinary word.
    """
    rows = pick(docs, doc_id="bigint", text="string").filter(F.col("text").isNotNull())
    share = min(1.0, max_docs / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1e6)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                text = text.as_py()
                at, plain = 0, []
                for _, start, end in base_spans(text):
                    plain.append(text[at:start])
                    at = max(at, end)
                plain.append(text[at:])
                seen.update({(value, True) for value in values_of(text)})
                seen.update({(word, False) for part in plain for word in WORD.findall(part)})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in seen], pa.string()),
                    pa.array([r for _, r in seen], pa.bool_()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["sample", "random", "texts"],
            )

    samples = cut_lineage(
        rows.filter(draw < share)
        .select("text")
        .mapInArrow(labelled, "sample string, random boolean, texts bigint")
        .groupBy("sample", "random")
        .agg(F.sum("texts").alias("texts"))
        .filter(F.col("random") | (F.col("texts") > 1))
    )

    def some(random: bool) -> list[str]:
        own = samples.filter(F.col("random") == random)
        return [r["sample"] for r in own.orderBy(F.xxhash64("sample"), "sample").limit(max_samples).collect()]

    return trained(some(True) + drawn_strings(drawn), some(False), threshold)


def secrets_of(spark: SparkSession, model: RandomnessModel):
    """Arrow function text -> (n_assign, n_access, n_hex, base_sha256, spans)."""
    shared = spark.sparkContext.broadcast(model)
    numbers = ("n_assign", "n_access", "n_hex")

    @F.arrow_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def scan(texts: pa.Array) -> pa.Array:
        columns: dict[str, list] = {name: [] for name in (*numbers, "base_sha256", "spans")}
        for text in texts:
            text = text.as_py() or ""
            base = base_spans(text)
            for name, kind in zip(numbers, KINDS, strict=False):
                columns[name].append(sum(1 for s in base if s[0] == kind))
            columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns["spans"].append(joined(ordered(base + shared.value.spans(text, base))))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)],
            names=list(columns),
        )

    return scan


def secrets(docs: DataFrame, model: RandomnessModel | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    Spans are kind:start:end in code points, by start and then by kind. Null or empty text: no
    spans. Null doc_id, repeated rows: a result each. Very long texts are scanned whole, once a
    pattern. Empty table: no rows.
    """
    spark = docs.sparkSession
    scan = secrets_of(spark, model or fit_randomness(docs))
    rows = pick(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")
