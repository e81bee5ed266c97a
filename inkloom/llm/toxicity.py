"""Toxicity by a factorization machine over hashed terms.

    score = sigmoid(w0 + sum_i s_i w_i x_i + 1/2n sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))

x_i is 1 if the text has a word with hash i, else 0, and n is how many it has. The factors v learn
which words count together, such as an insult beside a group's name, that no sum of single
weights can tell.

Every term in ``min_rows`` training rows has a weight and factors. s_i = z^2 / (z^2 + min_z^2)
scales a weight by the z standard errors its document frequency differs by between the labels:
among so many rare words unscaled weights would be learned by heart. Factors are not scaled, as
words that count only together differ little each on its own. It is fitted in one task
on a bounded sample of labelled rows (``max_rows``); training and scoring read every text whole, and the model's size is fixed by ``bits`` and ``factors``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.common import fold, pick
from inkloom.session import cut_lineage

WORD = re.compile(r"[^\W_]+")


def terms_of(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased words."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int32)
    codes = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(words)]
    return np.unique(np.array(codes, np.int64) & ((1 << bits) - 1)).astype(np.int32)


@dataclass
class FactorizationMachine:
    """Bias, linear weights, their scales and factors, and which terms have them."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    chosen: np.ndarray
    scale: np.ndarray

    @classmethod
    def blank(cls, bits: int, factors: int) -> FactorizationMachine:
        n = 1 << bits
        return cls(
            0.0, np.zeros(n, np.float32), np.zeros((n, factors), np.float32), np.zeros(n, bool),
            np.ones(n, np.float32),
        )

    def margin(self, terms: np.ndarray) -> float:
        """Of terms that are all chosen ones."""
        rows = self.factors[terms]
        total = rows.sum(axis=0)
        pairs = (total @ total - (rows * rows).sum()) / (2 * max(1, len(terms)))
        return self.bias + float(self.linear[terms] @ self.scale[terms] + pairs)

    def score(self, terms: np.ndarray) -> float:
        margin = self.margin(terms[self.chosen[terms]])
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60))))

    def choose(self, rows: list[np.ndarray], labels: np.ndarray, min_rows: int, min_z: float) -> None:
        """Terms in ``min_rows`` rows, scaled by how unlike a draw from all rows the rows with
        label 1 are."""
        size, n, ones = len(self.chosen), len(rows), labels.sum()
        every = np.bincount(np.concatenate(rows), minlength=size)
        marked = [r for r, y in zip(rows, labels, strict=True) if y]
        toxic = np.bincount(np.concatenate([*marked, np.zeros(0, np.int32)]), minlength=size)
        share = every / n
        error = np.sqrt(np.maximum(1e-9, ones * (n - ones) / n * share * (1 - share)))
        self.chosen = every >= min_rows
        z2 = ((toxic - ones * share) / error) ** 2
        self.scale = (z2 / np.maximum(1e-9, z2 + min_z * min_z)).astype(np.float32)

    def fit(
        self, rows: list[np.ndarray], labels: np.ndarray, *, epochs: int, rate: float,
        penalty: float, seed: int,
    ) -> None:
        """AdaGrad over the rows in a seeded order; both labels weigh the same in sum."""
        rng = np.random.default_rng(seed)
        self.factors = rng.normal(0, 0.02, self.factors.shape).astype(np.float32)
        n, ones = len(labels), max(1, int(labels.sum()))
        weight = np.where(labels == 1, n / (2 * ones), n / (2 * max(1, n - ones)))
        rows = [terms[self.chosen[terms]] for terms in rows]
        g_bias, g_linear = 1.0, np.ones(self.linear.shape)
        g_factors = np.ones(self.factors.shape)
        for _ in range(epochs):
            for k in rng.permutation(n).tolist():
                terms = rows[k]
                error = (self.score(terms) - labels[k]) * weight[k]
                g_bias += error * error
                self.bias -= rate * error / np.sqrt(g_bias)
                slope = error * self.scale[terms] + penalty * self.linear[terms]
                g_linear[terms] += slope * slope
                self.linear[terms] -= rate * slope / np.sqrt(g_linear[terms])
                own = self.factors[terms]
                slope = error / max(1, len(terms)) * (own.sum(axis=0) - own) + penalty * own
                g_factors[terms] += slope * slope
                self.factors[terms] = own - rate * slope / np.sqrt(g_factors[terms])


def training_rows(
    docs: DataFrame, labels: DataFrame, *, folds: int, held_out: int, max_rows: int
) -> DataFrame:
    """(doc_id, toxic, text): the rows to learn from, at most about ``max_rows`` / 2 a label."""
    marks = (
        pick(labels, doc_id="bigint", toxic="int")
        .filter((fold(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    )
    rows = (
        pick(docs, doc_id="bigint", text="string")
        .filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .withColumn("code", F.xxhash64("text"))
    )
    labelled = cut_lineage(rows.select("doc_id", "code").distinct().join(marks, "doc_id"))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", "code"), F.lit(1_000_000)) / F.lit(1e6)
    share = F.lit(0.0)
    for label, n in sizes.items():
        own = F.lit(min(1.0, max_rows / len(sizes) / n))
        share = F.when(F.col("toxic") == label, own).otherwise(share)
    # The rows chosen are bounded by max_rows: they are sent to the texts, not the texts to them.
    return (
        rows.join(F.broadcast(labelled.filter(draw < share)), ["doc_id", "code"])
        .dropDuplicates(["doc_id", "code"])
        .select("doc_id", "toxic", "text")
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0,
    max_rows: int = 12_000, bits: int = 18, factors: int = 4,
    min_rows: int = 3, min_z: float = 4.0, epochs: int = 8, rate: float = 0.1,
    penalty: float = 1e-4, seed: int = 11,
) -> FactorizationMachine:
    """A machine fitted on the labelled rows outside the held-out fold.

    Of each label at most about ``max_rows`` / 2 rows are taken, by a hash of id and text, each with
    all its terms, however long the text. Rows with null toxic, null doc_id or null text teach
    nothing; rows alike in doc_id and text are one, rows of one doc_id with different texts are
    several; a doc_id labelled both ways counts as toxic. Extra columns, whatever their names, are
    not read. Without a row to learn from, all weights stay zero and every score is 0.5.
    """
    model = FactorizationMachine.blank(bits, factors)
    hashed = F.arrow_udf(_hashed(bits), "array<int>")
    rows = training_rows(docs, labels, folds=folds, held_out=held_out, max_rows=max_rows)
    sample = rows.select("doc_id", "toxic", hashed("text").alias("terms"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, int]] = []
        for batch in batches:
            # A text's terms stay one array of numbers, as long texts have very many.
            terms = [np.array(x.values.to_numpy(), np.int32) for x in batch["terms"]]
            rows += zip(
                batch["doc_id"].to_pylist(), terms, batch["toxic"].to_pylist(), strict=True
            )
        rows.sort(key=lambda row: (row[0], zlib.crc32(row[1]), row[2]))
        if rows:
            own = [terms for _, terms, _ in rows]
            marks = np.array([toxic != 0 for _, _, toxic in rows], float)
            model.choose(own, marks, min_rows, min_z)
            model.fit(own, marks, epochs=epochs, rate=rate, penalty=penalty, seed=seed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([model.bias]),
                pa.array([model.linear.tobytes()], pa.binary()),
                pa.array([model.factors.tobytes()], pa.binary()),
                pa.array([model.chosen.tobytes()], pa.binary()),
                pa.array([model.scale.tobytes()], pa.binary()),
            ],
            names=["bias", "linear", "factors", "chosen", "scale"],
        )

    shape = "bias double, linear binary, factors binary, chosen binary, scale binary"
    fitted = sample.repartition(1).mapInArrow(train, shape).first()
    if fitted is None:
        return model
    return FactorizationMachine(
        fitted["bias"],
        np.frombuffer(fitted["linear"], np.float32),
        np.frombuffer(fitted["factors"], np.float32).reshape(-1, factors),
        np.frombuffer(fitted["chosen"], bool),
        np.frombuffer(fitted["scale"], np.float32),
    )


def _hashed(bits: int):
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([terms_of(text.as_py(), bits) for text in texts], pa.list_(pa.int32()))

    hashed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return hashed


def toxicity_of(spark: SparkSession, model: FactorizationMachine):
    """Arrow function text -> score between 0 and 1; null and empty texts get the bias alone."""
    shared = spark.sparkContext.broadcast(model)
    bits = len(model.linear).bit_length() - 1

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(
            [shared.value.score(terms_of(text.as_py(), bits)) for text in texts], pa.float64()
        )

    return score
