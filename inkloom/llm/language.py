"""Language ID by words first: known words score by their log frequency in each language, an
unseen word by the longest of its character n-grams that any language knows.

The model is fitted on a bounded sample of labelled rows (``docs_a_language`` by a hash of the
id and text) and has at most ``max_words`` words and ``max_grams`` n-grams of each length, an equal
part for each language, so its broadcast size is bounded. Prediction reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.common import fold, packed, pick, unpacked
from inkloom.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Evidence of a text grows up to so many words; beyond, only its mean counts.
EVIDENCE_WORDS = 20
MEMO = 50_000


def words_of(text: str) -> Counter:
    """Runs of letters, lower-cased. Numerals such as ½ or Ⅷ are no letters and part words."""
    found = Counter(WORD.findall(text.lower()))
    for word in [w for w in found if not w.isalpha()]:
        count = found.pop(word)
        for run in "".join(c if c.isalpha() else " " for c in word).split():
            found[run] += count
    return found


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of the word between its boundary marks; single letters have no marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """Tables of log frequencies, one column a language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of an unseen word that are known."""
        for n in LENGTHS:
            known = [k for g in grams_of(word, n) if (k := self.grams.get(g)) is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def scores(self, text: str | None, memo: dict[str, np.ndarray]) -> tuple[str, float]:
        """The likeliest language (ties: first in code point order) and its probability."""
        counts = words_of(text) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        total, rows, weights = np.zeros(len(self.langs)), [], []
        for word, count in counts.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                weights.append(count)
                continue
            logs = memo.get(word)
            if logs is None:
                logs = self.backoff(word)
                if len(memo) < MEMO and len(word) < 64:
                    memo[word] = logs
            total += count * logs
        if rows:
            total += np.array(weights, float) @ self.word_logs[rows]
        n = sum(counts.values())
        evidence = total / n * min(n, EVIDENCE_WORDS)
        odds = np.exp(evidence - evidence.max())
        best = int(evidence.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def _logs(rows: Iterable[tuple[str, list[int]]], langs: int) -> tuple[dict[str, int], np.ndarray]:
    """Index and smoothed log relative frequencies, one table for each kind of feature."""
    rows = list(rows)
    counts = np.array([c for _, c in rows], float).reshape(-1, langs)
    smooth = counts + 0.5
    return {w: k for k, (w, _) in enumerate(rows)}, np.log(smooth / smooth.sum(axis=0))


def _counted(frame: DataFrame, langs: list[str], top: int) -> list[tuple[str, list[int]]]:
    """Features seen at least twice, counts by language: an equal part of ``top`` for the most
    frequent ones of each language, so a small language keeps as many as a large one."""
    own = [f"n{k}" for k in range(len(langs))]
    per_lang = [
        F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(name)
        for name, lang in zip(own, langs, strict=True)
    ]
    wide = cut_lineage(
        frame.groupBy("feature").agg(F.sum("n").alias("total"), *per_lang).filter("total >= 2")
    ).select("feature", *own)
    share = max(1, top // len(langs))
    best = [wide.filter(F.col(n) > 0).orderBy(F.desc(n), "feature").limit(share) for n in own]
    rows = reduce(DataFrame.unionByName, best).distinct().orderBy("feature").collect()
    return [(row[0], list(row[1:])) for row in rows]


def fit_languages(
    docs: DataFrame,
    *,
    folds: int = 3,
    held_out: int = 1,
    docs_a_language: int = 10_000,
    max_words: int = 60_000,
    max_grams: int = 20_000,
) -> LanguageModel:
    """A model of every ``lang`` value of the rows outside the held-out fold.

    Rows with null text or null lang teach nothing; of a language with more rows than
    ``docs_a_language``, about that many are taken, chosen by a hash of id and text. No row to
    learn from: a model without languages, which answers ``und``.
    """
    known = pick(docs, doc_id="bigint", text="string", lang="string").filter(
        (fold(F.col("doc_id"), folds) != held_out)
        & F.col("lang").isNotNull()
        & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.coalesce(
        *[
            F.when(F.col("lang") == lang, F.lit(min(1.0, docs_a_language / sizes[lang])))
            for lang in langs
        ]
    )
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.filter(draw < share).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(words), pa.string()),
                        pa.array([lang] * len(words), pa.string()),
                        pa.array(list(words.values()), pa.int64()),
                    ],
                    names=["feature", "lang", "n"],
                )

    shape = "feature string, lang string, n bigint"
    words = cut_lineage(
        sample.mapInArrow(counted, shape).groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    )

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for word, lang, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for length in LENGTHS:
                    for gram in grams_of(word, length):
                        seen[gram, lang] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in seen], pa.string()),
                    pa.array([lang for _, lang in seen], pa.string()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["feature", "lang", "n"],
            )

    word_rows = _counted(words, langs, max_words)
    grams = cut_lineage(
        words.mapInArrow(spelled, shape).groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    )
    gram_index: dict[str, int] = {}
    gram_logs = []
    for length in LENGTHS:
        rows = _counted(grams.filter(F.char_length("feature") == length), langs, max_grams)
        index, logs = _logs(rows, len(langs))
        gram_index |= {g: k + len(gram_index) for g, k in index.items()}
        gram_logs.append(logs)
    word_index, word_logs = _logs(word_rows, len(langs))
    return LanguageModel(langs, word_index, word_logs, gram_index, np.concatenate(gram_logs))


def language_of(spark: SparkSession, model: LanguageModel):
    """Arrow function text -> (lang_pred, score); the model is broadcast, its size is bounded."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, np.ndarray] = {}
        for texts in batches:
            found = [shared.value.scores(text.as_py(), memo) for text in texts]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["lang_pred", "score"],
            )

    return predict


def identified(docs: DataFrame, *, min_score: float = 0.3, **fit: int) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, columns unchanged.

    Rejected: null text, text without a letter (``und``), and a best language under
    ``min_score``. Nulls elsewhere do not matter; repeated rows are judged alike; an empty table
    gives no rows. Where nothing can be learned (no non-null lang), every text is ``und``.
    """
    predict = language_of(docs.sparkSession, fit_languages(docs, **fit))
    found = packed(docs).withColumn("found", predict("text"))
    kept = found.filter(
        (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= min_score)
    )
    return unpacked(kept, docs.columns)
