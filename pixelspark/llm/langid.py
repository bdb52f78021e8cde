"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word it doesn't know is scored by its
character n-grams: at each place the longest known one that starts there, from ``MAX_GRAM`` characters down to one.
A text's score for a language is the sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, pieces, table

#: The model is fitted on a sample bounded by these: documents a language (in the mean, drawn by a hash of the id),
#: and different (language, word) pairs, the most frequent first.
FIT_DOCS = 1500
FIT_WORDS = 200_000
FIT_LANGS = 1000
MAX_GRAM = 4
UNKNOWN = "und"
#: Evidence counts as that of at most so many words, so that a score near 1 needs a clear margin a word.
FULL_WORDS = 30
#: Scores of unknown words that a worker keeps.
KEPT_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; those of numeric signs alone, which the pattern also matches, are left out."""
    return [x for x in _WORD.findall(text.lower()) if x[0].isalpha() or any(map(str.isalpha, x))]


@dataclass
class LanguageModel:
    """Log frequencies: a row a known word or n-gram, a column a language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray
    gram_rows: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]]) -> LanguageModel:
        """From (language, word, count)."""
        languages = sorted({x for x, _, _ in counts})
        place = {x: k for k, x in enumerate(languages)}
        words: dict[str, int] = {}
        grams: dict[str, int] = {}
        for _, word, _ in counts:
            words.setdefault(word, len(words))
        table_ = np.zeros((len(words), len(languages)))
        tally: Counter[tuple[str, int]] = Counter()
        for lang, word, n in counts:
            k = place[lang]
            table_[words[word], k] += n
            padded = f"^{word}$"
            for size in range(1, MAX_GRAM + 1):
                for at in range(len(padded) - size + 1):
                    tally[padded[at : at + size], k] += n
        for gram, _ in tally:
            grams.setdefault(gram, len(grams))
        gram_counts = np.zeros((len(grams), len(languages)))
        for (gram, k), n in tally.items():
            gram_counts[grams[gram], k] = n
        sizes = np.array([len(x) for x in grams])
        gram_rows = np.zeros_like(gram_counts)
        for size in range(1, MAX_GRAM + 1):
            own = sizes == size
            part = gram_counts[own] + 0.1
            gram_rows[own] = np.log(part / part.sum(axis=0)) if own.any() else part
        smooth = table_ + 0.1
        return cls(languages, words, grams, np.log(smooth / smooth.sum(axis=0)) if len(words) else smooth, gram_rows)

    def word_score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        return self.word_rows[known] if known is not None else self.backoff(word)

    def backoff(self, word: str) -> np.ndarray:
        """The mean over places of the longest known n-gram there, times half the places: n-grams overlap."""
        padded, rows, grams = f"^{word}$", [], self.grams
        for at in range(len(padded)):
            for size in range(min(MAX_GRAM, len(padded) - at), 0, -1):
                k = grams.get(padded[at : at + size])
                if k is not None:
                    rows.append(k)
                    break
        return self.gram_rows[rows].sum(axis=0) / 2 if rows else np.zeros(len(self.languages))


class Predictor:
    """Predicts texts in turn and keeps the scores of unknown words it has met, at most ``KEPT_WORDS``."""

    def __init__(self, model: LanguageModel) -> None:
        self._model, self._base = model, len(model.words)
        self._index = dict(model.words)
        self._rows = np.concatenate([model.word_rows, np.zeros((KEPT_WORDS, len(model.languages)))])

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1; ``und`` and 0 without letters or without a model."""
        words = words_of(text) if text else []
        languages = self._model.languages
        if not words or not languages:
            return UNKNOWN, 0.0
        total, index = np.zeros(len(languages)), self._index
        for at in range(0, len(words), 50_000):
            places = []
            for word in words[at : at + 50_000]:
                k = index.get(word)
                if k is None:
                    if len(index) == self._base + KEPT_WORDS:
                        total += self._rows[places].sum(axis=0) if places else 0
                        places = []
                        index = self._index = dict(self._model.words)
                    k = index[word] = len(index)
                    self._rows[k] = self._model.backoff(word)
                places.append(k)
            total += self._rows[places].sum(axis=0)
        best = int(np.argmax(total))
        odds = (total - total[best]) * min(1.0, FULL_WORDS / len(words))
        return languages[best], float(1 / np.exp(np.maximum(odds, -700)).sum())


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> LanguageModel:
    """Fits on rows with text and a language. The sample is drawn by a hash of the id, for each language at the rate
    that gives ``fit_docs`` documents in the mean; all words of a drawn document count. Of more than ``FIT_LANGS``
    languages the most frequent are learned."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("language sample"), F.col(id_col)).alias("draw")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_LANGS).collect()}
    if not sizes:
        return LanguageModel.fit([])
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[tuple[str, str]] = Counter()
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.update((lang, x) for x in words_of(text))
        yield pa.RecordBatch.from_pydict({"lang": [a for a, _ in tally], "word": [b for _, b in tally], "n": list(tally.values())}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counts = drawn.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = counts.orderBy(F.desc("n"), "lang", "word").limit(fit_words)
    return LanguageModel.fit([(r.lang, r.word, r.n) for r in kept.toLocalIterator()])


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, one row each, from whole texts alone.

    A text that is null or has no letter gives ``und`` with score 0, as does a model without languages; equal scores
    go to the language first in order. Columns of the same names as the two new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_WORDS
    kept = [x for x in docs.columns if x.lower() not in (lang_out.lower(), score_out.lower())]
    rows = docs.select(*[F.col(f"`{x}`").alias(f"c{k}") for k, x in enumerate(kept)])  # names may hold dots or differ in case only
    place, names = kept.index(text_col), [*rows.columns, "__lang", "__score"]
    schema = T.StructType([*rows.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for batch in pieces(batches):
            predictor = predictor or Predictor(held.value)
            found = [predictor.predict(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names)

    return rows.mapInArrow(run, schema).toDF(*kept, lang_out, score_out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of all documents; null texts and those without a letter are ``und``, repeated rows alike, and of
    equal scores the least language wins."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_fold(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
