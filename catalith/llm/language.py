"""Operator 9: language identification, words first, then shorter and shorter n-grams.

A model holds, by language, the negative logarithm of the relative frequency of
every word and character n-gram of a sample of labelled rows.  A word that any
language knows is scored by itself; an unseen word is scored by the mean of its
longest n-grams that any language knows, else by the next shorter ones.  A language
that lacks a feature gets a penalty.  A text's score is the mean over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import map_batches, tidy, written

#: Languages whose sample shares are broadcast, at most.
MOST_LANGUAGES = 10_000

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` and ``sample_chars`` bound the labelled rows that the model is fitted on.

    They are shared out evenly among the languages, so that a rare one is learned at
    any size of the table; the model holds all that the sample holds.
    ``cached_bytes`` bounds what one worker keeps of words that the model lacks.
    """

    sample_docs: int = 12_000
    sample_chars: int = 16_000_000
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)
    penalty: float = 7.0
    cached_bytes: int = 64 << 20


@dataclass
class Model:
    """``words`` and ``grams`` give the row of ``scores`` in which a feature's scores by language are."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray
    settings: Settings = field(default_factory=Settings)

    def of_word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.scores[known]
        padded = f" {word} "
        for n in self.settings.orders:
            found = [row for i in range(len(padded) - n + 1) if (row := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return self.scores[found].mean(axis=0)
        return np.full(len(self.languages), self.settings.penalty)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(labelled: DataFrame, settings: Settings) -> DataFrame:
    """A hash-random sample of each language, of an even share of the documents and characters."""
    by_lang = written(labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("double")).alias("chars")), "language-counts")
    n = max(1, by_lang.count())
    share = F.least(F.lit(1.0), settings.sample_docs / n / F.col("rows"), settings.sample_chars / n / F.greatest("chars", F.lit(1.0)))
    shares = by_lang.select(F.col("lang").alias("of_lang"), share.alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53)) / float(1 << 53)
    return labelled.join(F.broadcast(shares) if n <= MOST_LANGUAGES else shares, F.col("lang") == F.col("of_lang")).where(place < F.col("share")).select("text", "lang")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a sample of the labelled rows that aren't held out."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = sampled(labelled, settings).select("lang", found.alias("feature")).groupBy("lang", "feature").agg(F.count("*").alias("n"))
    words = written(words, "language-words")
    kinds = [words.select("lang", F.lit(0).alias("kind"), "feature", "n")]
    padded = F.concat(F.lit(" "), F.col("feature"), F.lit(" "))
    for order in settings.orders:
        starts = words.where(F.length(padded) >= order).select("lang", padded.alias("padded"), "n", F.explode(F.sequence(F.lit(1), F.length(padded) - order + 1)).alias("at"))
        grams = starts.groupBy("lang", F.substring("padded", F.col("at"), F.lit(order)).alias("feature")).agg(F.sum("n").alias("n")).where("feature <> ' '")
        kinds.append(grams.select("lang", F.lit(order).alias("kind"), "feature", "n"))
    table = kinds[0]
    for more in kinds[1:]:
        table = table.unionByName(more)
    rows = written(table, "language-features").toArrow()
    lang, kind, feature, count = rows["lang"].to_pylist(), rows["kind"].to_numpy(), rows["feature"].to_pylist(), rows["n"].to_numpy()
    languages = sorted(set(lang))
    at = {name: i for i, name in enumerate(languages)}
    lang = np.fromiter(map(at.__getitem__, lang), np.int64, len(lang))
    totals = np.zeros((len(languages), max(settings.orders) + 1))
    np.add.at(totals, (lang, kind), count)
    numbers: tuple[dict, dict] = {}, {}
    place = np.fromiter((of.setdefault(f, len(numbers[0]) + len(numbers[1])) for f, k in zip(feature, kind.tolist(), strict=True) for of in (numbers[k > 0],)), np.int64, len(feature))
    scores = np.full((len(numbers[0]) + len(numbers[1]), len(languages)), settings.penalty)
    if len(place):
        scores[place, lang] = np.minimum(settings.penalty, -np.log10(count / totals[lang, kind]))
    return Model(languages, *numbers, scores, settings)


class Judge:
    """(language, score) of a text; keeps the scores of the words it has seen."""

    def __init__(self, model: Model):
        import regex

        self.model, self.find = model, regex.compile(r"\p{L}+").findall
        self.forget()

    def forget(self) -> None:
        """Keep the model's own words only."""
        self.numbers, self.kept, self.size = dict(self.model.words), 0, len(self.model.scores)
        self.rows = np.concatenate([self.model.scores, np.zeros((1024, len(self.model.languages)))])

    def number(self, word: str) -> int:
        n = self.numbers.get(word)
        if n is None:
            n, self.size = self.size, self.size + 1
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(1024, n // 4), self.rows.shape[1]))])
            self.rows[n] = self.model.of_word(word)
            self.numbers[word] = n
            self.kept += 120 + 4 * len(word) + 8 * self.rows.shape[1]
        return n

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else []
        if not words or not self.model.languages:
            return "und", 0.0
        if self.kept > self.model.settings.cached_bytes:
            self.forget()
        try:
            ids = [*map(self.numbers.__getitem__, words)]
        except KeyError:
            ids = [*map(self.number, words)]
        mean = self.rows[ids].mean(axis=0)
        best = int(mean.argmin())
        return self.model.languages[best], float(1 / np.exp(np.maximum((mean[best] - mean) * math.log(10) * len(words), -700)).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; only the text is looked at.

    ``und`` with score 0 if the text is null or has no letter, or no language was
    learned.  The score is the softmax of the languages' log-likelihoods over all
    words.  Ties go to the first language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tidy()  # what the driver fitted the model with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = [judge(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), run, SCHEMA)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the rows that aren't held out and predict every row."""
    return predict(docs, fit(docs, settings))


def keep_identified(docs: DataFrame, settings: Settings = Settings(), least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language can be told, unchanged: not ``und``, and a score of ``least`` or more."""
    model = fit(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tidy()  # what the driver fitted the model with
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = [judge(text) for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)
