"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.common import read, stage
from harrow.llm.quality import held_out
from harrow.llm.registry import query

FIT_ROWS = 4_000      # documents that the model learns from, about, and
LANGUAGE_ROWS = 200   # that many of each language in any case, or all it has
WORDS = 50_000        # known words, those of the greatest share in some language
GRAMS = 20_000        # known n-grams of each length
LONGEST = 5
REMEMBERED = 100_000  # words whose vectors a task keeps
UNKNOWN = "und"

Evidence = tuple[float, ...]     # a log frequency per language

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased words with a letter in them; signs like one half or a circled number are none."""
    found = _WORD.findall(text.lower()) if text else []
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """N-grams of a word with its ends marked."""
    padded = f"<{word}>"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies per language of words and of n-grams, the longest first."""

    languages: list[str]
    prior: np.ndarray
    known: dict[str, Evidence]
    grams: list[dict[str, Evidence]]

    def vector(self, word: str) -> Evidence:
        """Known words by their own frequency, others by their longest known n-grams."""
        own = self.known.get(word)
        if own is not None:
            return own
        for table, n in zip(self.grams, range(LONGEST, 0, -1)):
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return tuple(sum(v) / len(found) for v in zip(*found))
        return (0.0,) * len(self.languages)


class Reader:
    """Predicts texts with one model; remembers vectors of a bounded number of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows = np.zeros((REMEMBERED, max(1, len(model.languages))))
        self.places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        place = self.places.get(word)
        if place is None:
            place = self.places[word] = len(self.places)
            self.rows[place] = self.model.vector(word)
        return place

    def _sum(self, counts: list[tuple[str, int]]) -> np.ndarray:
        if len(self.places) + len(counts) > REMEMBERED:
            self.places.clear()
        at = [self._place(w) for w, _ in counts]
        return np.array([n for _, n in counts], dtype=float) @ self.rows[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the evidence, which grows with the root of the length."""
        found = words(text)
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        counts = list(Counter(found).items())
        evidence = self.model.prior.copy()
        total = sum(self._sum(counts[i:i + REMEMBERED // 2]) for i in range(0, len(counts), REMEMBERED // 2))
        evidence += total / len(found) ** 0.5
        odds = np.exp(evidence - evidence.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def _vectors(counts: pd.DataFrame, name: str, place: dict[str, int], totals: np.ndarray) -> dict[str, Evidence]:
    kinds = max(1, counts[name].nunique())
    table: dict[str, np.ndarray] = {}
    for token, lang, n in zip(counts[name], counts["lang"], counts["n"]):
        table.setdefault(token, np.full(len(place), 0.5))[place[lang]] += n
    base = np.log(totals + 0.5 * kinds)
    return {token: tuple((np.log(v) - base).tolist()) for token, v in table.items()}


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, language_rows: int = LANGUAGE_ROWS) -> LanguageModel:
    """Model from documents (``doc_id, text, lang``) that are not held out.

    A hash of id and text thins them to about ``fit_rows``, but keeps ``language_rows`` of each language, or
    all. Words are counted in each task and then by hash; n-grams come from the counted words. Those of
    the greatest share in any one language come to the driver, a number fixed by the settings.
    """
    training = docs.where(~held_out(parts=4, part=2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stage(training.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")), "languages")
    n = sizes.agg(F.sum("_docs")).first()[0] or 0
    rate = F.greatest(F.lit(fit_rows / max(1, n)), F.lit(language_rows) / F.col("_docs"))
    chosen = training.join(sizes, "lang").where(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < rate * 1_000_000)

    def count(frames):
        for frame in frames:
            found: dict[str, Counter] = {}
            for text, lang in zip(frame["text"], frame["lang"]):
                found.setdefault(lang, Counter()).update(words(text))
            rows = [(w, lang, k) for lang, c in found.items() for w, k in c.items()]
            yield pd.DataFrame(rows, columns=["word", "lang", "n"])

    counted = stage(chosen.select("text", "lang").mapInPandas(count, "word string, lang string, n long")
                    .groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")

    def cut(frames):
        for frame in frames:
            found: Counter = Counter()
            for word, lang, k in zip(frame["word"], frame["lang"], frame["n"]):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        found[size, g, lang] += k
            rows = [(*key, k) for key, k in found.items()]
            yield pd.DataFrame(rows, columns=["size", "gram", "lang", "n"])

    pieces = stage(counted.mapInPandas(cut, "size int, gram string, lang string, n long")
                   .groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")), "grams")
    words_of = stage(counted.groupBy("lang").agg(F.sum("n").alias("_words")), "totals")
    per_language = words_of.join(sizes, "lang").orderBy("lang").toPandas()
    place = {lang: i for i, lang in enumerate(per_language["lang"])}
    totals = per_language["_words"].to_numpy(float)

    def most(rows: DataFrame, name: str, limit: int) -> dict[str, Evidence]:
        share = rows.join(words_of, "lang").groupBy(name).agg(F.max(F.col("n") / F.col("_words")).alias("_share"))
        top = share.orderBy(F.desc("_share"), name).limit(limit)
        return _vectors(rows.join(top.select(name), name).select(name, "lang", "n").toPandas(),
                        name, place, totals)

    known = most(counted, "word", WORDS)
    tables = [most(pieces.where(F.col("size") == size).drop("size"), "gram", GRAMS)
              for size in range(LONGEST, 0, -1)]
    docs_of = per_language["_docs"].to_numpy(float)
    prior = np.log(docs_of / docs_of.sum()) if len(docs_of) else docs_of
    return LanguageModel(list(place), prior, known, tables)


def language_predictions(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    One row per row of ``docs``; NULL or repeated ids are predicted like others. A text
    that is NULL or has no letter gives ``und`` and 0, as does everything when nothing was learned. Of languages
    with the same evidence the first by name is taken.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, **settings))

    def run(frames):
        reader = Reader(sent.value)
        for frame in frames:
            found = [reader.predict(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    predicted = docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", held_out(parts=4, part=2).alias("held_out"), "lang_pred", "score")


@query("op4_language")
def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    return language_predictions(read(spark, sf, "documents"))
