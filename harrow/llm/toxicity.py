"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.chosen_path import token_samples
from harrow.llm.common import read, stage
from harrow.llm.quality import held_out, isotonic
from harrow.llm.registry import query

STEM = 4              # shortest start of a word that may be an entry
STEMS_TO = 8          # longest start that is counted besides whole words
LEAST_DOCS = 3        # toxic documents that must hold an entry
LEAST_WEIGHT = 3.0    # log odds below which a word is no entry
MARGIN = 1.0          # log odds, beyond the number of words looked at, against chance
LEXICON = 5_000       # entries of the automaton, the weightiest first
TOXIC_ROWS = 20_000   # labelled toxic documents whose words are counted, at most about
CLEAN_ROWS = 40_000  # labelled clean ones
SCORE_BINS = 4096

# Phrases in which an entry is meant harmlessly; the entry inside does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pathetic fallacy",
              "sore loser of the match")

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ℓ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FULL_WIDTH = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_LETTERS = {ord(a): b for a, b in HOMOGLYPHS.items()} | {
    k: v.lower() for k, v in _FULL_WIDTH.items()} | _HIDDEN
# A digit or sign is a letter only where a letter follows and a word goes on or begins,
# so that marks after a word stay marks.
_INSIDE = re.compile(r"(?:(?<=[^\W\d_])|(?<![\w@$!]))[0134578@$!]{1,3}(?=[^\W\d_])|(?<=[^\W\d_])[01357]+(?![\w@$!])")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> str:
    """Lower case, look-alikes as Latin letters, digits inside words as letters."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    return _INSIDE.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)


def word_parts(text: str | None) -> set[str]:
    """Distinct words of the folded text, ended by a blank, and their starts."""
    parts: set[str] = set()
    for word in set(_WORD.findall(folded(text))):
        parts.add(word + " ")
        parts.update(word[:k] for k in range(STEM, min(STEMS_TO, len(word) - 1) + 1))
    return parts


@dataclass
class Lexicon:
    """Entries (whole words end in a blank, others are starts of words) with weights."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    knots: tuple[list[float], list[float]] = field(default_factory=lambda: ([0.0], [0.5]))

    def __post_init__(self):
        # One key may stand for a start of words and a whole word.
        entries: dict[str, list[tuple[int, bool, float | None]]] = {}
        for entry, weight in self.weights.items():
            key = entry.rstrip(" ")
            entries.setdefault(key, []).append((len(key), entry.endswith(" "), weight))
        for phrase in self.exceptions:
            entries.setdefault(phrase, [(len(phrase), True, None)])
        self.automaton = ahocorasick.Automaton()
        for key, values in entries.items():
            self.automaton.add_word(key, values)
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.knots)

    def measure(self, text: str | None) -> float:
        """Weight of the entries of a text by its length; negative if it has none."""
        text = folded(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, size, whole, weight in ((end, *value) for end, values in self.automaton.iter(text)
                                             for value in values):
                start = end - size + 1
                if start and text[start - 1].isalpha():
                    continue
                if whole and end + 1 < len(text) and text[end + 1].isalpha():
                    continue
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0):
                    best[start] = weight
        hits = [w for at, w in best.items() if not any(a <= at <= b for a, b in spared)]
        words = len(text) / 6 + 1
        if not hits:
            return -1.0 - min(1.0, math.log1p(words) / 12)
        # Harm fades with length, but slowly: one strong word in a long text still tells.
        return sum(hits) / words ** 0.25 + max(hits)

    def score(self, texts) -> list[float]:
        return np.clip(np.interp([self.measure(t) for t in texts], *self.knots), 0, 1).tolist()


def part_counts(texts: DataFrame, wanted=None) -> DataFrame:
    """``part, docs``: documents that hold each word or start, or each of the wanted ones.

    Counted in each task first; parts then meet by hash.
    """
    def count(frames):
        found: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                parts = word_parts(text)
                found.update(parts if wanted is None else parts & wanted.value)
            if len(found) > 1_000_000:
                yield pd.DataFrame({"part": list(found.keys()), "docs": list(found.values())})
                found = Counter()
        if found:   # a frame without rows has no strings to tell its type by
            yield pd.DataFrame({"part": list(found.keys()), "docs": list(found.values())})

    return texts.select("text").mapInPandas(count, "part string, docs long").groupBy("part").agg(
        F.sum("docs").alias("docs"))


def learn_lexicon(rows: DataFrame, entries: int = LEXICON, exceptions=EXCEPTIONS) -> Lexicon:
    """Lexicon with the log odds of each word or start of words in toxic documents.

    Toxic documents are counted first; clean ones only for what toxic ones hold.
    """
    toxic_rows = rows.where("y = 1")
    n_toxic, n_clean = toxic_rows.count(), rows.where("y = 0").count()
    if not n_toxic:
        return Lexicon({}, exceptions)
    known = stage(part_counts(toxic_rows).where(F.col("docs") >= LEAST_DOCS)
                  .withColumnRenamed("docs", "toxic"), "parts")
    # Bounded by the words of the sample of toxic documents.
    wanted = frozenset(r[0] for r in known.select("part").toLocalIterator())
    clean = part_counts(rows.where("y = 0"), rows.sparkSession.sparkContext.broadcast(wanted)) \
        .withColumnRenamed("docs", "clean")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean) if n_clean else 0.5
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(rate / share) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0)
    rated = (known.join(clean, "part", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
             .withColumn("weight", odds)
             # Of many words some are in toxic documents alone by chance; an entry is not.
             .where((F.col("weight") >= LEAST_WEIGHT) & (surprise >= math.log(max(1, len(wanted))) + MARGIN))
             .orderBy(F.desc("weight"), F.desc("toxic"), "part").limit(entries)
             .select("part", "weight").toPandas())
    weights = dict(zip(rated["part"], rated["weight"].astype(float)))
    # A start of words says all that longer entries with it say, unless they say more.
    kept = {}
    for part in sorted(weights, key=lambda p: (len(p.rstrip(" ")), p)):
        stem = part.rstrip(" ")
        shorter = max((kept.get(stem[:k], 0.0) for k in range(STEM, len(stem))), default=0.0)
        if weights[part] > shorter + 0.25:
            kept[part] = weights[part]
    return Lexicon(kept, exceptions)


def _bounded(rows: DataFrame, y: int, most: int) -> DataFrame:
    """Rows of a class, thinned by a hash of the id to about ``most``."""
    own = rows.where(F.col("y") == y)
    n = own.count()
    return own if n <= most else own.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))


def without_copies(rows: DataFrame, samples: int = 16, most: float = 0.6) -> DataFrame:
    """Training rows, near copies once: else all words of one copied text look like entries.

    A row is left out if at least a share ``most`` of its sampled shingles stand in rows of the same
    label and a lesser id. At a similarity of 0.8 that is nearly sure; rows that
    have a passage in common, or a similarity of 0.3, stay. An id that has both labels counts with each.
    """
    taken = token_samples(rows, 5, samples, whole=True).where("sample IS NOT NULL")
    keys = taken.select("doc_id", F.posexplode(F.array(
        *[F.expr(f"substring(sample, {8 * k + 1}, 8)") for k in range(samples)])).alias("k", "key"))
    keys = stage(keys.distinct().join(rows.select("doc_id", "y").distinct(), "doc_id"), "copies")
    first = keys.groupBy("y", "k", "key").agg(F.min("doc_id").alias("first"))
    later = keys.join(first, ["y", "k", "key"]).where("doc_id > first").groupBy("doc_id", "y").agg(
        F.count_distinct("k").alias("_n")).where(F.col("_n") >= most * samples).select("doc_id", "y")
    return stage(rows.join(later, ["doc_id", "y"], "left_anti").select(*rows.columns), "training")


def calibrate(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Measures of the labelled rows put into steps; isotonic rates of toxic ones."""
    def measure(frames):
        for frame in frames:
            m = np.array([lexicon.measure(t) for t in frame["text"]], dtype=float)
            yield pd.DataFrame({"bin": np.floor(np.clip(m, -2, 62) * SCORE_BINS / 64).astype(np.int64),
                                "m": m, "y": frame["y"].to_numpy(float)})

    binned = (rows.mapInPandas(measure, "bin long, m double, y double").groupBy("bin")
              .agg(F.avg("m").alias("m"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
              .orderBy("bin").toPandas())
    if len(binned):
        x, rates = isotonic(binned["m"].to_numpy(), binned["y"].to_numpy(float), binned["n"].to_numpy(float))
        lexicon.knots = (x.tolist(), rates.tolist())
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
          exceptions=EXCEPTIONS) -> Lexicon:
    """Lexicon and calibration from labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    keys = known.where(~held_out(parts=5, part=0))
    chosen = _bounded(keys, 1, toxic_rows).union(_bounded(keys, 0, clean_rows))
    # The ids are bounded by the two settings.
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "y"), "labelled")
    rows = without_copies(rows)
    return calibrate(learn_lexicon(rows, exceptions=exceptions), rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    One row per row of ``docs``. NULL and empty texts have no entries and get the rate of
    such documents; NULL and repeated ids are scored like others; labels other than 0
    and 1 are left out. Without labels every score is 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **settings))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "score": sent.value.score(frame["text"])})

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(parts=5, part=0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))
