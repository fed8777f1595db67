"""Quality classifier: ridge regression on random Fourier features of document statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow.llm.common import read, stage, summed
from harrow.llm.registry import query

FOURIER = 256        # random features
RIDGE = 1e-4         # per labelled row
FOLDS = 3            # for scores that calibration may trust
ROWS_A_TASK = 20_000 # labelled rows whose normal equations a task sums
SCORE_BINS = 4096    # steps of raw score that calibration tells apart
FEATURES = ("chars", "words", "word_length", "distinct_words", "distinct_pairs", "distinct_lines",
            "short_words", "upper", "lower", "digits", "blanks", "line_ends", "stops", "marks",
            "symbols", "beyond_ascii", "doubled_marks")

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": bytes(range(48, 58)),
    "blanks": b" \t", "line_ends": b"\r\n", "stops": b".!?", "marks": b",;:'\"()-",
    "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "beyond_ascii": bytes(range(128, 256))}
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1+")


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; a NULL counts as an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size, words = len(data), data.split()
    n, lines = len(words), data.split(b"\n")
    per_char = 1 / max(1, size)
    per_word = 1 / max(1, n)
    counts = [(size - len(data.translate(None, c))) * per_char for c in _CLASSES.values()]
    return [
        np.log1p(size), np.log1p(n), sum(map(len, words)) * per_word, len(set(words)) * per_word,
        len(set(zip(words, words[1:]))) * per_word, sum(map(len, set(lines))) * per_char,
        sum(1 for w in words if len(w) <= 3) * per_word, *counts,
        len(_DOUBLED.findall(data)) * per_word]


@dataclass
class QualityModel:
    """Standardised statistics -> cos features -> linear score -> calibrated score."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    raw: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.lift(x) @ self.weights, self.raw, self.calibrated), 0, 1)


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every document."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "x": [statistics(t) for t in frame["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>")


def _sums(rows: DataFrame, n: int, model: QualityModel, folds: int) -> np.ndarray:
    """Normal equations per fold: Z'Z with Z'y as last column, summed in the partitions first."""
    width = len(model.phases) + 1

    def part(batch):
        total = np.zeros((folds, width, width + 1))
        z = model.lift(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        zy = np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None]])
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for k in np.unique(fold).tolist():
            total[k] = z[fold == k].T @ zy[fold == k]
        return total

    return summed(rows, part, (folds, width, width + 1), n // ROWS_A_TASK)


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b = sums[:, :-1], sums[:, -1]
    n = a[-1, -1]
    penalty = np.eye(len(a)) * max(1e-9, ridge * n)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising ``x``: knots of a rising rate of hits.

    A block gives a knot at either end, so the way between two blocks is the gap
    between their nearest scores; inside a block the rate rises just enough to keep order.
    """
    blocks: list[list[float]] = []
    for xi, hi, ni in zip(x, hits, n):
        blocks.append([xi, xi, hi, ni])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, end, h, m = blocks.pop()
            blocks[-1] = [blocks[-1][0], end, blocks[-1][2] + h, blocks[-1][3] + m]
    b = np.array(blocks)
    rates = np.maximum.accumulate((b[:, 2] + 0.02) / (b[:, 3] + 0.04))
    around = np.concatenate(([0.0], rates, [1.0]))
    low, high = rates - (rates - around[:-2]) / 100, rates + (around[2:] - rates) / 100
    return b[:, :2].ravel(), np.stack([low, high], axis=1).ravel()


def fit(labelled: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE, folds: int = FOLDS) -> QualityModel:
    """Model from rows ``doc_id, x, y`` (y 0 or 1); fits on all of them.

    Only sums of a fixed size come to the driver: moments, one matrix per fold, counts per step of score.
    Matrices are summed by tasks that follow the number of rows, not that of partitions.
    Every row's calibration score comes from the folds that do not hold it. No rows give
    a model that scores 0.5.
    """
    d = len(FEATURES)
    labelled = stage(labelled.select("doc_id", "x", "y"), "labelled")
    moments = labelled.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(d)],
                           *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    draw = np.random.default_rng(7)
    directions = draw.normal(size=(d, fourier)) / np.sqrt(d)
    phases = draw.uniform(0, 2 * np.pi, fourier)
    if not moments[0]:
        return QualityModel(np.zeros(d), np.ones(d), directions, phases)
    scale = np.array(moments[1 + d:], dtype=float)
    model = QualityModel(np.array(moments[1:1 + d]), np.where(scale > 1e-9, scale, 1), directions, phases)

    n = moments[0]
    rows = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")).coalesce(
        1 + n // ROWS_A_TASK)
    sums = _sums(rows, n, model, folds)
    whole = sums.sum(axis=0)
    model.weights = _solve(whole, ridge)
    apart = np.stack([_solve(whole - s if (whole - s)[-1, -1] > 0 else whole, ridge) for s in sums])

    def held(frames):
        for frame in frames:
            z = model.lift(np.stack(frame["x"].to_numpy()))
            raw = (z * apart[frame["fold"].to_numpy()]).sum(axis=1)
            yield pd.DataFrame({"bin": np.floor(np.clip(raw, -1, 2) * SCORE_BINS / 3).astype(np.int64),
                                "raw": raw, "y": frame["y"].to_numpy(float)})

    binned = (rows.mapInPandas(held, "bin long, raw double, y double").groupBy("bin")
              .agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
              .orderBy("bin").toPandas())
    model.raw, model.calibrated = isotonic(
        binned["raw"].to_numpy(), binned["y"].to_numpy(float), binned["n"].to_numpy(float))
    return model


def held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Rows whose CRC-32 of the id, as text, leaves the given remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def _training(features: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    known = labels.where(F.col(target).isin(0, 1)).select("doc_id", F.col(target).cast("int").alias("y"))
    return features.where(~held_out()).join(known, "doc_id").select("doc_id", "x", "y")


def quality_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Learns from labelled rows that are not held out, from the text alone. One row per
    row of ``docs``: NULL and empty texts are scored like any other, rows with a NULL id or a
    repeated one too; labels other than 0 and 1 are left out.
    """
    features = stage(featured(docs), "statistics")
    model = fit(_training(features, labels, "quality"), **settings)

    def run(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, len(FEATURES)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model.score(x)})

    scored = features.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Documents that score 0.5 or more, all columns as they were."""
    features = stage(featured(docs), "statistics")
    model = fit(_training(features, labels, "quality"), **settings)

    def keep(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))
