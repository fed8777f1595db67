"""Spectra of sampled radio blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from harrow.functions.spectra import magnitude, quantise_u16

# Four-term 92 dB Blackman-Harris window; fixed values.
BLACKMAN_HARRIS = (0.35875, 0.48829, 0.14128, 0.01168)


def window_taps(name: str | None, n: int) -> np.ndarray:
    if name in (None, "none"):
        return np.ones(n)
    if name != "blackmanharris":
        raise ValueError(f"unknown window {name!r}")
    turn = 2 * np.pi * np.arange(n) / (n - 1)
    a0, a1, a2, a3 = BLACKMAN_HARRIS
    return a0 - a1 * np.cos(turn) + a2 * np.cos(2 * turn) - a3 * np.cos(3 * turn)


def spectrum_vectors(blocks: DataFrame, window: str | None = "blackmanharris",
                     shift: bool = True, samples: str = "samples",
                     imaginary: str | None = None) -> DataFrame:
    """Windowed forward FFT of each block as arrays ``re`` and ``im``.

    One block per row, no shuffle: Arrow batches go through numpy in place.
    ``shift`` puts zero frequency in the middle. ``imaginary`` names a second
    array for complex samples.
    """
    keep = [c for c in blocks.columns if c not in (samples, imaginary)]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([blocks.schema[c] for c in keep] + [
        T.StructField("re", doubles), T.StructField("im", doubles)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c).to_pylist() for c in (samples, imaginary) if c]
            spectra = []
            for row in zip(*parts):
                x = np.asarray(row[0], dtype=float)
                x = x + 1j * np.asarray(row[1], dtype=float) if len(row) > 1 else x
                y = np.fft.fft(x * window_taps(window, len(x)))
                spectra.append(np.fft.fftshift(y) if shift else y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array([s.real for s in spectra], pa.list_(pa.float64())),
                   pa.array([s.imag for s in spectra], pa.list_(pa.float64()))],
                names=[*keep, "re", "im"])

    return blocks.select(*keep, *[c for c in (samples, imaginary) if c]).mapInArrow(run, schema)


def spectrum_fft(blocks: DataFrame, window: str | None = "blackmanharris", shift: bool = True,
                 samples: str = "samples", imaginary: str | None = None) -> DataFrame:
    """The spectra as one row per bin, bins numbered from 0."""
    vectors = spectrum_vectors(blocks, window, shift, samples, imaginary)
    keep = [c for c in vectors.columns if c not in ("re", "im")]
    return vectors.select(
        *keep, F.posexplode(F.arrays_zip("re", "im")).alias("bin", "_c")).select(
        *keep, "bin", F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))


def spectrum_average(df: DataFrame, n: int = 256, keys: tuple[str, ...] = ("device",),
                     frame: str = "frame") -> DataFrame:
    """Complex mean per bin over each run of n consecutive frames."""
    block = F.floor(F.col(frame) / F.lit(n)).cast("bigint").alias("block")
    return df.groupBy(*keys, block, "bin").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def keep_one_in_n(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    """Every n-th frame, the last of each run."""
    return df.where(F.pmod(F.col(frame), F.lit(n)) == n - 1)


def display_spectrum(averaged: DataFrame, scale: float = 10000.0) -> DataFrame:
    """Averaged spectra as 16-bit display vectors: magnitude after the mean."""
    keys = [c for c in averaged.columns if c not in ("bin", "re", "im")]
    level = quantise_u16(magnitude("re", "im"), scale)
    ordered = F.array_sort(F.collect_list(F.struct("bin", level.alias("v"))))
    return averaged.groupBy(*keys).agg(F.transform(ordered, lambda e: e["v"]).alias("levels"))
