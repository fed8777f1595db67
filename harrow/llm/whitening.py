"""Embedding whitening by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.common import read, stage, summed
from harrow.llm.registry import query

SCALE = 256          # an entry c becomes the integer floor(SCALE * c)
COMPONENTS = 4
SPARE = 36           # further directions of the block; more make the filter steeper
FRESH = 2            # directions drawn anew in each round
BORDER = 6           # the Ritz value, from the least, up to which the filter damps
DEGREE = 16          # of the polynomial, at most: passes over the vectors in a round
ROUNDS = 64
CERTAIN = 2e-14      # residual of a component, of the greatest eigenvalue, that ends the rounds at once
LEAST_CERTAIN = 1e-12  # and the greatest one that is accepted when a round no longer lowers it
RANK = 1e-12         # of the greatest eigenvalue: components of less variance are none
SPREAD = 1e10        # to which a round may pull components apart; more would drown the lesser ones
ROWS_A_TASK = 50_000
DIRECT = 64          # tasks whose sums the driver adds by itself


@dataclass
class Components:
    """Eigenvectors (columns) and eigenvalues of the covariance of ``n`` vectors of sums ``sums``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float = 0.0
    identity_error: float = 0.0


def integers(rows: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows whose vector has finite entries alone, with it as integers ``x``.

    Vectors that are NULL, empty, or hold a NULL, NaN or infinite entry go. An entry past
    the range of a long becomes the end of it.
    """
    values = F.col(embedding).cast("array<double>")
    # A NaN is greater than any number, so one bound serves for NaN and infinity.
    finite = F.forall(values, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return rows.where((F.size(values) > 0) & finite).withColumn(
        "x", F.transform(values, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of a batch as rows of longs."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension; halves of 32 bits add up in the partitions."""
    def part(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            x = _matrix(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": np.arange(len(high), dtype=np.int32), "n": np.full(len(high), n),
                "high": high, "low": low})

    parts = fit.select("x").mapInArrow(part, "i int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    totals = parts.groupBy("i").agg(F.sum("n").alias("n"), *wide).orderBy("i").collect()   # a row per dimension
    return (totals[0]["n"] if totals else 0), [int(r["high"]) * 2 ** 32 + int(r["low"]) for r in totals]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: exact longs; exact Python numbers where longs would not do."""
    reach = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(abs(s) for s in sums)
    if reach < 2 ** 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def _summed(fit: DataFrame, n: int, partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all ``n`` vectors of ``partial(matrix)``."""
    return summed(fit.select("x"), lambda batch: partial(_matrix(batch)), shape, n // ROWS_A_TASK, DIRECT)


def covariance_times(fit: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """V Q for the covariance V of the fit list: one pass of centred X'(X Q) / n; V is never formed."""
    def partial(x):
        c = centred(x, n, sums)
        return c.T @ (c @ block)

    return _summed(fit, n, partial, block.shape) / n


def leading_components(fit: DataFrame, count: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE,
                       rounds: int = ROUNDS, seed: int = 13) -> Components:
    """The ``count`` eigenvectors of greatest eigenvalue of the covariance of all ``x`` of ``fit``.

    A round runs a block of directions through a Chebyshev polynomial of the covariance that
    stays small on [0, b] and grows steeply above it, b being one of the least Ritz values of the block; then
    comes a QR decomposition and a Rayleigh-Ritz step. Some directions of each round are
    drawn anew, so that none is missed for a bad start. Rounds end when the residual |V q - e q| of each component
    is at most ``CERTAIN`` of the greatest eigenvalue, or no longer falls; one above ``LEAST_CERTAIN`` then
    raises. Fewer components come back where the vectors have fewer dimensions of positive variance.
    """
    n, sums = _exact_sums(fit)
    d = len(sums)
    none = Components(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    if not n:
        return none

    def squares(x):
        return (centred(x, n, sums) ** 2).sum(axis=0)[:, None]

    trace = float(_summed(fit, n, squares, (d, 1)).sum() / n)
    if trace <= 0:
        return none
    k = min(d, count + spare)
    draw = np.random.default_rng(seed)

    def ritz(block):
        """Ritz vectors of the space of a block, V times them, and Ritz values; greatest first."""
        q, _ = np.linalg.qr(block)
        vq = covariance_times(fit, n, sums, q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        return q @ turn[:, ::-1], vq @ turn[:, ::-1], values[::-1]

    q, vq, values = ritz(draw.normal(size=(d, k)))
    before = np.inf
    for _ in range(rounds):
        wanted = int(min(count, (values > RANK * values[0]).sum()))
        gaps = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        residual = float(gaps.max() / values[0])
        if k == d or residual <= CERTAIN or before <= residual <= LEAST_CERTAIN:
            return Components(n, sums, _unit(q[:, :wanted]), values[:wanted], trace, residual)
        before = residual
        # Components that are there are held apart, so that those less far above b show.
        held = int(np.argmin(np.append(gaps <= CERTAIN * values[0], False)))
        apart, low, rest = q[:, :held], q[:, held:], vq[:, held:]
        # The polynomial: T_j((2 V - b) / b), scaled by its value at the greatest Ritz value left.
        b = max(float(values[-min(BORDER, k - wanted)]), RANK * float(values[0]))
        sigma = first = b / (2 * float(values[held]) - b)
        steps = int(np.clip(np.log(2 * SPREAD) / max(np.arccosh(max(1 / first, 1)), 1e-3), 2, degree))
        high = (rest - b / 2 * low) * (2 / b) * sigma
        for _ in range(steps - 1):
            high = high - apart @ (apart.T @ high)
            sigma_next = 1 / (2 / first - sigma)
            up = covariance_times(fit, n, sums, high)
            low, high = high, (up - b / 2 * high) * (4 / b) * sigma_next - sigma * sigma_next * low
            sigma = sigma_next
        fresh = min(FRESH, k - wanted)
        if fresh:
            high[:, -fresh:] = draw.normal(size=(d, fresh)) * np.linalg.norm(high[:, :1])
        high = high / np.linalg.norm(high, axis=0)
        q, vq, values = ritz(np.hstack([apart, high - apart @ (apart.T @ high)]))
    raise RuntimeError(f"components did not settle in {rounds} rounds: residual {residual:.1e}")


def _unit(q: np.ndarray) -> np.ndarray:
    """Unit columns; of either sign the one whose greatest entry is positive."""
    q = q / np.linalg.norm(q, axis=0)
    return q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])


def projected(x: np.ndarray, c: Components) -> np.ndarray:
    return centred(x, c.n, c.sums) @ c.vectors / np.sqrt(c.values)


def identity_error(fit: DataFrame, c: Components) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(c.values)
    if not k:
        return 0.0
    means = _summed(fit, c.n, lambda x: projected(x, c).sum(axis=0)[None, :], (1, k))[0] / c.n

    def spread(x):
        w = projected(x, c) - means
        return w.T @ w

    return float(np.abs(_summed(fit, c.n, spread, (k, k)) / c.n - np.eye(k)).max())


WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def whitened(rows: DataFrame, count: int = COMPONENTS, **settings) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component.

    Vectors become integers (``integers``). Equal ones are fitted once; every row is projected,
    also one with a NULL or repeated id. The dimension is the one most rows have (of equally many
    the least); vectors of another are left out. Components of equal eigenvalue are any
    basis of their space. No vectors, or vectors that are all the same, have no component and give no rows.
    ``deviation``, the sum of (n * x - S)^2, is exact, and NULL beyond the range of a long.
    """
    known = stage(integers(rows).select("vec_id", "x"), "vectors")
    sizes = known.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("many"))
    most = sizes.orderBy(F.desc("many"), "dim").first()
    known = known.where(F.size("x") == (most["dim"] if most else 0))
    fit = known.select("x").distinct()
    tasks = 1 + (most["many"] if most else 0) // ROWS_A_TASK
    fit = stage(fit.coalesce(tasks), "fit")
    c = leading_components(fit, count, **settings)
    c.identity_error = identity_error(fit, c)
    k = len(c.values)

    def project(batches):
        for batch in batches:
            ids = batch.column("vec_id").cast(pa.int64())
            if not len(ids) or not k:
                continue
            x = _matrix(batch)
            off = deviations(x, c.n, c.sums)
            if off.dtype != object and float(np.abs(off).max()) ** 2 * x.shape[1] >= 2 ** 62:
                off = off.astype(object)
            total = (off * off).sum(axis=1)
            exact = [int(t) if t < 2 ** 63 else None for t in total.tolist()]
            w = projected(x, c)
            repeat = np.repeat(np.arange(len(ids)), k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                 pa.array(np.full(len(repeat), c.n)), pa.array(exact, pa.int64()).take(pa.array(repeat)),
                 pa.array(w.ravel()), pa.array(np.tile(c.values / c.trace, len(ids))),
                 pa.array(np.full(len(repeat), c.identity_error))],
                names=[f.split()[0] for f in WHITENED.split(", ")])

    return known.mapInArrow(project, WHITENED)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(read(spark, sf, "embeddings"))
