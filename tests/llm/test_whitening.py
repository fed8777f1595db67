"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest

from harrow.llm import whitening
from harrow.llm.whitening import integers, leading_components, whitened

SCHEMA = "vec_id long, embedding array<float>, x string, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], SCHEMA)


def check(found, vectors, count=4):
    """Rows of ``whitened`` against the definition, for vectors by id."""
    x = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    assert len(found) == len(vectors) * count
    signs = {}
    for r in found:
        i, k = r.vec_id, r.component - 1
        assert r.n == n and r.deviation == int(((n * x[i] - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[k] / np.trace(c.T @ c / n), rel=1e-9)
        assert r.identity_error < 1e-9
        want = (x[i] - sums / n) @ basis[:, k] / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
        assert sign * r.whitened == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("dims", [3, 12, 60])
def test_against_numpy(spark, dims):
    draw = np.random.default_rng(dims)
    spread = draw.normal(size=(400, dims)) * np.linspace(3, 1, dims) + draw.normal(size=dims)
    vectors = [v.tolist() for v in spread] + [spread[0].tolist()] * 300     # a vector most rows hold
    found = whitened(table(spark, vectors).repartition(5)).collect()
    check(found, dict(enumerate(vectors)), min(4, dims))


def test_clustered_eigenvalues_and_a_bad_start(spark):
    draw = np.random.default_rng(1)
    scale = np.r_[5.0, 1.02, 1.01, 1.005, np.ones(56)]
    vectors = dict(enumerate((draw.normal(size=(3000, 60)) * scale).tolist()))
    check(whitened(table(spark, vectors.values()), spare=8).collect(), vectors)


def test_odd_vectors_and_repeated_rows(spark):
    good = {0: [1.0, 2.0], 1: [3.0, -1.5], 2: [0.25, 0.125], 9: [1.0, 2.0]}
    bad = {3: None, 4: [1.0, None], 5: [float("nan"), 1.0], 6: [float("inf"), 0.0], 7: [], 8: [1.0, 2.0, 3.0]}
    data = [(i, v, "x", None) for i, v in {**good, **bad}.items()]
    check(whitened(spark.createDataFrame(data, SCHEMA)).collect(), good, 2)
    twice = whitened(spark.createDataFrame(data + [(1, good[1], None, 3), (None, good[2], None, 3)], SCHEMA)).collect()
    assert len(twice) == 12 and len([r for r in twice if r.vec_id == 1]) == 4
    assert {r.n for r in twice} == {3}


@pytest.mark.parametrize("vectors, count", [([], 0), ([None], 0), ([[1.0, 2.0]] * 5, 0), ([[0.0, 0.0], [1.0, 1.0]], 1)])
def test_too_little_variance(spark, vectors, count):
    found = whitened(table(spark, vectors)).collect()
    assert {r.component for r in found} == set(range(1, count + 1))
    assert len(found) == count * len(vectors)


def test_values_beyond_longs(spark):
    rows = spark.createDataFrame([(i, [v, 1.0 * i]) for i, v in enumerate([1e300, -1e300, 5.0])],
                                 "vec_id long, embedding array<double>")
    found = whitened(rows).where("component = 1").orderBy("vec_id").collect()
    # The ends of the range nearly cancel in the sum, so the third vector is exact.
    assert [r.deviation for r in found] == [None, None, (3 * 1280 - 1279) ** 2 + (3 * 512 - 768) ** 2]
    assert all(math.isfinite(r.whitened) for r in found)


def test_sums_over_more_tasks(spark, monkeypatch):
    draw = np.random.default_rng(2)
    vectors = dict(enumerate((draw.normal(size=(300, 6)) * [4, 3, 2, 1.5, 1, 1]).tolist()))
    monkeypatch.setattr(whitening, "ROWS_A_TASK", 20)
    monkeypatch.setattr(whitening, "DIRECT", 2)
    check(whitened(table(spark, vectors.values())).collect(), vectors)


def test_rounds_that_do_not_settle(spark):
    draw = np.random.default_rng(3)
    fit = integers(table(spark, (draw.normal(size=(200, 40))).tolist()))
    with pytest.raises(RuntimeError, match="residual"):
        leading_components(fit, spare=4, degree=3, rounds=1)
