"""Keys dealt into buckets, so that a stateful operator walks many keys in one call.

A Python call with its state costs about as much for one row as for thousands. Where a
fleet has many keys of few rows each, a group per key makes that cost grow with the keys; a bucket
holds the state of all its keys, in arrays, and its rows are walked together. The number of buckets
belongs to the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 1024

# step(rows, starts, held) -> (at, out, after). Rows are sorted by key and order, ``starts`` are the positions
# where a run of one key begins, ``held`` has the state before each run. ``at`` has the position of a row of
# the same key for each row of ``out``, ``after`` the state after each run.
Step = Callable[[pd.DataFrame, np.ndarray, list], tuple[np.ndarray, pd.DataFrame, list]]


def bucket(keys: tuple[str, ...]) -> Column:
    """Keys of one bucket have their NULLs in the same columns; the number of the bucket tells in which."""
    nulls = sum((F.col(k).isNull().cast("bigint") * 2 ** i for i, k in enumerate(keys)), F.lit(0))
    return nulls * BUCKETS + F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def filled(df: DataFrame, k: str) -> Column:
    """A key without NULLs: one NULL would make all whole numbers of an Arrow batch floats in pandas."""
    kind = df.schema[k].dataType
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(k), F.lit(0).cast(kind)).alias(k)
    return F.coalesce(F.col(k), F.lit("")).alias(k) if isinstance(kind, T.StringType) else F.col(k)


class Keyed:
    """Rows and states of the keys of a bucket."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], state: str, out: str, by: list[str]):
        types = [df.schema[k].dataType.simpleString() for k in keys]
        fields = [*types, *[c.split(" ", 1)[1] for c in state.split(", ")]]
        self.keys, self.by = keys, by
        self.state_type = ", ".join(f"c{i} array<{t}>" for i, t in enumerate(fields))
        self.out_type = ", ".join([*[f"{k} {t}" for k, t in zip(keys, types)], out])
        self.columns = [*keys, *[c.split()[0] for c in out.split(", ")]]

    def load(self, state: tuple | None) -> dict[tuple, tuple]:
        rows = zip(*state) if state else ()
        return {row[:len(self.keys)]: row[len(self.keys):] for row in rows}

    def save(self, states: dict[tuple, tuple]) -> tuple:
        return tuple(list(c) for c in zip(*[(*k, *v) for k, v in states.items()]))

    def ordered(self, rows: pd.DataFrame, bucket: int) -> tuple[pd.DataFrame, np.ndarray, list[tuple]]:
        """Rows sorted by key and order, where each key begins, and the keys."""
        codes = np.zeros(len(rows), dtype=np.int64)
        nulls = [k for i, k in enumerate(self.keys) if bucket // BUCKETS >> i & 1]
        for k in self.keys:
            if k not in nulls:
                code, values = pd.factorize(rows[k], use_na_sentinel=False)
                codes = pd.factorize(codes * len(values) + code)[0]
        rows = rows.assign(_code=codes).sort_values(["_code", *self.by], ignore_index=True)
        starts = np.flatnonzero(np.diff(rows["_code"].to_numpy(), prepend=-1))
        values = [[None] * len(starts) if k in nulls else rows[k].iloc[starts].tolist() for k in self.keys]
        return rows.assign(**dict.fromkeys(nulls)), starts, list(zip(*values))

    def named(self, rows: pd.DataFrame, at: np.ndarray, out: pd.DataFrame) -> pd.DataFrame:
        for k in self.keys:
            out[k] = rows[k].iloc[at].array
        return out[self.columns]


def run_ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def before_each(values: np.ndarray, starts: np.ndarray, first: list) -> np.ndarray:
    """The value of the row before in its run; that of the first row of each run is given."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[starts] = first
    return before


def interval_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of disjoint rising intervals, both ends included."""
    if not len(first):
        return np.zeros(0)
    cuts = np.stack((first, last + 1), axis=1).ravel()
    return np.add.reduceat(np.append(values, 0.0), cuts)[::2]
