"""Signal statistics and last values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from harrow.operators.pieces import (
    IS_CUT, PIECE, cut_into_pieces, order_key, shuffle_tasks)


def statistics() -> list:
    value = F.col("value")
    return [
        F.count(F.lit(1)).alias("number"), F.sum(value).alias("sum_val"),
        F.sum(value * value).alias("sum_of_squares"), F.avg(value).alias("average"),
        F.min("time").alias("from_time"), F.max("time").alias("to_time"),
    ]


def metadata(df: DataFrame) -> list:
    """Bounds are constant per signal; max picks them the same way each run."""
    return [F.max(c).alias(c) for c in ("pgn", "min_value", "max_value") if c in df.columns]


def unit_key(df: DataFrame) -> list[str]:
    """Units are a grouping key: values of two units have no common sum, and
    as an aggregate a text would turn hash aggregation into sorting."""
    return ["units"] if "units" in df.columns else []


def signal_stats(df: DataFrame, width: str = "1 second",
                 keys: tuple[str, ...] = ("device", "name")) -> DataFrame:
    """Count, sum, sum of squares, mean and extent per signal and time window.

    All aggregates combine before the shuffle, so a busy signal costs one row
    per window and map task.
    """
    return (
        df.groupBy(F.window("time", width), *keys, *unit_key(df))
        .agg(*statistics(), *metadata(df))
        .select(F.col("window.start").alias("window_start"), *keys,
                "number", "sum_val", "sum_of_squares", "average", "from_time", "to_time",
                *[c for c in ("pgn", "units", "min_value", "max_value") if c in df.columns]))


def signal_keys(df: DataFrame, subject: str = "subject") -> DataFrame:
    return df.select(subject).distinct()


def gauge_snapshot(df: DataFrame, keys: tuple[str, ...] = ("device",), tie: str = "id",
                   prefix: str = "j1939") -> DataFrame:
    """Last value of each metric, newest by (time, tie)."""
    described = [c for c in ("description",) if c in df.columns]
    return (
        df.groupBy(*keys, "name", *described)
        .agg(F.max_by("value", order_key("time", tie)).alias("value"), F.max("time").alias("time"))
        .select(*keys, F.concat(F.lit(prefix + "_"), F.col("name")).alias("metric"),
                "value", "time", *described))


def progress_count(df: DataFrame, every: int = 1000) -> DataFrame:
    """Messages processed, and how many whole thousands were reported."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "reports", F.floor(F.col("n") / F.lit(every)).cast("bigint"))


# --- statistics published on arrival -------------------------------------
#
# A signal publishes when a message arrives at least ``gap`` after the last
# publication; the first message only starts the clock. Where the next
# interval ends depends on where the last one did, so the rule walks a signal
# in order and labels each row with the publication that opened its interval.
# The statistics are then an ordinary grouped aggregate.
#
# Signals too large for one task are cut into pieces:
#   1. each piece is walked once for every publication time that could enter
#      it (as many as distinct times in its first ``gap``), giving a table
#      "entered with -> left with". A piece spans many gaps, so that its table
#      is a small part of it however long the gap is;
#   2. the tables of a signal are walked in order, as rows, holding one number;
#   3. the entry that results travels to its piece, which is labelled as usual.

_US = 1_000_000
# Gaps that a piece spans at the least.
GAPS_PER_PIECE = 16
# Rows of a table that leave a task in one batch.
_TABLE_ROWS = 65_536


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Positions where a new piece starts, and the end, of a sorted batch."""
    n = batch.num_rows
    differs = np.zeros(n - 1, dtype=bool)
    for key in keys:
        column = batch.column(key)
        differs |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(
            zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(differs) + 1, [n]))


def _key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _advance(times: np.ndarray, anchors: np.ndarray, gap: int) -> np.ndarray:
    """Follow publications through ``times`` from each anchor; last one of each."""
    anchors = anchors.copy()
    moving = np.arange(len(anchors))
    while len(moving):
        found = np.searchsorted(times, anchors[moving] + gap)
        inside = found < len(times)
        moving = moving[inside]
        anchors[moving] = times[found[inside]]
    return anchors


class _PieceTable:
    """Publication table of one piece, built from its batches in order."""

    def __init__(self, key: tuple, first: int):
        self.key, self.first = key, first
        self.heads = np.empty(0, dtype=np.int64)
        self.lasts = np.empty(0, dtype=np.int64)
        self.open = True

    def add(self, times: np.ndarray, gap: int) -> None:
        heads = np.empty(0, dtype=np.int64)
        if self.open:
            # Candidates end with the first row that is ``gap`` past the start.
            end = int(np.searchsorted(times, self.first + gap))
            self.open = end == len(times)
            heads = np.setdiff1d(times[:end + 1], self.heads)
        starts, back = np.unique(np.concatenate((self.lasts, heads)), return_inverse=True)
        self.lasts = _advance(times, starts, gap)[back]
        self.heads = np.concatenate((self.heads, heads))

    def entries(self, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Rising ``entered`` with what each leaves; neighbours that leave alike are one entry."""
        keep = np.append(self.lasts[1:] != self.lasts[:-1], True)
        return self.heads[keep] - gap, self.lasts[keep]


def _tables(keys: list[str], gap: int, schema: pa.Schema):
    def emit(table: _PieceTable) -> Iterator[pa.RecordBatch]:
        entered, left = table.entries(gap)
        for a in range(0, len(entered), _TABLE_ROWS):
            n = len(entered[a:a + _TABLE_ROWS])
            values = [*([k] * n for k in (*table.key, table.first)),
                      entered[a:a + _TABLE_ROWS], left[a:a + _TABLE_ROWS]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            times, edges = batch.column("_us").to_numpy(), _changes(batch, keys).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                key = _key_at(batch, keys, a)
                if current is None or current.key != key:
                    if current is not None:
                        yield from emit(current)
                    current = _PieceTable(key, int(times[a]))
                current.add(times[a:b], gap)
        if current is not None:
            yield from emit(current)
    return run


def _chain(keys: list[str], schema: pa.Schema):
    """Walk sorted table rows; one row per piece with the publication that enters it.

    Holds the publication before the piece and the one that leaves it, no table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, enters, leaves = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            entered, left = batch.column("entered").to_numpy(), batch.column("left").to_numpy()
            edges = _changes(batch, [*keys, PIECE]).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                here = _key_at(batch, [*keys, PIECE], a)
                if here != piece:
                    if piece is None or here[:-1] != piece[:-1]:
                        enters = batch.column("first")[a].as_py()
                    elif leaves is not None:
                        enters = leaves
                    piece, leaves = here, None
                    found.append((*here, enters))
                if leaves is None:
                    at = a + int(np.searchsorted(entered[a:b], enters))
                    leaves = int(left[at]) if at < b else None
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    return run


def _publications(times: np.ndarray, last: int, gap: int) -> np.ndarray:
    """Which rows publish, given the publication before them."""
    closes = np.zeros(len(times), dtype=bool)
    # A row that comes ``gap`` after its neighbour publishes in any case, so
    # only the rows between such rows depend on what was published before.
    sure = np.flatnonzero(np.diff(times) >= gap) + 1
    closes[sure] = True
    starts = np.concatenate(([0], sure))
    ends = np.concatenate((sure, [len(times)]))
    long = (ends - starts > 1) | (starts == 0)
    for start, end in zip(starts[long].tolist(), ends[long].tolist()):
        if start:
            last, start = int(times[start]), start + 1
        while start < end:
            start += int(np.searchsorted(times[start:end], last + gap))
            if start < end:
                closes[start], last = True, int(times[start])
            start += 1
    return closes


def _label(keys: list[str], gap: int):
    """Label rows in order. A header row before a piece brings its entry;
    without one the first row starts the clock."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            times = batch.column("_us").to_numpy()
            header = batch.column("_header").to_numpy(zero_copy_only=False)
            opened = np.zeros(n, dtype=np.int64)
            closes = np.zeros(n, dtype=bool)
            edges = _changes(batch, keys).tolist()
            goes_on = _key_at(batch, keys, 0) == current
            for a, b in zip(edges[:-1], edges[1:]):
                if a or not goes_on:
                    last = int(times[a])
                a += bool(header[a])
                if a == b:
                    continue
                part = times[a:b]
                published = _publications(part, last, gap)
                # The publication before each row: the last one at a lower index.
                at = np.maximum.accumulate(np.where(published, np.arange(b - a), -1))
                before = np.concatenate(([-1], at[:-1]))
                opened[a:b] = np.where(before >= 0, part[before], last)
                closes[a:b] = published
                last = int(part[at[-1]]) if at[-1] >= 0 else last
            current = _key_at(batch, keys, n - 1)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(opened), pa.array(closes)],
                names=[*names, "_opened", "_closes"]).filter(pa.array(~header))
    return run


def _entries(cut: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Publication that enters each piece of the signals that were cut."""
    piece = [*keys, PIECE]
    key_fields = [cut.schema[k] for k in piece]
    number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    kind = T.StructType(key_fields + number("first", "entered", "left"))
    entry = T.StructType(key_fields + number("_entry"))
    tables = (
        cut.where(IS_CUT).select(*piece, "_us")
        .repartition(shuffle_tasks(cut), *piece).sortWithinPartitions(*piece, "_us")
        .mapInArrow(_tables(piece, gap, to_arrow_schema(kind)), kind))
    return (
        tables.repartition(*keys).sortWithinPartitions(*piece, "entered")
        .mapInArrow(_chain(keys, to_arrow_schema(entry)), entry))


def signal_stats_greedy(df: DataFrame, min_gap_s: float = 1.0,
                        keys: tuple[str, ...] = ("device", "name"), tie: str = "id",
                        max_rows: int | None = None) -> DataFrame:
    """Statistics of each published interval; an interval still open is not published."""
    gap = int(round(min_gap_s * _US))
    described = [c for c in ("pgn", "units", "min_value", "max_value") if c in df.columns]
    rows = df.where(F.col("value").isNotNull()).select(
        *keys, "time", tie, "value", *described).withColumn("_us", F.unix_micros("time"))
    cut = cut_into_pieces(rows, list(keys), "time", tie, max_rows, GAPS_PER_PIECE * gap)
    piece = list(keys) if cut is None else [*keys, PIECE]
    fields = [*piece, "_us", tie, "value", *described]
    walked = (rows if cut is None else cut).select(*fields, F.lit(False).alias("_header"))
    if cut is not None:
        # The entry of a piece travels as a header row that sorts before its
        # rows: one shuffle instead of a join and a second one.
        values = fields[len(piece) + 1:]
        walked = walked.union(_entries(cut, list(keys), gap).select(
            *piece, F.col("_entry").alias("_us"),
            *[F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in values],
            F.lit(True).alias("_header")))
    # A fixed number of tasks: AQE would merge them by bytes, and the cost is the walk.
    labelled = (
        walked.repartition(shuffle_tasks(df), *piece)
        .sortWithinPartitions(*piece, F.col("_header").desc(), "_us", tie)
        .mapInArrow(_label(piece, gap), T.StructType(
            [walked.schema[c] for c in fields]
            + [T.StructField("_opened", T.LongType()), T.StructField("_closes", T.BooleanType())]))
        .withColumn("time", F.timestamp_micros("_us")))
    return (
        labelled.groupBy(*keys, *unit_key(df), "_opened")
        .agg(*statistics(), *metadata(df), F.max("_closes").alias("_published"))
        .where("_published").withColumn("last_sent", F.col("to_time"))
        .drop("_opened", "_published"))
