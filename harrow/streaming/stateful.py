"""Operators that look at the previous row of a key, as streams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

from harrow.functions.times import gap_text
from harrow.operators.counters import CAN_LINK, can_link_filter
from harrow.streaming.event_time import in_event_order
from harrow.streaming.keyed import Keyed, Step, before_each, bucket, filled, interval_sums, run_ends


def _per_key(df: DataFrame, keys: tuple[str, ...], columns: list[str], state: str, out: str,
             step: Step, by: list[str], event_time: dict | None = None) -> DataFrame:
    """Run ``step`` over the keys' rows of each batch, a bucket of keys at a time.

    Times pass as microseconds in ``_us``. With ``event_time``, settings of ``in_event_order``, rows
    are taken in the order of their times instead of batch by batch.
    """
    if event_time is not None:
        return in_event_order(df, keys, columns, state, out, step, by, **event_time)
    keyed = Keyed(df, keys, state, out, by)

    def run(group: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = keyed.load(held.get if held.exists else None)
        rows, starts, found = keyed.ordered(pd.concat(list(chunks), ignore_index=True), group[0])
        at, out, after = step(rows, starts, [states.get(k) for k in found])
        states.update(zip(found, after))
        held.update(keyed.save(states))
        if len(out):
            yield keyed.named(rows, at, out)

    return (
        df.select(bucket(keys).alias("_bucket"), *[filled(df, k) for k in keys], F.unix_micros("time").alias("_us"), *columns)
        .groupBy("_bucket").applyInPandasWithState(run, keyed.out_type, keyed.state_type, "append", "NoTimeout"))


def stream_rising_edge(df: DataFrame, threshold: int = 1,
                       keys: tuple[str, ...] = ("device", "subject"), event_time: dict | None = None) -> DataFrame:
    """State: the last reading. ``event_time``, e.g. ``{"delay": "10 minutes", "expiry_s": 86400}``: order by time."""
    def step(rows: pd.DataFrame, starts: np.ndarray, held: list):
        reading = rows["reading"].to_numpy()
        before = before_each(reading, starts, [h[0] if h else 0 for h in held])
        at = np.flatnonzero((reading >= threshold) & (before < threshold))
        return at, rows.iloc[at].copy(), [(int(r),) for r in reading[run_ends(starts, len(rows)) - 1]]

    out = _per_key(df, keys, ["id", "reading"], "last bigint",
                   "id bigint, _us bigint, reading bigint", step, ["_us", "id"], event_time)
    return out.select("id", *keys, F.timestamp_micros("_us").alias("time"), "reading")


def stream_online_transitions(df: DataFrame, event_time: dict | None = None) -> DataFrame:
    """State: the online flag and when the device was last seen (-1 for never). ``event_time``: order by time."""
    def step(rows: pd.DataFrame, starts: np.ndarray, held: list):
        held = [h or (False, -1) for h in held]
        ok, us = rows["ok"].to_numpy(dtype=bool), rows["_us"].to_numpy()
        ends = run_ends(starts, len(rows))
        seen = np.repeat([h[1] for h in held], ends - starts)
        good = pd.Series(np.where(ok, us, -1)).groupby(np.repeat(starts, ends - starts)).cummax().to_numpy()
        running = np.maximum(seen, good)
        at = np.flatnonzero(ok != before_each(ok, starts, [h[0] for h in held]))
        out = rows.iloc[at].copy()
        out["_seen"] = before_each(running, starts, [h[1] for h in held])[at]
        return at, out, [(bool(o), int(r)) for o, r in zip(ok[ends - 1], running[ends - 1])]

    out = _per_key(df, ("device",), ["id", "ok"], "online boolean, seen bigint",
                   "id bigint, _us bigint, ok boolean, _seen bigint", step, ["_us", "id"], event_time)
    seen = F.when(F.col("_seen") >= 0, F.col("_seen"))
    gap = F.when(F.col("ok"), F.floor((F.col("_us") - seen) / F.lit(1000000)).cast("bigint"))
    return out.select(
        "id", "device", F.timestamp_micros("_us").alias("time"),
        F.when(F.col("ok"), "online").otherwise("offline").alias("event"),
        F.timestamp_micros(seen).alias("last_seen"), gap.alias("gap_s"),
        F.when(F.col("ok"), F.coalesce(gap_text(gap), F.lit("never seen"))).alias("gap_text"))


def stream_idle_detect(counters: DataFrame, link_type: int = CAN_LINK) -> DataFrame:
    """Sample times at which all CAN links of a device together stand where they stood before.

    State: the last total, and the newest sample time with its sum so far. A sample time
    is complete when a later one of its device comes; a row that is later still is left out.
    """
    def walk(rows: pd.DataFrame, held: tuple | None):
        last, newest, total = held or (0, -1, 0)
        sums = rows[rows["_us"] >= newest].groupby("_us")["rx_bytes"].sum()
        if held:
            sums = sums.add(pd.Series({newest: total}), fill_value=0)
        us, totals = sums.index.to_numpy(np.int64), sums.to_numpy(np.int64)
        before = np.concatenate(([last], totals[:-1]))
        idle = (totals == before)[:-1]
        out = pd.DataFrame({"_us": us[:-1][idle], "rx_bytes": totals[:-1][idle]})
        return out, (int(before[-1]), int(us[-1]), int(totals[-1]))

    def step(rows: pd.DataFrame, starts: np.ndarray, held: list):
        done = [walk(rows.iloc[a:b], h) for a, b, h in zip(starts, run_ends(starts, len(rows)), held)]
        at = np.repeat(starts, [len(out) for out, _ in done])
        return at, pd.concat([out for out, _ in done], ignore_index=True), [after for _, after in done]

    samples = can_link_filter(counters, link_type).where("rx_bytes IS NOT NULL AND time IS NOT NULL").withColumn(
        "rx_bytes", F.col("rx_bytes").cast("bigint"))
    out = _per_key(samples, ("device",), ["rx_bytes"], "last bigint, newest bigint, total bigint",
                   "_us bigint, rx_bytes bigint", step, ["_us"])
    return out.select("device", F.timestamp_micros("_us").alias("time"), "rx_bytes")


def stream_signal_stats_greedy(df: DataFrame, min_gap_s: float = 1.0,
                               keys: tuple[str, ...] = ("device", "name"),
                               event_time: dict | None = None) -> DataFrame:
    """Publish when a message comes ``min_gap_s`` after the last publication.

    State: the last publication and the open interval's count, sum, sum of
    squares and first time. ``event_time``: order by time. Unit, group and bounds of a signal are those of the row that
    publishes, where ``df`` has them.
    """
    described = [c for c in ("pgn", "units", "min_value", "max_value") if c in df.columns]
    gap = int(round(min_gap_s * 1_000_000))

    def step(rows: pd.DataFrame, starts: np.ndarray, held: list):
        us, value = rows["_us"].to_numpy(), rows["value"].to_numpy(dtype=float)
        ends, closing, opening, after = run_ends(starts, len(rows)), [], [], []
        # Rows without a time come last in their run and publish nothing.
        timed, times = np.add.reduceat(~np.isnan(us), starts).tolist(), us.tolist()
        carried = []
        for a, b, known, h in zip(starts.tolist(), ends.tolist(), timed, held):
            last, n, total, squares, start = h or (int(times[a]), 0, 0.0, 0.0, 0)
            known += a
            while (c := bisect_left(times, last + gap, a, known)) < known:
                carried.append((n, total, squares, start))
                opening.append(a)
                closing.append(c)
                last, a, n, total, squares = int(times[c]), c + 1, 0, 0.0, 0.0
            if a < b:
                start = start if n else int(times[a])
                part = value[a:b]
                n, total, squares = n + b - a, total + float(part.sum()), squares + float((part * part).sum())
            after.append((last, n, total, squares, start))
        opening, closing = np.array(opening, dtype=np.int64), np.array(closing, dtype=np.int64)
        n, total, squares, start = np.array(carried, dtype=np.float64).reshape(-1, 4).T
        sums = [interval_sums(v, opening, closing) for v in (value, value * value)]
        number = n.astype(np.int64) + closing - opening + 1
        out = pd.DataFrame({
            "number": number, "sum_val": total + sums[0], "sum_of_squares": squares + sums[1],
            "average": (total + sums[0]) / number,
            "_from": np.where(n > 0, start, us[opening]).astype(np.int64), "_to": us[closing].astype(np.int64)})
        for c in described:
            out[c] = rows[c].iloc[closing].to_numpy()
        return closing, out, after

    out = _per_key(
        df.where(F.col("value").isNotNull()), keys, ["id", "value", *described],
        "last bigint, n bigint, total double, squares double, start bigint",
        "number bigint, sum_val double, sum_of_squares double, average double, "
        + ", ".join(["_from bigint, _to bigint", *[
            f"{c} {df.schema[c].dataType.simpleString()}" for c in described]]), step, ["_us", "id"], event_time)
    return out.select(
        *keys, "number", "sum_val", "sum_of_squares", "average",
        F.timestamp_micros("_from").alias("from_time"),
        F.timestamp_micros("_to").alias("to_time"), *described, F.timestamp_micros("_to").alias("last_sent"))
