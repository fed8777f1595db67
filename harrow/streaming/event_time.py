"""Streams in the order of event time: late rows are kept apart, silent keys are forgotten.

``stream_split_late`` parts arriving rows into those in time and those that come too late, so that no
watermark further on loses a row. ``in_event_order`` then hands the rows of each key to an
operator in the order of their times, whatever order they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from harrow.streaming.keyed import Keyed, Step, before_each, bucket, filled, run_ends
from harrow.streaming.writers import found, start_batches

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Rows of a chunk that waits.
CHUNK_ROWS = 10_000


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state where timers can be kept; others are not touched."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def stream_split_late(rows: DataFrame, delay_s: float, in_time: str, late: str, clocks: str, checkpoint: str,
                      time: str = "time", available_now: bool = True) -> StreamingQuery:
    """Rows more than ``delay_s`` behind the newest one of earlier batches to ``late``, the others to ``in_time``.

    The rule is that of Spark's watermark, so a stream that reads ``in_time`` with
    ``withWatermark(time, delay)`` drops nothing. Each batch has a folder of its own in all three
    places; one that is delivered again finds the clock of the batch before and replaces
    its rows. A row without a time is late, and so is one from before 1970, where watermarks start.
    """
    delay_ms = round(delay_s * 1000)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"batch={batch_id}"
        before = found(spark, f"{clocks}/batch={batch_id - 1}", "us bigint")
        clock = None if before is None else before.first()[0]
        us = F.unix_micros(time)
        held = batch.persist()
        try:
            newest = held.agg(F.max(us)).first()[0]
            newest = max((c for c in (newest, clock) if c is not None), default=None)
            spark.createDataFrame([(newest,)], "us bigint").coalesce(1).write.mode("overwrite").parquet(
                f"{clocks}/{here}")
            # Spark's watermark starts at 1970 and never goes back.
            bound = max(0, 0 if clock is None else (clock // 1000 - delay_ms) * 1000)
            behind = us.isNull() | (us <= bound)
            held.where(behind).write.mode("overwrite").parquet(f"{late}/{here}")
            held.where(~behind).write.mode("overwrite").parquet(f"{in_time}/{here}")
        finally:
            held.unpersist()

    return start_batches(rows, save, checkpoint, available_now)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of the rows that ``stream_split_late`` wrote to a folder."""
    return spark.readStream.schema(schema).parquet(path + "/*")


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark passes their time; timers wake the buckets of those whose time has come."""

    def __init__(self, step: Step, keyed: Keyed, columns: list[str], expiry_ms: int | None):
        self.step, self.keyed, self.columns, self.expiry_ms = step, keyed, columns, expiry_ms
        # Rows pass with names that do not begin with an underscore.
        self.passed = [f"c{i}" for i in range(len(columns))]

    def init(self, handle) -> None:
        self.handle = handle
        # Rows wait in chunks, as Arrow tables.
        self.waiting = handle.getListState("waiting", "first bigint, chunk binary")
        self.held = handle.getValueState("held", self.keyed.state_type)

    def _wake(self, ms: int) -> None:
        """One timer per bucket, at the earlier time of two."""
        for other in list(self.handle.listTimers()):
            if other <= ms:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(ms)

    def _wake_only(self, ms: int) -> None:
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        self.handle.registerTimer(ms)

    def _chunks(self, rows: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        us = self.columns.index("_us")
        for a in range(0, len(rows), CHUNK_ROWS):
            part = rows.iloc[a:a + CHUNK_ROWS]
            table, sink = pa.Table.from_pandas(part, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield int(part.iloc[:, us].min()), sink.getvalue().to_pybytes()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [chunk[self.passed] for chunk in rows]
        if frames:
            chunks = list(self._chunks(pd.concat(frames, ignore_index=True)))
            self.waiting.appendList(chunks)
            # An expiry that is set is put off: rows are here again.
            self._wake(-(-min(c[0] for c in chunks) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        chunks = list(self.waiting.get())
        ready = [c for c in chunks if c[0] <= watermark * 1000]
        rest = [c for c in chunks if c[0] > watermark * 1000]
        states = self.keyed.load(self.held.get() if self.held.exists() else None)
        if ready:
            frame = pd.concat([pa.ipc.open_stream(c[1]).read_pandas() for c in ready], ignore_index=True)
            frame.columns = self.columns
            now = frame["_us"] <= watermark * 1000
            rest += self._chunks(frame[~now].set_axis(self.passed, axis=1))
            rows, starts, found = self.keyed.ordered(frame[now], key[0])
            at, out = self._stepped(rows, starts, found, states)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            if len(out):
                yield self.keyed.named(rows, at, out)
        wake = [-(-c[0] // 1000) for c in rest]
        if self.expiry_ms is not None:
            expires = {k: s[-1] // 1000 + self.expiry_ms for k, s in states.items()}
            over = {k for k, ms in expires.items() if ms <= watermark}
            if over and rest:
                # A key whose rows wait is asked again when they come.
                over -= self._keys_of(rest, key[0])
            states = {k: s for k, s in states.items() if k not in over}
            wake += [ms for k, ms in expires.items() if ms > watermark]
        if states:
            self.held.update(self.keyed.save(states))
        else:
            self.held.clear()
        if wake:
            self._wake_only(min(wake))

    def _keys_of(self, chunks: list, bucket: int) -> set[tuple]:
        frame = pd.concat([pa.ipc.open_stream(c[1]).read_pandas() for c in chunks], ignore_index=True)
        frame.columns = self.columns
        return set(self.keyed.ordered(frame, bucket)[2])

    def _stepped(self, rows: pd.DataFrame, starts: np.ndarray, found: list[tuple],
                 states: dict[tuple, tuple]) -> tuple[np.ndarray, pd.DataFrame]:
        """Runs the step and keeps the states; where a key was silent for longer than the expiry it begins without one."""
        us = rows["_us"].to_numpy()
        held = [states[k][:-1] if k in states else None for k in found]
        runs, ends = starts, run_ends(starts, len(rows))
        if self.expiry_ms is not None:
            seen = [states[k][-1] if k in states else int(us[a]) for k, a in zip(found, starts)]
            silent = us - before_each(us, starts, seen) > self.expiry_ms * 1000
            begins = silent.copy()
            begins[starts] = True
            runs = np.flatnonzero(begins)
            known = dict(zip(starts.tolist(), held))
            held = [None if silent[a] else known[a] for a in runs.tolist()]
        at, out, after = self.step(rows, runs, held)
        last = np.searchsorted(runs, ends) - 1
        for k, i, b in zip(found, last.tolist(), ends.tolist()):
            states[k] = (*after[i], int(us[b - 1]))
        return at, out

    def close(self) -> None:
        pass


def in_event_order(df: DataFrame, keys: tuple[str, ...], columns: list[str], state: str, out: str, step: Step,
                   by: list[str], delay: str, expiry_s: float | None = None) -> DataFrame:
    """Run ``step`` over each key's rows in the order of time, a bucket of keys at a time.

    Times pass as microseconds in ``_us``. A row waits in state until the watermark, ``delay`` behind the newest
    time, has passed it; what waits is bounded by what comes in a delay. The state of a key is dropped when the
    watermark has passed its last row by ``expiry_s``, and a row that comes so long after the one
    before finds none, so results do not depend on batches. Start the query under ``timer_state``.
    """
    columns = [*keys, "_us", *columns]
    keyed = Keyed(df, keys, state + ", _seen bigint", out, by)
    processor = _InOrder(step, keyed, columns, None if expiry_s is None else round(expiry_s * 1000))
    rows = df.withWatermark("time", delay).withColumn("_us", F.unix_micros("time")).select(
        bucket(keys).alias("bucket"), "time", *[
            (filled(df, c) if c in keys else F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return rows.groupBy("bucket").transformWithStateInPandas(processor, keyed.out_type, "append", "EventTime")


def stream_position_asof(signals: DataFrame, points: DataFrame, delay: str, tolerance_s: float | None = 60.0,
                         key: str = "device", expiry_s: float | None = None) -> DataFrame:
    """``signal_position_asof`` as a stream: ``id, device, name, time, value, lat, lon, position_time``.

    Both streams are united; the position last passed is the state. Of positions at one
    instant the one of the greatest id counts, and it is there for signals of that instant.
    """
    tolerance = None if tolerance_s is None else round(tolerance_s * 1_000_000)
    nothing = {c: F.lit(None).cast(t) for c, t in (("lat", "double"), ("lon", "double"))}
    ours = signals.select("id", key, "time", F.col("name").cast("string"), F.col("value").cast("double"),
                          *[c.alias(n) for n, c in nothing.items()], F.lit(1).alias("_side"))
    theirs = points.select("id", key, "time", F.lit(None).cast("string").alias("name"),
                           F.lit(None).cast("double").alias("value"), F.col("lat").cast("double"),
                           F.col("lon").cast("double"), F.lit(0).alias("_side"))

    def step(rows: pd.DataFrame, starts: np.ndarray, held: list):
        here, ends = rows["_side"].eq(0).to_numpy(), run_ends(starts, len(rows))
        begins = here.copy()
        begins[starts] = True
        # The last position up to each row, or the row where its run begins.
        place = np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))
        known = np.array([h or (None, None, None) for h in held], dtype=float)
        run = np.repeat(np.arange(len(starts)), ends - starts)
        at, lat, lon = (np.where(here[place], rows[c].to_numpy(dtype=float)[place], known[run, i])
                        for i, c in enumerate(("_us", "lat", "lon")))
        asked = np.flatnonzero(~here)
        out = rows.loc[asked, ["id", "_us", "name", "value"]].copy()
        near = ~np.isnan(at[asked])
        if tolerance is not None:
            near &= rows["_us"].to_numpy()[asked] - at[asked] <= tolerance
        for c, found in (("lat", lat), ("lon", lon), ("_at", at)):
            out[c] = np.where(near, found[asked], np.nan)
        out["_at"] = out["_at"].astype("Int64")
        after = [(None, None, None) if np.isnan(at[b]) else (int(at[b]), float(lat[b]), float(lon[b]))
                 for b in (ends - 1).tolist()]
        return asked, out, after

    out = in_event_order(
        ours.unionByName(theirs), (key,), ["id", "name", "value", "lat", "lon", "_side"],
        "at bigint, lat double, lon double",
        "id bigint, _us bigint, name string, value double, lat double, lon double, _at bigint",
        step, ["_us", "_side", "id"], delay, expiry_s)
    return out.select("id", key, "name", F.timestamp_micros("_us").alias("time"), "value", "lat", "lon",
                      F.timestamp_micros("_at").alias("position_time"))


def stream_work_sessions(rows: DataFrame, gap_s: float, delay: str, keys: tuple[str, ...] = ("device",),
                         measures: tuple[str, ...] = ()) -> DataFrame:
    """``work_sessions`` as a stream in append mode.

    A session is published when the watermark has passed its last row by the gap.
    """
    from harrow.operators.sessions import session_measures

    window = F.session_window("time", f"{round(gap_s * 1_000_000)} microseconds")
    grouped = rows.withWatermark("time", delay).groupBy(*keys, window.alias("_session")).agg(
        F.max("time").alias("end_time"), F.count(F.lit(1)).alias("rows"),
        *[c.alias(n) for n, c in session_measures(measures).items()])
    start = F.col("_session.start")
    return grouped.select(
        *keys, start.alias("start_time"), "end_time",
        ((F.unix_micros("end_time") - F.unix_micros(start)) / 1_000_000).alias("duration_s"), "rows",
        *session_measures(measures))


def stream_replay_balance(sent: DataFrame, received: DataFrame, within_s: float, delay: str,
                          keys: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """Live comparison of messages sent with messages received, copies counted: ``replay_match`` as a stream.

    Copies of one message, of either side, that follow each other within ``within_s`` are settled
    together: ``first_time, last_time, sent, received, matched, missing, unexpected``, published once when the
    watermark has passed the last of them by that time. Counts are combined before the shuffle and
    are all the state, so a message that makes up most of the traffic is no burden. Rows
    without a time are left out; part late ones off with ``stream_split_late``.
    """
    def side(df: DataFrame, ours: int) -> DataFrame:
        return df.where(F.col("time").isNotNull()).select(*keys, "time", F.lit(ours).alias("_sent"))

    window = F.session_window("time", f"{round(within_s * 1_000_000)} microseconds")
    counted = side(sent, 1).union(side(received, 0)).withWatermark("time", delay).groupBy(
        *keys, window.alias("_session")).agg(
        F.max("time").alias("last_time"), F.sum("_sent").alias("sent"),
        F.sum(1 - F.col("_sent")).alias("received"))
    return counted.select(
        *keys, F.col("_session.start").alias("first_time"), "last_time", "sent", "received",
        F.least("sent", "received").alias("matched"),
        F.greatest(F.col("sent") - F.col("received"), F.lit(0)).alias("missing"),
        F.greatest(F.col("received") - F.col("sent"), F.lit(0)).alias("unexpected"))
