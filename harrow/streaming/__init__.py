"""Structured Streaming forms of the operators.

Row-wise operators and joins with static tables take streams as they are; the
operators here keep state or write tables. Rows of a key are ordered inside a
micro-batch by (time, id); between batches arrival order counts, so a row that
comes late is handled when it comes. How many rows of one key meet in one
task is bounded by the source's per-trigger limit (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``).
"""

from harrow.streaming.aggregates import (
    stream_constraint_split, stream_gauges, stream_signal_stats, stream_staleness, stream_subscribers)
from harrow.streaming.event_time import (
    in_event_order, read_batches, stream_position_asof, stream_replay_balance, stream_split_late,
    stream_work_sessions, timer_state)
from harrow.streaming.ledger_feed import (
    merge_days, read_folds, read_ledger, stream_ledger_feed, write_feed_batch)
from harrow.streaming.runs import read_updates, run_append, run_updates
from harrow.streaming.stateful import (
    stream_idle_detect, stream_online_transitions, stream_rising_edge,
    stream_signal_stats_greedy)
from harrow.streaming.writers import (
    stream_table_writer, stream_trail_upload, upload_once, write_gpsd_batch)

__all__ = sorted(n for n in dir() if not n.startswith("_"))
