"""Operators: DataFrame in, DataFrame out."""

from harrow.operators.alerts import (
    alert_fanout, phone_filter, rising_edge_alerts, subscriber_set)
from harrow.operators.asof import asof_join, signal_position_asof
from harrow.operators.batches import batch_rows
from harrow.operators.constraints import constraint_split, first_per_key
from harrow.operators.counters import (
    bus_activity, can_link_filter, idle_detect, interface_resolve, interface_traffic)
from harrow.operators.fleet import (
    device_label, export_range, fleet_state, latest_row, newest_n, newest_one, newest_time,
    online_transitions, staleness)
from harrow.operators.gps import (
    add_ingest_time, class_union, export_bounds, gps_class_filter, high_water_mark, high_water_marks,
    segment_assign, segment_order, time_range_filter, trail_documents, upload_batches)
from harrow.operators.j1939 import (
    frame_to_bus_message, frame_to_message, j1939_decode_id, j1939_only, logs_to_frames,
    signal_decode, signals_to_messages, stats_to_messages, valid_signal_filter)
from harrow.operators.ledger import (
    feed_split, fold_feed, ledger_backfill, ledger_from_feed, ledger_insert, ledger_mark_sent, ledger_of,
    ledger_prune, merge_folds, unsent, unsent_points, upload_retry)
from harrow.operators.modem import cell_pick_tech
from harrow.operators.pieces import (
    cut_into_pieces, ordered_scan, order_key, with_previous, with_row_number)
from harrow.operators.replay import replay_match, replay_missing, replay_unexpected
from harrow.operators.sessions import work_sessions
from harrow.operators.signals import (
    gauge_snapshot, progress_count, signal_keys, signal_stats, signal_stats_greedy)
from harrow.operators.spectrum import (
    display_spectrum, keep_one_in_n, spectrum_average, spectrum_fft, spectrum_vectors)

__all__ = sorted(n for n in dir() if not n.startswith("_"))
