"""Readers."""

from harrow.sources.logs import (
    parse_can_text, read_can_csv, read_cell_log, read_counters, read_probes,
    read_signal_dictionary, signal_dictionary_rejects)
from harrow.sources.messages import (
    json_reject_split, message_stream, read_bus_messages, read_gpsd, read_raw_frames,
    read_signals, read_spectrum, read_tuner)
from harrow.sources.messages import split_rejects
from harrow.sources.tables import read_days, read_jdbc_window, read_table_window

__all__ = sorted(n for n in dir() if not n.startswith("_"))
