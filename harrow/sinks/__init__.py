"""Writers.

Rows are rebalanced on the partition columns before a partitioned write:
AQE then makes files of an even size, merging small partitions and splitting
large ones, so a busy bus or day is written by many tasks.
"""

from harrow.sinks.files import (
    gpx_lines, write_by_subject, write_can_csv_rotated, write_cell_log, write_gpx,
    write_trail_documents)
from harrow.sinks.tables import accept_new, write_hypertable, write_jdbc

__all__ = sorted(n for n in dir() if not n.startswith("_"))
