"""Times: epoch, text, truncation and gaps. The session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(c) -> Column:
    """TIMESTAMP to epoch seconds as DOUBLE, microseconds kept."""
    return F.unix_micros(_col(c)) / F.lit(1000000.0)


def from_epoch_seconds(c) -> Column:
    """Epoch seconds as DOUBLE to TIMESTAMP, rounded to the microsecond; NULL out of range."""
    return F.timestamp_micros(F.round(_col(c) * F.lit(1000000.0)).try_cast("bigint"))


def iso_time(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(c) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` to TIMESTAMP; anything else is NULL."""
    return F.try_to_timestamp(_col(c), F.lit("yyyy-MM-dd HH:mm:ss"))


def truncate_time(c, length_s: int) -> Column:
    """Floor to a multiple of ``length_s`` seconds since the epoch."""
    whole = F.floor(F.unix_seconds(_col(c)) / F.lit(int(length_s))).cast("bigint")
    return F.timestamp_seconds(whole * F.lit(int(length_s)))


def day_of(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def gap_text(seconds) -> Column:
    """Seconds to ``D days HH hours MM minutes SS seconds``."""
    s = _col(seconds).cast("bigint")

    def part(divisor: int, modulus: int | None = None) -> Column:
        whole = F.floor(s / F.lit(divisor)).cast("bigint")
        return whole % F.lit(modulus) if modulus else whole

    text = F.format_string(
        "%d days %02d hours %02d minutes %02d seconds",
        part(86400), part(3600, 24), part(60, 60), part(1, 60))
    return F.when(s.isNotNull(), text)


# Seconds per rotation unit: seconds, minutes, hours, days; fixed values.
ROTATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def rotation_seconds(period, interval) -> int | None:
    """Length of one log file, or None when the setting switches rotation off."""
    try:
        period = int(period)
    except (TypeError, ValueError):
        return None
    unit = ROTATION_UNITS.get(str(interval).lower())
    return period * unit if unit and period > 0 else None


def rotation_bucket(time, period, interval) -> Column:
    """Start of the log file a row belongs to; NULL when rotation is off."""
    length = rotation_seconds(period, interval)
    return F.lit(None).cast("timestamp") if length is None else truncate_time(time, length)
