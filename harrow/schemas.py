"""Row types of the messages and tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
}


def _struct(spec: str) -> T.StructType:
    """``name TYPE, ...`` of plain types; needs no session, unlike DDL text."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Bus log row: CSV and table share this column order.
CAN_LOG = _struct("time TIMESTAMP, can_interface STRING, can_id STRING, can_data STRING")
CAN_LOG_KEYS = ["time", "can_interface", "can_id", "can_data"]

# Raw frame message. Numbers travel as unpadded lower-case hex text.
RAW_FRAME_JSON = _struct(
    "timestamp DOUBLE, pgn STRING, saddr STRING, sname STRING, daddr STRING, "
    "dname STRING, priority STRING, data STRING")

# Message of the older bus reader: plain numbers, hex payload.
BUS_MESSAGE_JSON = _struct(
    "ts DOUBLE, pgn INT, source INT, dest INT, priority INT, data STRING")

# Decoded signal message.
SIGNAL_JSON = _struct(
    "pgn INT, name STRING, time DOUBLE, value DOUBLE, units STRING, "
    "min_value DOUBLE, max_value DOUBLE")

# Signal dictionary: one row per signal of a parameter group.
DICTIONARY = _struct(
    "pgn INT, name STRING, description STRING, units STRING, start_bit INT, "
    "bit_len INT, scale DOUBLE, offset DOUBLE, min_value DOUBLE, max_value DOUBLE, signed BOOLEAN")

# Where a signal lies, if not low byte first in every frame of its group: first bit counted from the
# top of the first byte, and the value another signal, the selector, must have. Optional columns.
LAYOUT = _struct(
    "big_endian BOOLEAN, selector STRING, selector_start INT, selector_len INT, "
    "selector_big_endian BOOLEAN, selector_value BIGINT")

# gpsd reports. Key names are gpsd's own, case included; fixed values.
_TPV_DOUBLES_A = "altHAE altMSL alt climb".split()
_TPV_DOUBLES_B = (
    "depth dgpsAge dgpsSta epc epd eph eps ept epx epy epv geoidSep lat lon "
    "track magtrack magvar speed ecefx ecefy ecefz ecefpACC ecefvx ecefvy "
    "ecefvz ecefvACC sep relD relE relN wanglem wangler wanglet wspeedr wspeedt"
).split()


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names)


GPS_TPV = _struct(
    "systime TIMESTAMP, device STRING, mode SMALLINT, status SMALLINT, "
    f"time TIMESTAMP, {_doubles(_TPV_DOUBLES_A)}, datum STRING, "
    f"{_doubles(_TPV_DOUBLES_B)}")

SATELLITE = _struct(
    "PRN INT, el DOUBLE, az DOUBLE, ss DOUBLE, used BOOLEAN, gnssid INT, svid INT")
GPS_SKY = _struct(
    "systime TIMESTAMP, device STRING, time TIMESTAMP, "
    f"{_doubles('gdop hdop pdop tdop vdop xdop ydop nSat uSat'.split())}").add(
    "satellites", T.ArrayType(SATELLITE))

GPS_PPS = _struct(
    "systime TIMESTAMP, device STRING, real_sec BIGINT, real_nsec BIGINT, "
    "clock_sec BIGINT, clock_nsec BIGINT, precision INT, qErr INT")

GPSD_CLASSES = {"TPV": GPS_TPV, "SKY": GPS_SKY, "PPS": GPS_PPS}
GPSD_NOT_NULL = {"TPV": ["systime", "mode"], "SKY": ["systime"], "PPS": ["systime"]}

# Modem log: CSV carries epoch seconds.
CELL_CSV = _struct("timestamp BIGINT, signal SMALLINT, cell_tech STRING")
CELL = _struct("time TIMESTAMP, signal SMALLINT, cell_tech STRING")

# Position points and the log of what was uploaded.
POINTS = _struct("id BIGINT, device BIGINT, time TIMESTAMP, lat DOUBLE, lon DOUBLE")
SENT_LOG = _struct("device BIGINT, time TIMESTAMP")

COUNTERS = _struct(
    "time TIMESTAMP, device BIGINT, interface STRING, link_type STRING, rx_bytes STRING")
PROBES = _struct("id BIGINT, device BIGINT, time TIMESTAMP, ok BOOLEAN")

SPECTRUM_JSON = _struct(
    "fft STRING, fc DOUBLE, gain DOUBLE, span DOUBLE, fft_size INT, stream BOOLEAN")
TUNER_JSON = _struct("ft BIGINT, fc BIGINT, gain BIGINT, stream BOOLEAN")
