"""Registered queries: each operator over whole tables, with its SQL twin.

A query takes (session, folder of tables) and returns a DataFrame. Times come
out as microseconds since the epoch and sums rounded, so that two engines can
be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


def us(c: str, alias: str | None = None) -> Column:
    return F.unix_micros(F.col(c)).alias(alias or c + "_us")


def big(c: str, alias: str | None = None) -> Column:
    return F.col(c).cast("bigint").alias(alias or c)


def rounded(c: str, digits: int = 4, alias: str | None = None) -> Column:
    return F.round(F.col(c), digits).alias(alias or c)


# --- SQL views -------------------------------------------------------------

EV = """ev AS (SELECT event_id AS id, ts AS time, epoch_us(ts) AS us, user_id,
  event_type, value, props FROM events)"""

PGN = """CASE event_type WHEN 'click' THEN 61444 WHEN 'view' THEN 65265
  WHEN 'signup' THEN 65262 WHEN 'purchase' THEN 65267
  ELSE 59904 + (user_id * 7) % 256 END"""

FRAMES = EV + f""", frames AS (SELECT id, time, us, user_id AS device,
  'can' || CAST(user_id % 2 AS VARCHAR) AS can_interface, {PGN} AS grp,
  CAST((id % 8) * 67108864 + ({PGN}) * 256 + user_id % 254 AS BIGINT) AS can_id,
  value >= 4 AS is_extended, value > 220 AS is_rtr,
  CAST(round(value * 100) AS BIGINT) AS v100, id % 256 AS b4,
  printf('%016x', CAST(round(value * 100) AS BIGINT) + (id % 256) * 16777216) AS data
  FROM ev),
messages AS (SELECT *, CAST(id % 8 AS BIGINT) AS priority, CAST(user_id_254 AS BIGINT) AS source,
  CAST(CASE WHEN grp >= 61440 THEN grp ELSE 59904 END AS BIGINT) AS pgn,
  CAST(CASE WHEN grp >= 61440 THEN NULL ELSE grp - 59904 END AS BIGINT) AS destination
  FROM (SELECT *, device % 254 AS user_id_254 FROM frames))"""

# Decoded by hand from the payload bytes: byte 4 is b4, bytes 5-7 hold v100
# with the low byte last.
DECODED = FRAMES + """, decoded AS (
  SELECT id, device, us, time, pgn, is_extended, is_rtr, 'speed' AS name,
    (v100 % 256) * 0.5 AS value, 'rpm' AS units, 125.0 AS max_value FROM messages WHERE pgn = 61444
  UNION ALL SELECT id, device, us, time, pgn, is_extended, is_rtr, 'torque', b4 - 125.0, '%', 125.0
    FROM messages WHERE pgn = 61444
  UNION ALL SELECT id, device, us, time, pgn, is_extended, is_rtr, 'slip',
    CASE WHEN b4 >= 128 THEN b4 - 256.0 ELSE b4 END, '1', 128.0 FROM messages WHERE pgn = 61444
  UNION ALL SELECT id, device, us, time, pgn, is_extended, is_rtr, 'vehicle',
    ((v100 // 256) % 256 + 256 * (v100 % 256)) * 0.00390625, 'km/h', 250.0
    FROM messages WHERE pgn = 65265
  UNION ALL SELECT id, device, us, time, pgn, is_extended, is_rtr, 'coolant', v100 % 256 - 40.0,
    'C', 210.0 FROM messages WHERE pgn = 65262
  UNION ALL SELECT id, device, us, time, pgn, is_extended, is_rtr, 'wide',
    CAST(CAST(b4 AS HUGEINT) * 4294967296 + CAST((v100 // 65536) % 256 AS HUGEINT) * 1099511627776
    + CAST((v100 // 256) % 256 AS HUGEINT) * 281474976710656
    + CAST(v100 % 256 AS HUGEINT) * 72057594037927936 AS DOUBLE), '1', 2.0e19
    FROM messages WHERE pgn = 65267)"""

SIGNALS = EV + f""", signals AS (SELECT id, user_id AS device, event_type AS name, time, us, value,
  CASE event_type WHEN 'click' THEN 100.0 WHEN 'view' THEN 150.0 ELSE 200.0 END AS max_value,
  0.0 AS min_value, 'u' AS units, CASE event_type WHEN 'click' THEN 61444 WHEN 'view' THEN 65265
  WHEN 'signup' THEN 65262 WHEN 'purchase' THEN 65267 ELSE 59904 END AS pgn FROM ev)"""

COUNTERS = EV + """, hourly AS (SELECT user_id % 10 AS device,
  'can' || CAST(user_id % 2 AS VARCHAR) AS interface, date_trunc('hour', time) AS time,
  SUM(CASE WHEN value >= 30 THEN 8 ELSE 0 END) AS b FROM ev GROUP BY ALL),
counters AS (SELECT device, interface, time,
  CASE WHEN device = 9 THEN 'x' WHEN device = 8 THEN '1' ELSE '280' END AS link_type,
  CAST(SUM(b) OVER (PARTITION BY device, interface ORDER BY time) AS BIGINT) AS rx_bytes
  FROM hourly),
activity AS (SELECT device, time, CAST(SUM(rx_bytes) AS BIGINT) AS rx_bytes FROM counters
  WHERE link_type = '280' GROUP BY ALL)"""

POINTS = EV + """, points AS (SELECT id, user_id % 50 AS device, date_trunc('minute', time) AS time,
  CAST(40.0 AS DOUBLE) + CAST(id % 2000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-87.0 AS DOUBLE) + CAST(user_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon, value
  FROM ev),
sent_log AS (SELECT DISTINCT device, time FROM points WHERE value < 30)"""

# Cells are found with whole-degree comparisons, then bits alternate.
GEOHASH = """array_to_string(list_transform(range(0, 7), lambda c: substr(
  '0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + list_sum(list_transform(range(0, 5), lambda b:
    (CASE WHEN (5 * c + b) % 2 = 0
      THEN CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) >> (17 - (5 * c + b) // 2)
      ELSE CAST(floor((lat + 90) / 180 * 131072) AS BIGINT) >> (16 - (5 * c + b) // 2) END % 2)
    * (1 << (4 - b)))) AS BIGINT), 1)), '')"""

POINT_ID = """printf('%08x', CAST(floor(epoch_us(time) / 1000000.0) AS BIGINT)) || md5(
  CAST(device AS VARCHAR) || '|' || CAST(epoch_us(time) AS VARCHAR) || '|'
  || CAST(CAST(round(lat * 1000000000) AS BIGINT) AS VARCHAR) || '|'
  || CAST(CAST(round(lon * 1000000000) AS BIGINT) AS VARCHAR))"""

PROBES = EV + """, probes AS (SELECT id, user_id AS device, time, us, event_type <> 'error' AS ok
  FROM ev)"""

TRANSITIONS = PROBES + """, looked AS (SELECT *,
  coalesce(lag(ok) OVER w, false) AS was, max(CASE WHEN ok THEN us END) OVER
    (PARTITION BY device ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM probes WINDOW w AS (PARTITION BY device ORDER BY time, id)),
transitions AS (SELECT id, device, us AS time_us,
  CASE WHEN ok THEN 'online' ELSE 'offline' END AS event, seen AS last_seen_us,
  CASE WHEN ok THEN (us - seen) // 1000000 END AS gap_s FROM looked WHERE ok <> was)"""

GAP_TEXT = """printf('%d days %02d hours %02d minutes %02d seconds', gap_s // 86400,
  (gap_s // 3600) % 24, (gap_s // 60) % 60, gap_s % 60)"""

READINGS = EV + """, readings AS (SELECT id, user_id AS device, 'sms' AS subject, time, us,
  CASE WHEN value >= 50 THEN 1 ELSE 0 END AS reading FROM ev),
edges AS (SELECT id, device, subject, us, reading FROM (SELECT *, coalesce(lag(reading) OVER
  (PARTITION BY device, subject ORDER BY time, id), 0) AS before FROM readings)
  WHERE reading >= 1 AND before < 1)"""

REQUESTS = EV + """, requests AS (SELECT id, us, CASE WHEN user_id % 7 = 0 THEN '0' ELSE '+1765555' END
  || lpad(CAST(user_id AS VARCHAR), 4, '0') AS phone FROM ev)"""

REPLAY = EV + """, expected AS (SELECT 'j1939.gps.' || event_type AS subject, props AS body FROM ev),
received AS (SELECT 'j1939.gps.' || event_type AS subject, props AS body FROM ev WHERE value >= 3
  UNION ALL SELECT 'j1939.gps.' || event_type, props FROM ev WHERE value > 150),
balance AS (SELECT subject, body, CAST(SUM(s) AS BIGINT) AS s FROM (SELECT *, 1 AS s FROM expected
  UNION ALL SELECT *, -1 FROM received) GROUP BY ALL)"""

# Samples unnested with their position; 64 per block.
SAMPLES = """samples AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
  generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
bins AS (SELECT unnest(range(0, 64)) AS k)"""

DFT = SAMPLES + """, dft AS (SELECT vec_id, label, k,
  SUM(x * cos(2 * pi() * k * n / 64)) AS re, -SUM(x * sin(2 * pi() * k * n / 64)) AS im
  FROM samples, bins GROUP BY ALL)"""

WINDOWED = SAMPLES + """, tapped AS (SELECT vec_id, label, n, x * (0.35875
  - 0.48829 * cos(2 * pi() * n / 63) + 0.14128 * cos(4 * pi() * n / 63)
  - 0.01168 * cos(6 * pi() * n / 63)) AS x FROM samples),
fft AS (SELECT vec_id, label, (k + 32) % 64 AS bin, SUM(x * cos(2 * pi() * k * n / 64)) AS re,
  -SUM(x * sin(2 * pi() * k * n / 64)) AS im FROM tapped, bins GROUP BY ALL)"""


def sql(views: str, body: str) -> str:
    return f"WITH {views}\n{body}"
