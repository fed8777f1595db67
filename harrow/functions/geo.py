"""Position functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spark's base-32 digits and the public geohash alphabet; fixed values.
_BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cell(coordinate: Column, full: int, bits: int) -> Column:
    """Index of the cell among 2^bits over a range of ``full`` degrees.

    ``coordinate * 2^bits`` and ``index * full`` are exact in a double, so the
    two comparisons correct a division that rounded across a cell edge.
    """
    scaled = coordinate * F.lit(float(1 << bits))
    guess = F.floor(scaled / F.lit(float(full))).cast("bigint")
    exact = (guess
             - F.when(guess * F.lit(float(full)) > scaled, 1).otherwise(0)
             + F.when((guess + 1) * F.lit(float(full)) <= scaled, 1).otherwise(0))
    index = exact + F.lit(1 << (bits - 1))
    return F.greatest(F.least(index, F.lit((1 << bits) - 1)), F.lit(0)).cast("bigint")


def geohash(lat, lon, precision: int = 7) -> Column:
    """Base-32 geohash; bits alternate, longitude first.

    Binary digits read in base 4 are the bits spread to every other place, so
    the two indexes interleave by one addition, and base 32 in Spark's digits
    translates to the geohash alphabet.
    """
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2

    def spread(index: Column) -> Column:
        return F.conv(F.bin(index), 4, 10).cast("bigint")

    x = spread(_cell(_col(lon), 360, lon_bits))
    y = spread(_cell(_col(lat), 180, lat_bits))
    code = x + F.shiftleft(y, 1) if total % 2 else F.shiftleft(x, 1) + y
    digits = F.lpad(F.conv(code.cast("string"), 10, 32), precision, "0")
    return F.translate(digits, _BASE_32, _ALPHABET)


def point_id(device, time, lat, lon) -> Column:
    """Time-sortable id of a point: epoch seconds in hex, then a digest.

    A function of the point alone, so that writing a batch again after a lost
    executor gives the same documents.
    """
    micros = F.unix_micros(_col(time))
    seconds = F.floor(micros / F.lit(1000000)).cast("bigint")
    # Whole nanodegrees keep the digest input free of floating point text.
    text = F.concat_ws(
        "|", _col(device).cast("string"), micros.cast("string"),
        F.round(_col(lat) * 1000000000).cast("bigint").cast("string"),
        F.round(_col(lon) * 1000000000).cast("bigint").cast("string"))
    return F.concat(F.lpad(F.lower(F.hex(seconds)), 8, "0"), F.md5(text))


def gnss_document(id_, time, lat, lon) -> Column:
    """The entry of one point in a trail document."""
    return F.struct(
        _col(id_).alias("id"),
        (F.unix_micros(_col(time)) / F.lit(1000000.0)).alias("time"),
        _col(lat).alias("lat"), _col(lon).alias("lon"))
