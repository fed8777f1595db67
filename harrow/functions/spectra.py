"""Spectrum vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnitude(re, im) -> Column:
    re, im = _col(re), _col(im)
    return F.sqrt(re * re + im * im)


def quantise_u16(c, scale: float = 10000.0) -> Column:
    """Scale, drop the fraction and keep the low 16 bits."""
    scaled = _col(c) * F.lit(float(scale))
    toward_zero = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return toward_zero.cast("bigint").bitwiseAND(F.lit(65535)).cast("int")


def spectrum_encode(c) -> Column:
    """ARRAY<INT> of 16-bit values to base64 of their little-endian bytes."""
    def two_bytes(v: Column) -> Column:
        swapped = F.shiftleft(v.bitwiseAND(F.lit(255)), 8).bitwiseOR(
            F.shiftright(v, 8).bitwiseAND(F.lit(255)))
        return F.lpad(F.hex(swapped.cast("bigint")), 4, "0")

    # Spark's base64 breaks lines after 76 characters; the message has none.
    packed = F.base64(F.unhex(F.array_join(F.transform(_col(c), two_bytes), "")))
    return F.regexp_replace(packed, "[\r\n]", "")


def spectrum_decode(c) -> Column:
    """Inverse of :func:`spectrum_encode`."""
    # The text is cut into values once; a lambda over positions would decode it
    # again for each.
    values = F.regexp_extract_all(F.hex(F.unbase64(_col(c))), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(values, lambda v: F.conv(
        F.concat(F.substring(v, 3, 2), F.substring(v, 1, 2)), 16, 10).cast("int"))
