"""Hex text and bit fields of bus payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NIBBLES = 0x0F0F0F0F0F0F0F0F
_TWO_64 = "18446744073709551616"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(c) -> Column:
    """Accept a plain number, a column name or a Column."""
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def hex_text(c) -> Column:
    """Lower-case hex: two digits per byte for bytes, unpadded for numbers."""
    return F.lower(F.hex(_col(c)))


def hex_number(c) -> Column:
    """Unpadded hex text to BIGINT; a u64 keeps its bit pattern, what is no u64 is NULL."""
    text = _col(c)
    return F.when(text.rlike("^0*[0-9A-Fa-f]{1,16}$"), F.conv(F.right(text, F.lit(16)), 16, -10).cast("bigint"))


def word_of(hex16: Column) -> Column:
    """The first eight payload bytes as one little-endian 64-bit word.

    One text reversal and one base conversion per frame; reversing the text
    also swaps the two digits of each byte, which the mask-and-shift undoes.
    """
    turned = F.conv(F.reverse(F.rpad(F.substring(hex16, 1, 16), 16, "0")), 16, -10).cast("bigint")
    low = F.shiftleft(turned.bitwiseAND(F.lit(_NIBBLES)), 4)
    high = F.shiftrightunsigned(turned, 4).bitwiseAND(F.lit(_NIBBLES))
    return low.bitwiseOR(high)


def big_endian_word_of(hex16: Column) -> Column:
    """The first eight payload bytes as one 64-bit word, the first byte on top."""
    return F.conv(F.rpad(F.substring(hex16, 1, 16), 16, "0"), 16, -10).cast("bigint")


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def spn_bits(word: Column, shift, bit_len) -> Column:
    """``bit_len`` bits of a 64-bit word from bit ``shift`` up, as a bit pattern."""
    shift, bit_len = _num(shift), _num(bit_len)
    mask = _shift("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(64) - bit_len)
    return _shift("shiftrightunsigned", word, shift).bitwiseAND(mask)


def unsigned_double(raw: Column) -> Column:
    """A 64-bit pattern read as an unsigned number."""
    # Only a full 64-bit field can have its top bit set.
    wide = (raw.cast("decimal(20,0)") + F.lit(_TWO_64).cast("decimal(20,0)")).cast("double")
    return F.when(raw < 0, wide).otherwise(raw.cast("double"))


def signed_double(raw: Column, bit_len) -> Column:
    """A bit field read as two's complement: its top bit is carried up, then down again."""
    spare = F.lit(64) - _num(bit_len)
    return _shift("shiftright", _shift("shiftleft", raw, spare), spare).cast("double")


def spn_value(data, start_bit, bit_len, scale=1.0, offset=0.0, signed=False) -> Column:
    """Physical value of a little-endian bit field of a hex payload.

    NULL when the field does not fit the payload. Works for payloads of any
    length; a field may straddle nine bytes. ``signed`` is a flag or a column.
    """
    data, start, width = _col(data), _num(start_bit), _num(bit_len)
    first = F.floor(start / F.lit(8)).cast("int")
    shift = start - first * F.lit(8)
    low = spn_bits(word_of(F.substring(data, first * F.lit(2) + F.lit(1), F.lit(16))), shift, width)
    ninth = F.coalesce(
        F.conv(F.substring(data, first * F.lit(2) + F.lit(17), F.lit(2)), 16, 10).cast("bigint"),
        F.lit(0).cast("bigint"))
    carried = _shift("shiftleft", ninth, F.lit(64) - shift)
    raw = F.when(
        shift + width > 64, spn_bits(low.bitwiseOR(carried), F.lit(0), width)).otherwise(low)
    fits = start + width <= F.length(data) * F.lit(4)
    number = unsigned_double(raw)
    if signed is not False:
        number = F.when(_num(signed), signed_double(raw, width)).otherwise(number)
    return F.when(fits, number * _num(scale) + _num(offset))
