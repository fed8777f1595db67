"""Column functions; all built from Spark expressions, none from Python UDFs."""

from harrow.functions.bits import hex_number, hex_text, spn_bits, spn_value, word_of
from harrow.functions.geo import geohash, gnss_document, point_id
from harrow.functions.spectra import (
    magnitude, quantise_u16, spectrum_decode, spectrum_encode)
from harrow.functions.subjects import make_subject, subject_match
from harrow.functions.times import (
    day_of, epoch_seconds, from_epoch_seconds, gap_text, iso_time, parse_time,
    rotation_bucket, truncate_time)

__all__ = [
    "day_of", "epoch_seconds", "from_epoch_seconds", "gap_text", "geohash",
    "gnss_document", "hex_number", "hex_text", "iso_time", "magnitude",
    "make_subject", "parse_time", "point_id", "quantise_u16",
    "rotation_bucket", "spectrum_decode", "spectrum_encode", "spn_bits",
    "spn_value", "subject_match", "truncate_time", "word_of",
]
