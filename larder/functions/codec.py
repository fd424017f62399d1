"""Order-preserving encodings of typed keys, as column expressions; an addition to the opaque bytes of the store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(c: Column) -> Column:
    return F.encode(c.cast("string"), "UTF-8")


def unsigned(c: Column) -> Column:
    """Big-endian 8 bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def signed(c: Column) -> Column:
    """Big-endian 8 bytes with the sign bit flipped, so that negative numbers come first."""
    return unsigned(c.cast("long").bitwiseXOR(F.lit(-(1 << 63))))


def timestamp(c: Column) -> Column:
    return signed(F.unix_micros(c))


def text(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def number(c: Column) -> Column:
    """What unsigned() encoded, for values below 2**63."""
    return F.conv(F.hex(c), 16, 10).cast("long")
