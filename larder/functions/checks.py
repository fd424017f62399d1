"""The limits of keys and bucket names, for single values and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Kind, StoreError

MAX_KEY = 128  # fixed value, in bytes
MAX_VALUE = 1 << 30  # a cell of a Parquet file must fit in memory several times


def checked_key(key: bytes) -> bytes:
    key = bytes(key)
    if not key:
        raise StoreError(Kind.INVALID, "empty key")
    if len(key) > MAX_KEY:
        raise StoreError(Kind.TOO_LARGE, f"key of {len(key)} bytes")
    return key


def checked_value(value: bytes) -> bytes:
    value = bytes(value)
    if len(value) > MAX_VALUE:
        raise StoreError(Kind.TOO_LARGE, f"value of {len(value)} bytes")
    return value


def checked_name(name: str) -> str:
    if not isinstance(name, str):
        raise StoreError(Kind.INVALID, "a bucket's name is a string")
    checked_key(name.encode("utf-8"))
    return name


def key_error(key: Column, value: Column | None = None) -> Column:
    """The code of what is wrong with a key (or null value); null if nothing is."""
    empty = key.isNull() | (F.octet_length(key) == 0)
    out = F.when(empty, int(Kind.INVALID)).when(F.octet_length(key) > MAX_KEY, int(Kind.TOO_LARGE))
    if value is not None:
        out = out.when(value.isNull(), int(Kind.INVALID)).when(F.octet_length(value) > MAX_VALUE, int(Kind.TOO_LARGE))
    return out
