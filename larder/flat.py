"""The store through functions that return codes, for callers that want no exceptions.

Every function returns a code, or a code and a value; the text of a thread's last error stays until it is cleared.
A callback returns None or 0 to commit; any other code undoes its transaction and is returned as it is.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from .errors import Kind, StoreError
from .functions.checks import MAX_KEY
from .options import OpenOptions, SyncMode
from .store import Store
from .transaction import MultiTxn, Reader, WriteTxn

END = 1
_last = threading.local()


class _Refused(Exception):
    def __init__(self, code: int):
        self.code = code


def _coded(fn: Callable[[], Any]) -> tuple[int, Any]:
    try:
        return int(Kind.OK), fn()
    except _Refused as e:
        return e.code, None
    except StoreError as e:
        _last.text = str(e)
        return e.code, None
    except OSError as e:
        _last.text = str(e)
        return int(Kind.IO), None
    except Exception as e:
        _last.text = str(e)
        return int(Kind.UNKNOWN), None


def _called(callback: Callable[..., int | None], *args: Any) -> None:
    if code := callback(*args):
        raise _Refused(code)


def default_open_options() -> OpenOptions:
    return OpenOptions()


def max_key_len() -> int:
    return MAX_KEY


def open_store(spark: SparkSession, path: str) -> tuple[int, Store | None]:
    return _coded(lambda: Store.open(spark, path))


def open_with_options(spark: SparkSession, path: str, *, sync: int = 0, **capacities: int) -> tuple[int, Store | None]:
    def run() -> Store:
        if sync not in list(SyncMode):
            raise StoreError(Kind.INVALID, f"sync mode {sync}")
        return Store.open(spark, path, OpenOptions(sync=SyncMode(sync), **capacities))

    return _coded(run)


def close(store: Store | None) -> int:
    """Handles are garbage collected; closing None is fine."""
    return int(Kind.OK)


def execute(store: Store, bucket: str, callback: Callable[[WriteTxn], int | None]) -> int:
    return _coded(lambda: store.exec(bucket, lambda t: _called(callback, t)))[0]


def view(store: Store, bucket: str, callback: Callable[[Reader], int | None]) -> int:
    return _coded(lambda: store.view(bucket, lambda t: _called(callback, t)))[0]


def exec_multi(store: Store, callback: Callable[[MultiTxn], int | None]) -> int:
    return _coded(lambda: store.exec_multi(lambda m: _called(callback, m)))[0]


def multi_bucket(txn: MultiTxn, bucket: str) -> tuple[int, WriteTxn | None]:
    """The bucket's transaction; the commit creates the bucket even if nothing is written."""
    return _coded(lambda: txn.bucket(bucket))


def get(txn: Reader, key: bytes) -> tuple[int, bytes | None]:
    """An empty value comes as None with code 0."""
    code, value = _coded(lambda: txn.get(key))
    return code, value or None


def put(txn: WriteTxn, key: bytes, value: bytes) -> int:
    return _coded(lambda: txn.put(key, value))[0]


def update(txn: WriteTxn, key: bytes, value: bytes) -> tuple[int, bool | None]:
    return _coded(lambda: txn.update(key, value))


def delete(txn: WriteTxn, key: bytes) -> int:
    return _coded(lambda: txn.delete(key))[0]


def iterate(txn: Reader) -> tuple[int, Iterator | None]:
    return _coded(txn.items)


def iterate_uncached(txn: Reader) -> tuple[int, Iterator | None]:
    return _coded(txn.items_uncached)


def iter_next(cursor: Iterator, callback: Callable[[bytes, bytes], int | None]) -> int:
    """Hands the next row to callback and returns its code; END after the last row."""

    def run() -> int:
        for k, v in cursor:
            return callback(k, v) or 0
        return END

    code, out = _coded(run)
    return code or out


def iter_close(cursor: Iterator | None) -> int:
    return int(Kind.OK)


def drop_bucket(store: Store, bucket: str) -> int:
    return _coded(lambda: store.drop(bucket))[0]


def last_error() -> str:
    return getattr(_last, "text", "")


def last_error_clear() -> None:
    _last.text = ""
