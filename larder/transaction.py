"""Transactions: single operations are buffered, bulk operations are staged as segments at once; a commit only names them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any, Self

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import Kind, StoreError, invalid, not_found
from .functions.checks import checked_key, checked_name, checked_value, key_error
from .operators.fold import final_rows, folded
from .operators.segments import one_per_key, write_segment
from .plans.overlay import overlay
from .sources.manifest import Bucket, Manifest, Segment

if TYPE_CHECKING:
    from .store import Core, Store


#: So many keys, and bytes in them, are broadcast to find their rows.
FEW_KEYS, FEW_BYTES = 200_000, 16_000_000


class Pin:
    """Keeps the files of a manifest from vacuum() while it is referenced."""

    def __init__(self, manifest: Manifest):
        self.manifest = manifest


class Reader:
    """Reads of one bucket; every frame and cursor keeps the state it was made from."""

    def __init__(self, store: Store, name: str, bucket: Bucket):
        self._store, self.name, self._bucket, self.pin = store, name, bucket, None

    def pinned(self, core: Core, manifest: Manifest) -> Self:
        self.pin = Pin(manifest)
        core.pins.add(self.pin)
        return self

    def _segments(self) -> tuple[Segment, ...]:
        return self._bucket.segments

    def _newer(self) -> list[DataFrame]:
        return []

    def frame(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """key and value, from low to high, both inclusive."""
        core = self._store._core
        out = overlay(core.spark, core.files, self._segments(), low, high, self._newer())
        out._pin = self.pin  # vacuum() leaves its files as long as the frame is referenced
        return out

    def _rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are among keys (key). Only their range is read; a few keys are broadcast, so that the bucket is not shuffled."""
        some = keys.where("key IS NOT NULL").select("key").distinct()
        n, size, low, high = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.min("key"), F.max("key")).first()
        if not n:
            return self.frame().where("false")
        rows = self.frame(bytes(low), bytes(high))
        return rows.join(F.broadcast(some) if n <= FEW_KEYS and size <= FEW_BYTES else some, "key", "left_semi")

    def get(self, key: bytes) -> bytes:
        key = checked_key(key)
        rows = self._store._core.collected(self.frame(key, key))
        if not rows:
            raise not_found(f"key {key!r}")
        return bytes(rows[0]["value"])

    def get_all(self, keys: DataFrame) -> DataFrame:
        """key, value and status (Ok or NotFound) of every row of keys."""
        probe = keys.select(F.col("key").cast("binary").alias("key"))
        got = probe.join(self._rows_of(probe), "key", "left")
        return got.select("key", "value", F.when(F.col("value").isNull(), "NotFound").otherwise("Ok").alias("status"))

    def ordered(self, low: bytes | None = None) -> DataFrame:
        return self.frame(low).orderBy("key")

    def items(self, low: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """A cursor in key order over the state at this moment, from low (inclusive)."""
        return self._cursor(self.ordered(low))

    def uncached(self) -> DataFrame:
        """What items_uncached() walks, as a frame: the rows in key order, never persisted, left to the executors."""
        return self.ordered()

    def items_uncached(self) -> Iterator[tuple[bytes, bytes]]:
        """The same rows; nothing is kept for later reads (items() keeps nothing either, but may)."""
        return self._cursor(self.uncached())

    def _cursor(self, df: DataFrame) -> Iterator[tuple[bytes, bytes]]:
        rows = self._store._core.guarded(lambda: df.toLocalIterator())

        def run():
            while True:
                try:
                    r = self._store._core.guarded(lambda: next(rows))
                except StopIteration:
                    return
                yield bytes(r["key"]), bytes(r["value"])

        return run()


class ReadTxn(Reader):
    """A snapshot. Verbs that write raise Invalid."""

    def put(self, *_: Any) -> None:
        raise invalid("read-only transaction")

    update = delete = put_all = update_all = delete_all = apply = put


class WriteTxn(Reader):
    """One bucket's pending changes. It sees its own; whoever runs it commits or rolls back."""

    def __init__(self, store: Store, name: str, bucket: Bucket):
        super().__init__(store, name, bucket)
        self._staged: list[Segment] = []
        self._pending: dict[bytes, bytes | None] = {}  # since the last staged segment; None deletes

    # -- reads

    def _segments(self) -> tuple[Segment, ...]:
        return (*self._bucket.segments, *self._staged)

    def _newer(self) -> list[DataFrame]:
        return [self._pending_frame()] if self._pending else []

    def _pending_frame(self) -> DataFrame:
        rows = [(bytearray(k), None if v is None else bytearray(v), v is None) for k, v in self._pending.items()]
        return self._store._core.spark.createDataFrame(rows, "key binary, value binary, tomb boolean")

    def get(self, key: bytes) -> bytes:
        key = checked_key(key)
        if key in self._pending:
            if (v := self._pending[key]) is None:
                raise not_found(f"key {key!r}")
            return v
        return super().get(key)

    def _has(self, key: bytes) -> bool:
        if key in self._pending:
            return self._pending[key] is not None
        return any(s.may_hold(key, key) for s in self._segments()) and bool(self._store._core.collected(self.frame(key, key)))

    # -- single operations

    def put(self, key: bytes, value: bytes) -> None:
        key = checked_key(key)
        self._pending[key] = checked_value(value)

    def update(self, key: bytes, value: bytes) -> bool:
        key, value = checked_key(key), checked_value(value)
        if not self._has(key):
            return False
        self._pending[key] = value
        return True

    def delete(self, key: bytes) -> None:
        key = checked_key(key)
        if not self._has(key):
            raise not_found(f"key {key!r}")
        self._pending[key] = None

    # -- bulk operations

    def _flush(self) -> None:
        if self._pending:
            self._stage(self._pending_frame(), "delta")
        self._pending = {}

    def _stage(self, rows: DataFrame, kind: str, checks: dict | None = None, refuse: Callable[[dict], StoreError | None] = lambda got: None) -> dict:
        core = self._store._core
        if kind == "base" and (self._bucket.segments or self._staged):
            rows, kind = rows.withColumn("tomb", F.lit(False)), "delta"
        segment, got = core.guarded(lambda: write_segment(core.files, self._bucket.id, rows, kind, checks))
        if error := refuse(got):
            if segment:
                core.files.delete(segment.path)
            raise error
        if segment:
            core.staged.add(segment.path)
            self._staged.append(segment)
        return got

    def _checked(self, df: DataFrame) -> tuple[DataFrame, dict, Callable[[dict], StoreError | None]]:
        """One row a key, and the checks: keys and values within limits, and no key twice without an order."""
        ordered = "ord" in df.columns
        rows = df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), *([F.col("ord")] if ordered else []))
        rows = one_per_key(rows, ordered)
        bad = key_error(F.col("key"), F.col("value"))
        checks = {"_bad": F.min(bad), "_most": F.max("n")}

        def refuse(got: dict) -> StoreError | None:
            if got["_bad"] is not None:
                return StoreError(Kind(got["_bad"]), "a key or value of a bulk operation")
            if not ordered and (got["_most"] or 0) > 1:
                return invalid("a key comes twice and there is no column ord")
            return None

        return rows, checks, refuse

    def put_all(self, df: DataFrame) -> None:
        """Puts key and value of every row; with a column ord the last of a key wins, without one keys must differ."""
        self._flush()
        rows, checks, refuse = self._checked(df)
        self._stage(rows.withColumn("tomb", F.lit(False)), "base", checks, refuse)

    def update_all(self, df: DataFrame) -> DataFrame:
        """Replaces the values of the keys that exist; returns key and updated of every key of df."""
        self._flush()
        keys = df.select(F.col("key").cast("binary").alias("key"))
        current = self._rows_of(keys).select("key")
        rows, checks, refuse = self._checked(df)
        flags = keys.join(current.withColumn("_is", F.lit(True)), "key", "left")
        marked = rows.join(current.withColumn("_is", F.lit(True)), "key", "left")
        bad = marked.agg(*[c.alias(k) for k, c in checks.items()]).first().asDict()
        if error := refuse(bad):
            raise error
        self._stage(marked.where("_is").withColumn("tomb", F.lit(False)), "delta")
        return flags.select("key", F.coalesce("_is", F.lit(False)).alias("updated"))

    def delete_all(self, df: DataFrame) -> None:
        """Deletes every key; NotFound, and nothing is deleted, if one is absent or comes twice."""
        self._flush()
        keys = df.select(F.col("key").cast("binary").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        marked = keys.join(self._rows_of(keys).select("key", F.lit(True).alias("_is")), "key", "left")
        rows = marked.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tomb"), "n", "_is")
        missing = F.max(F.when(F.col("_is").isNull() | (F.col("n") > 1), 1).otherwise(0))
        checks = {"_bad": F.min(key_error(F.col("key"))), "_missing": missing}

        def refuse(got: dict) -> StoreError | None:
            if got["_bad"] is not None:
                return StoreError(Kind(got["_bad"]), "a key of a bulk operation")
            return not_found("a key of a bulk operation") if got["_missing"] else None

        self._stage(rows, "delta", checks, refuse)

    def apply(self, log: DataFrame) -> DataFrame:
        """Runs an ordered log (ord, op, key, val) as if its operations were called one by one, up to the first error, which is raised.

        Returns the log with existed, effective and got.
        """
        self._flush()
        steps = folded(log, self._rows_of(log.select(F.col("key").cast("binary").alias("key"))))
        first = steps.where("error IS NOT NULL").agg(F.min(F.struct("ord", "error")).alias("e")).first()["e"]
        if first is not None:
            raise StoreError(Kind(first["error"]), f"operation {first['ord']}")
        self._stage(final_rows(steps), "delta")
        return steps.drop("error")

    # -- ends

    def _mark(self) -> tuple[int, int]:
        self._flush()
        return len(self._staged), 0

    def _back(self, mark: tuple[int, int]) -> None:
        for s in self._staged[mark[0] :]:
            self._store._core.discard(s.path)
        del self._staged[mark[0] :]
        self._pending = {}

    def _finished(self) -> Bucket:
        """The bucket with the staged segments; the same object if nothing took effect."""
        self._flush()
        return Bucket(self._bucket.id, self._segments()) if self._staged else self._bucket


class MultiTxn:
    """Sub-steps on several buckets with one commit. A failed sub-step leaves no trace, whether or not its error is caught."""

    def __init__(self, store: Store, manifest: Manifest):
        self._store, self._manifest = store, manifest
        self._open: dict[str, WriteTxn] = {}

    def exec(self, name: str, fn: Callable[[WriteTxn], Any]) -> Any:
        name = checked_name(name)
        fresh = name not in self._open
        txn = self._open.get(name) or WriteTxn(self._store, name, self._store._bucket_or_new(self._manifest, name)).pinned(self._store._core, self._manifest)
        mark = txn._mark()
        try:
            out = fn(txn)
        except BaseException:
            txn._back(mark)
            raise
        if fresh:
            self._open[name] = txn
        return out

    def bucket(self, name: str) -> WriteTxn:
        """The open transaction of a bucket, which the commit creates if it is missing."""
        self.exec(name, lambda t: None)
        return self._open[name]

    def _finished(self) -> dict[str, Bucket]:
        return {name: t._finished() for name, t in self._open.items()}

    def _rollback(self) -> None:
        for t in self._open.values():
            t._back((0, 0))

