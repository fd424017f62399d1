"""A streaming sink into a bucket, as an extension: each micro-batch is one transaction, and a batch that is run again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import Kind, StoreError
from ..store import Store
from ..transaction import MultiTxn

PROGRESS = "_stream_progress"


def bucket_sink(store: Store, bucket: str, name: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. Batches have key and value, and a column ord if a key can come twice in one; name marks the stream's progress."""

    def run(batch: DataFrame, number: int) -> None:
        def both(m: MultiTxn) -> None:
            def done(t) -> bool:
                try:
                    return int(t.get(name.encode())) >= number
                except StoreError as e:
                    if e.kind != Kind.NOT_FOUND:
                        raise
                    return False

            if not m.exec(PROGRESS, done):
                m.exec(bucket, lambda t: t.put_all(batch))
                m.exec(PROGRESS, lambda t: t.put(name.encode(), str(number).encode()))

        store.exec_multi(both)

    return run
