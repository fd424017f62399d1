"""Writing segments: one pass that writes, counts and checks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.files import HadoopFiles, LocalFiles
from ..sources.manifest import Segment


def write_segment(
    files: LocalFiles | HadoopFiles, bucket_id: str, rows: DataFrame, kind: str, checks: Mapping[str, Column] | None = None
) -> tuple[Segment | None, dict]:
    """Writes key, value and (for a delta) tomb, and returns the segment, None if it has no rows, and the values of the checks.

    checks are aggregates over rows, which may have more columns than those that are written.
    """
    path = f"data/{bucket_id}/{uuid.uuid4().hex}"
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("_rows"), F.min("key").alias("_low"), F.max("key").alias("_high"), *[c.alias(k) for k, c in (checks or {}).items()])
    out = rows.select("key", "value") if kind == "base" else rows.select("key", "value", "tomb")
    writer = out.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(files.url(path))
    got = seen.get
    if not got["_rows"]:
        files.delete(path)
        return None, got
    sizes = files.sizes(path)
    return Segment(path, kind, got["_rows"], bytes(got["_low"]).hex(), bytes(got["_high"]).hex(), len(sizes), sum(sizes.values())), got


def one_per_key(rows: DataFrame, ordered: bool) -> DataFrame:
    """key, value and the number of rows a key had. With an order the last row wins and counts meet before the shuffle, so hot keys are cheap."""
    if ordered:
        return rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.count("*").alias("n"))
    return rows.repartitionByRange("key").groupBy("key").agg(F.first("value").alias("value"), F.count("*").alias("n"))
