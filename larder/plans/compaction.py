"""Which buckets a compaction rewrites, and rewriting one."""

from __future__ import annotations

from typing import NamedTuple

from ..errors import Kind, StoreError
from ..operators.segments import write_segment
from ..sources.manifest import Bucket, Manifest
from .overlay import overlay

PAGE, SMALL_PAGES = 4096, 1024  # fixed values: a store of at most this many pages is compacted whole


class CompactStats(NamedTuple):
    moved: int  #: data files rewritten
    remaining: int  #: candidate files left as they were


def window(manifest: Manifest, target_bytes: int) -> list[str]:
    """Buckets with a file in the newest bytes that are to be looked at: all of a small store, half for 0, else target_bytes."""
    segments = [(name, s) for name, b in manifest.buckets.items() for s in b.segments]
    total = sum(s.bytes for _, s in segments)
    if total <= PAGE * SMALL_PAGES:
        reach = total
    else:
        reach = -(-total // 2) if target_bytes == 0 else -(-target_bytes // PAGE) * PAGE
    names: list[str] = []
    for name, s in reversed(segments):
        if reach <= 0:
            break
        reach -= s.bytes
        if name not in names:
            names.append(name)
    return names


def gains(bucket: Bucket) -> bool:
    """Rewriting a single base changes nothing."""
    return any(s.kind == "delta" for s in bucket.segments)


def rewritten(core, bucket: Bucket) -> Bucket:
    """The same content as one base, range-partitioned and sorted by key."""
    rows = overlay(core.spark, core.files, bucket.segments).repartitionByRange("key")
    segment, _ = core.guarded(lambda: write_segment(core.files, bucket.id, rows, "base"))
    if segment:
        core.staged.add(segment.path)
    return Bucket(bucket.id, (segment,) if segment else ())


def plan(manifest: Manifest, target_bytes: int) -> tuple[list[str], int, int]:
    """The buckets to rewrite, their files, and the candidate files that stay."""
    if target_bytes < 0:
        raise StoreError(Kind.INVALID, "negative target")
    near = window(manifest, target_bytes)
    todo = [n for n in near if gains(manifest.buckets[n])]
    files = lambda names: sum(s.files for n in names for s in manifest.buckets[n].segments)
    # what a full target can't improve is as compact as it gets; the strict mode of 0 reports it
    stay = files([n for n in near if n not in todo]) if target_bytes == 0 else 0
    return todo, files(todo), stay
