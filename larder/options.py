"""Runtime options of an open store."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class SyncMode(IntEnum):
    ADAPTIVE = 0  #: data of the manifest, and its folder
    DATA = 1  #: data of the manifest only
    ALL = 2  #: data and metadata of the manifest and of every new data file, and their folders


@dataclass(frozen=True)
class OpenOptions:
    """Capacities are hints: Spark caches blocks itself, and zero must work. All handles of one live store have equal options."""

    # fixed values: the default capacities
    page_cache: int = 8192
    root_cache: int = 8192
    mapping_cache: int = 32768
    hot_mapping_cache: int = 8192
    tree_cache: int = 8192
    sync: SyncMode = SyncMode.ADAPTIVE
    #: More segments than this in a bucket are folded by the commit that exceeds it.
    max_segments: int = 8

    def __post_init__(self):
        object.__setattr__(self, "sync", SyncMode(self.sync))
