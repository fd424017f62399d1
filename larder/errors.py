"""Errors and their stable codes."""

from __future__ import annotations

from enum import IntEnum


class Kind(IntEnum):
    """Result codes that callers may store."""

    OK = 0
    NOT_FOUND = -1
    CORRUPTION = -2
    TOO_LARGE = -3
    INTERNAL = -4
    NO_SPACE = -5
    IO = -6
    INVALID = -7
    DUPLICATE = -8
    CONFLICT = -9
    UNKNOWN = -1000


class StoreError(Exception):
    def __init__(self, kind: Kind, message: str = ""):
        super().__init__(f"{kind.name}: {message}" if message else kind.name)
        self.kind = kind

    @property
    def code(self) -> int:
        return int(self.kind)


def not_found(what: str) -> StoreError:
    return StoreError(Kind.NOT_FOUND, what)


def invalid(what: str) -> StoreError:
    return StoreError(Kind.INVALID, what)
