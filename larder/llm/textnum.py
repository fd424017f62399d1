"""Words, shingles and alignments as numpy arrays."""

from __future__ import annotations

import numpy as np

# Odd 64-bit multipliers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SHINGLE = 5

_powers = np.cumprod(np.full(4096, BASE), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, the same in every process."""
    global _powers
    b = np.frombuffer(text.encode(), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    while (top := int(place.max())) >= len(_powers):
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    values = np.where(space, 0, b.astype(np.uint64) + np.uint64(1))[starts[0] :] * _powers[place]
    return mixed(np.add.reduceat(values, starts - starts[0]))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each window of SHINGLE words; of all words where there are fewer; none without words."""
    n = len(words)
    if n < SHINGLE:
        return mixed(np.array([(words * POSITION[:n]).sum() + np.uint64(n)], np.uint64)) if n else words
    out = words[: n - SHINGLE + 1] * POSITION[0]
    for k in range(1, SHINGLE):
        out = out + words[k : n - SHINGLE + 1 + k] * POSITION[k]
    return mixed(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """s with the second and later occurrences of a value told apart."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    again = np.flatnonzero(t[1:] == t[:-1]) + 1
    if not len(again):
        return s
    new = np.ones(len(t), bool)
    new[again] = False
    first = np.flatnonzero(new)
    nth = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    out = np.empty_like(s)
    out[order] = np.where(nth > 0, mixed(t + nth.astype(np.uint64) * BASE), t)
    return out


def matched(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """How many words of a and b an alignment matches in order, on diagonals that differ by at most `band` from the first.

    Row by row of b, the bits of one integer tell where the number of matches goes up along a; only the band's columns are held, and what
    leaves it is added up. So time is in proportion to length times band / 64, and all common beginnings and ends cost next to nothing.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    values, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = code[: len(a)], code[len(a) :]
    order = np.argsort(ca, kind="stable")
    edges = np.searchsorted(ca[order], np.arange(len(values) + 1))
    few = np.diff(edges) <= 64
    places: list = [order[i:j].tolist() if f else order[i:j] for i, j, f in zip(edges[:-1].tolist(), edges[1:].tolist(), few.tolist(), strict=True)]
    done, low, high, row = 0, 0, 0, 0
    for j, c in enumerate(cb.tolist()):
        top = min(len(a), j + band + 1)
        row |= ((1 << (top - high)) - 1) << (high - low) if top > high else 0
        high = max(high, top)
        if j - band > low:
            out = min(j - band, high) - low
            done += out - (row & ((1 << out) - 1)).bit_count()
            row >>= out
            low += out
            if low >= len(a):
                break
        here, hit = places[c], 0
        if few[c]:
            for p in here:
                if low <= p < high:
                    hit |= 1 << (p - low)
        elif len(near := here[np.searchsorted(here, low) : np.searchsorted(here, high)]):
            bits = np.zeros(high - low, np.uint8)
            bits[near - low] = 1
            hit = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if hit := hit & row:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
    return head + tail + done + (high - low) - row.bit_count()
