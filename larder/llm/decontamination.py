"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared in lower case with every run of other characters than letters and digits as one space. Each benchmark item is cut into
windows of WINDOW characters that overlap by half (an item that is shorter is one window). A region of a document matches a window of length
m if at most k = EDITS * m edits turn one into the other. Then the two share at least m - Q + 1 - k * Q of the window's q-grams, and all those lie
on diagonals that differ by at most k. So shared q-grams are counted in overlapping bands of diagonals twice as wide as
that, each sharing half with the next: some band holds the whole match. Bands that meet the bound are verified by an alignment within the band.

The windows' q-grams are broadcast in blocks of BLOCK_CHARS characters, a fixed size; documents are read once for each block, each in pieces that overlap
by more than a window, so a text's length doesn't matter. Documents are never shuffled for the search.

Items of under SHORT characters allow no edits that leave a bound, so they match where a document has them word for word, between word borders; an item
that is a common word is so found in every document with that word.

Defined cases: null or empty texts and items match nothing; an empty benchmark matches nothing; repeated documents and items (also with one or a null id) are
reported one by one; item ids may be of any type; columns other than the text stay as they are in _row, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

Q, WINDOW, EDITS, SHORT = 8, 120, 0.1, 40
BLOCK, BLOCK_CHARS, PIECE = 20_000, 2_000_000, 1 << 20
FOUND = "array<struct<item_id:{},start:int,end:int,distance:int,windows:int>>"
_other = re.compile(r"[\W_]+")
_word = re.compile(r"[^ ]+")
_p1, _p2, _p4 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


_ascii = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def plain(text: str) -> str:
    if text.isascii():
        return b" ".join(text.encode().translate(_ascii).split()).decode()
    return _other.sub(" ", text.lower()).strip()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of every q-gram, by doubling."""
    h = codes.astype(np.uint64)
    for step, p in ((1, _p1), (2, _p2), (4, _p4)):
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = (h[:-step] + np.uint64(1)) * p + h[step:]
        h ^= h >> np.uint64(29)
    return h


class Index:
    """The q-grams of the windows of some items, for a broadcast."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [item for item, _ in items]
        self.windows: list[tuple[int, np.ndarray]] = []  # of items by their place in the block, for ids may repeat
        self.short: dict[str, list[int]] = {}
        self.sizes: dict[str, set[int]] = {}  # of the short items that begin with a word
        hashes, owner, place = [], [], []
        for item, (_, text) in enumerate(items):
            words = plain(text)
            codes = code_points(words)
            if len(codes) < SHORT:
                if words:
                    self.short.setdefault(words, []).append(item)
                    self.sizes.setdefault(words.partition(" ")[0], set()).add(len(words))
                continue
            starts = range(0, max(1, len(codes) - WINDOW // 2), WINDOW // 2) if len(codes) > WINDOW else [0]
            for s in starts:
                s = min(s, max(0, len(codes) - WINDOW))
                w = codes[s : s + WINDOW]
                g = grams(w)
                hashes.append(g)
                owner.append(np.full(len(g), len(self.windows), np.int64))
                place.append(np.arange(len(g), dtype=np.int64))
                self.windows.append((item, w))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int64)
        self.values, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bits = max(16, int(len(self.values)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.values >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.masks = [masks_of(w) for _, w in self.windows]
        m = np.array([len(w) for _, w in self.windows], np.int64)
        self.edits = (m * EDITS).astype(np.int64)
        self.bound = m - Q + 1 - self.edits * Q
        self.least, self.longest, self.most = (int(self.bound.min()), int(m.max()), int(self.edits.max())) if len(m) else (1, 0, 0)

    def verbatim(self, words: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items in a plain text."""
        for m in _word.finditer(words) if self.short else ():
            for n in self.sizes.get(m[0], ()):
                end = m.start() + n
                if words[end : end + 1] in ("", " "):
                    for item in self.short.get(words[m.start() : end], ()):
                        yield item, m.start(), end

    def found(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item_id, start, end, distance, windows) for every item of which a window matches; places in the plain text."""
        words = plain(text)
        codes, best = code_points(words), {}
        for item, start, end in self.verbatim(words):
            best[item] = (best[item][0] if item in best else start, end, 0, {-1})
        reach = self.longest + 2 * self.most
        for at in range(0, len(codes) if len(self.values) else 0, PIECE):
            for w, start, end, distance in self.matches(codes[at : at + PIECE + reach]):
                item = self.windows[w][0]
                old = best.get(item)
                seen = {w} if old is None else old[3] | {w}
                new = (start + at, end + at, distance)
                best[item] = (*new, seen) if old is None else (min(old[0], new[0]), max(old[1], new[1]), min(old[2], new[2]), seen)
        return [(self.ids[item], s, e, d, len(ws)) for item, (s, e, d, ws) in sorted(best.items())]

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = grams(codes)
        if not len(h):
            return
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        hit = self.values[k] == h[at]
        at, k = at[hit], k[hit]
        if len(at) < self.least:
            return
        # a match lies within a stretch that holds as many shared q-grams as the lowest bound of all windows
        span = self.longest + self.most
        near = np.searchsorted(at, at + span) - np.arange(len(at)) >= self.least
        if not near.any():
            return
        until = np.maximum.accumulate(np.where(near, at + span, -1))
        dense = at <= until
        at, k = at[dense], k[dense]
        n = self.count[k]
        each = np.repeat(np.arange(len(at)), n)
        entry = self.first[k][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        w = self.owner[entry]
        width = self.edits[w] + 1
        diagonal = at[each] - self.place[entry] + self.longest  # not below zero
        band = diagonal // width
        # band b is strips b - 1 and b, so each strip is in two; the bound is on the window's q-grams, so one that comes again in a strip counts once
        two = 2 * ((len(codes) + 2 * self.longest) + 2)
        keys = (w * two + band) * WINDOW + self.place[entry]
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] // WINDOW
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        strip, n = keys[first], np.diff(np.append(first, len(keys)))
        follows = np.append(strip[1:] == strip[:-1] + 1, False)
        upper = n + np.where(follows, np.append(n[1:], 0), 0)  # band strip + 1
        alone = ~np.append(False, follows[:-1])  # band strip, which has no rows of strip - 1
        keys, counts = np.concatenate([strip + 1, strip[alone]]), np.concatenate([upper, n[alone]])
        w, band = keys // two, keys % two
        for i in np.flatnonzero(counts >= self.bound[w]):
            x = int(w[i])
            window, edits = self.windows[x][1], int(self.edits[x])
            low = (int(band[i]) - 1) * (edits + 1) - self.longest
            high = low + 2 * (edits + 1) - 1
            region = codes[max(0, low) : max(0, high + len(window))]
            if (same := exact(window, region)) is not None:
                yield x, max(0, low) + same, max(0, low) + same + len(window), 0
                continue
            if not within(self.masks[x], len(window), region.tolist(), edits):
                continue
            got = banded(window, codes, low, high, edits)
            if got:
                yield (x, *got)


def exact(window: np.ndarray, region: np.ndarray) -> int | None:
    """Where region holds the window unchanged."""
    w, r, at = window.tobytes(), region.tobytes(), -1
    while (at := r.find(w, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return None


def masks_of(window: np.ndarray) -> dict[int, int]:
    """Of each code point: the places where the window has it, as bits."""
    out: dict[int, int] = {}
    for i, c in enumerate(window.tolist()):
        out[c] = out.get(c, 0) | 1 << i
    return out


def within(masks: dict[int, int], m: int, codes: list[int], edits: int) -> bool:
    """Whether some part of codes is within the edits of the window: a bit-parallel distance, so that few bands need the full alignment."""
    ones = (1 << m) - 1
    last, plus, minus, score = 1 << (m - 1), ones, 0, m
    for c in codes:
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & ones
        up = minus | (ones & ~(d | plus))
        down = plus & d
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score <= edits:
                return True
        up <<= 1
        plus = ((down << 1) | (ones & ~(d | up))) & ones
        minus = up & d & ones
    return score <= edits


def banded(window: np.ndarray, codes: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best place of window in codes on the diagonals low to high with at most `edits` edits; else None.

    Column d of a row stands for diagonal low + d, so that a substitution stays in its column.
    """
    n, m, wide = len(codes), len(window), high - low + 1
    far = m + wide + 1
    d = np.arange(wide)
    ok = (low + d >= 0) & (low + d <= n)
    cost, start = np.where(ok, 0, far), low + d
    for i in range(m):
        j = i + low + d  # the place in codes that meets window[i]
        inside = (j >= 0) & (j < n)
        same = np.zeros(wide, bool)
        same[inside] = codes[j[inside]] == window[i]
        step = np.where(inside, cost + ~same, far)
        up = np.append(cost[1:] + 1, far)  # window[i] is missing in codes
        begin = np.where(up < step, np.append(start[1:], 0), start)
        step = np.minimum(step, up)
        over = (j + 1 < 0) | (j + 1 > n)
        step[over] = far
        # characters of codes that the window lacks: each costs one and moves one diagonal up
        run = np.minimum.accumulate(step - d)
        origin = np.maximum.accumulate(np.where(step - d == run, d, -1))
        cost = np.where(over, far, run + d)
        start = begin[origin]
        if cost.min() > edits:
            return None
    best = int(cost.argmin())
    return (int(start[best]), int(m + low + best), int(cost[best])) if cost[best] <= edits else None


def with_found(docs: DataFrame, items: list[tuple[object, str]], id_type: str = "bigint") -> DataFrame:
    """_row (all columns) and _found for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "start", "end", "distance", "windows"), x, strict=True)) for x in shared.value.found(t)] if isinstance(t, str) else [] for t in batch], dtype=object)

    return docs.select(whole(docs).alias("_row"), F.pandas_udf(run, FOUND.format(id_type))(F.col("text")).alias("_found"))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, at most BLOCK items and BLOCK_CHARS characters (or one item) at a time."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if block and (len(block) == BLOCK or chars + len(r["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, columns: list[Column]) -> DataFrame:
    """columns (of _row), item_id, start, end, distance and windows: one row for each document and item that match."""
    out = None
    for items in blocks(benchmark):
        one = with_found(docs, items, benchmark.schema["item_id"].dataType.simpleString()).select(*columns, F.explode("_found").alias("f")).select("*", "f.*").drop("f")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item is found."""
    for items in blocks(benchmark):
        docs = with_found(docs, items, benchmark.schema["item_id"].dataType.simpleString()).where(F.size("_found") == 0).select("_row.*")
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark"), [F.col("_row.doc_id").alias("doc_id")])
