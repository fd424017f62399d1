"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt by a hash into shards of about SHARD pieces; each shard packs its pieces in decreasing length. A piece goes into the open bin
with the least room that still holds it. If none does, a bin is opened. A bin of capacity c costs OVERHEAD + c + c * c / ATTENTION: its places, and the work of
attention, which grows with the square of a sequence; so long bins are dear and short ones can't hold long pieces. The bin that is opened is the one that
costs least for each token it can be expected to hold: the piece, and what smaller pieces that fit beside it are still to come. The permitted sizes are
optimised jointly: a shard is packed with every set of sizes that has the largest one, each bin is downsized to the smallest permitted capacity that
holds its contents, and the set that then costs least is taken (the fewest sizes among equals). Documents beyond the largest capacity are cut into full
pieces and a rest; nothing is dropped.

A length is the number of words between ASCII white space plus one for the end mark. Only ids and lengths are shuffled, and a shard's size
is bounded, so neither long texts nor hot sources matter; rows that are repeated more often than a quarter of a shard are spread over several.

Defined cases: a null or empty text has length 1, its end mark; repeated rows are packed each; an empty table gives no bins; ids may be null and of any
type; columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import same, sized, stored, table
from .quality_rules import SPACE

CAPACITIES, OVERHEAD, ATTENTION, SHARD = (256, 512, 1024, 2048), 32, 4096, 20_000


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def filled(lengths: Sequence[int], order: Sequence[int], sizes: Sequence[int]) -> tuple[list[int], list[int]]:
    """The bin of each length and the contents of each bin, by best fit in the given order (decreasing lengths) with bins of these sizes."""
    top = sizes[-1]
    until = [0] * (top + 1)  # the sum of all lengths up to each
    for n in lengths:
        until[n] += n
    for n in range(top):
        until[n + 1] += until[n]
    room: list[int] = []  # of each bin
    content: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    some = 0  # bit r is set if a bin has room r
    where = [0] * len(lengths)
    opened: dict[int, int] = {}
    for i in order:
        x = lengths[i]
        fit = some >> x
        if fit:
            r = x + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            if x not in opened:  # smaller pieces are all still to come
                opened[x] = min((c for c in sizes if c >= x), key=lambda c: (cost(c) / (x + min(c - x, until[min(c - x, x)])), c))
            r, b = opened[x], len(room)
            room.append(r)
            content.append(0)
        content[b] += x
        room[b] = r - x
        if not by_room[r - x]:
            some |= 1 << (r - x)
        by_room[r - x].append(b)
        where[i] = b
    return where, content


def packed(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int]]:
    """The bin of each length, and each bin's capacity. No length is above the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = None
    for k in range(len(capacities)):
        for some in combinations(capacities[:-1], k):
            where, content = filled(lengths, order, [*some, capacities[-1]])
            sizes = [next(c for c in capacities if c >= n) for n in content]
            total = sum(map(cost, sizes))
            if best is None or total < best[0]:
                best = total, where, sizes
    return best[1], best[2]


def lengths_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long") + 1


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row for each piece: its bin and capacity, its slot and offset there, doc_id, and its piece number, start and length in the document."""
    top = max(capacities)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = F.xxhash64("doc_id", "text")
    rows = stored(docs.select("doc_id", lengths_of(F.col("text")).alias("n"), spread.alias("h"), F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-pieces // shard))
    much = max(1, shard // 4)
    # the counts above `much` add up to the rows at most, so there are few
    often = stored(rows.groupBy("doc_id", "h").agg((F.count("*") / much).cast("long").alias("parts")).where("parts > 0"), "repeated")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "h", "n"], kind="stable")
        ids, cut = [], []
        for doc, n in zip(part["doc_id"], part["n"], strict=True):
            for k, s in enumerate(range(0, n, top)):
                ids.append((doc, k, s))
                cut.append(min(top, n - s))
        where, sizes = packed(cut, capacities)
        out, used, slot = [], [0] * len(sizes), [0] * len(sizes)
        for (doc, k, s), n, b in zip(ids, cut, where, strict=True):
            out.append((int(key[0]) << 32 | b, sizes[b], slot[b], used[b], doc, k, s, n))
            used[b] += n
            slot[b] += 1
        got = pd.DataFrame(out, columns="bin capacity slot offset doc_id piece start length".split())
        return got.astype({"doc_id": "Int64"}) if pd.api.types.is_numeric_dtype(part["doc_id"]) else got

    dealt = rows.select("doc_id", "n", "h", "row")
    if often.limit(1).count():
        dealt = dealt.join(sized(often), same(dealt, often, ["doc_id", "h"]), "left").select(dealt["doc_id"], "n", dealt["h"], "row", "parts")
        salt = F.coalesce(F.pmod(F.col("row"), F.col("parts") + 1), F.lit(0))
    else:
        salt = F.lit(0)
    dealt = dealt.select("doc_id", "n", "h", F.pmod(F.xxhash64("h", "doc_id", salt.cast("long")), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, f"bin long, capacity int, slot int, offset int, doc_id {kind}, piece int, start long, length int")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
