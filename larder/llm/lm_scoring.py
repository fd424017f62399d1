"""Scores of texts under a word-count model and under a small causal self-attention model over subword ids, trained in numpy.

Base model. Words are counted over all training texts in a first pass. Words with a share of 1/FREQUENT or more of all tokens are at most FREQUENT, so
their counts are broadcast, and the second pass adds up what they give to each text; the other words of a text meet their counts in a join
by word, whose largest key has that share at most.

Attention model. A text is its words' subword ids and an end mark. From the ids before it, self-attention and one hidden layer give each
position weights over K distributions of ids, and their mixture is the next id's probability; it sums to one over the vocabulary.
SAMPLE windows of the training texts, chosen by hash over all of them, only give a start by gradient descent on the driver. Then all training texts, each of their ids once
as a target in windows without overlap, fit the attention's parameters: texts are dealt by a hash into shards of about SHARD ids and these into ROUNDS rounds; in a
round each shard is descended over, in the order of its texts' hashes, from common parameters, and the driver adds the moves, weighted by what each has
seen. Moves are added as whole numbers of a fixed unit, so the model doesn't depend on how rows are split over tasks. At last one
expectation-maximisation pass over every training text estimates the K distributions anew: executors add up how much each component explains of
each id, and only these sums, of a fixed size, come back. Scoring cuts texts into windows of WINDOW ids of which the last STRIDE
are scored, each id once, with what precedes in the window as context; windows of many texts go through masked attention in one batch.

Defined cases: a null or empty text is its end mark alone; without training texts counts are zero and the attention model is uniform;
rows with the same or null ids are scored one by one (a null id counts as empty text for the split);
columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, swept, table, tidy

FREQUENT = 400_000
WINDOW, STRIDE = 32, 24
SIZE, HIDDEN, MIXED = 16, 16, 16
SAMPLE, STEPS, BATCH, PER_TEXT = 8192, 240, 192, 4
ROUNDS, RATE, SHARD, UNIT = 4, 0.004, 1 << 20, float(1 << 16)
SMOOTH = 50.0
CACHED, SLICE, TOGETHER, SCORED, BLOCK, HASHED = 200_000, 1 << 22, 256, 64, 256, 200_000
BLANK = re.compile(r"[^\S ]")
_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# -- texts as words and ids


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding of a rank file; ids are below the end mark, whose id is their number."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def spaced(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    encoding = encoder(path)
    return np.array([encoding.decode_single_token_bytes(k).startswith(b" ") for k in range(encoding.n_vocab)])


class Words:
    """Numbers words as they come and keeps their subword ids (16 bits each) and what `known` tells of them (nan: nothing)."""

    def __init__(self, path: str, known: dict[bytes, float] | None = None):
        self.encoding, self.known = encoder(path), known or {}
        self.first = spaced(path)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat, self.at, self.told = np.empty(0, np.uint16), np.zeros(1, np.int64), np.empty(0)

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space before it, and how many each has.

        Words hold no space, so in a text of many words those ids whose bytes begin with a space begin a word, unless other white space is in the way.
        """
        text = b" ".join([b"", *words]).decode()
        if not BLANK.search(text):
            ids = self.encoding.encode_to_numpy(text, disallowed_special=())
            first = np.flatnonzero(self.first[ids])
            if len(first) == len(words):
                return ids.astype(np.uint16), np.diff(np.append(first, len(ids)))
        if len(words) == 1:
            ids = self.encoding.encode_ordinary(text)
            return np.array(ids, np.uint16), np.array([len(ids)])
        odd = [bool(BLANK.search(w.decode())) for w in words]
        if not any(odd) or all(odd):
            parts = [self.encoded([w]) for w in words]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        rest, one = self.encoded([w for w, o in zip(words, odd, strict=True) if not o]), self.encoded([w for w, o in zip(words, odd, strict=True) if o])
        at = np.argsort(odd, kind="stable")  # those without other white space first
        sizes = np.empty(len(words), np.int64)
        sizes[at] = both = np.concatenate([rest[1], one[1]])
        begin = np.empty(len(words), np.int64)
        begin[at] = np.cumsum(both) - both
        return np.concatenate([rest[0], one[0]])[spread(begin, sizes)], sizes

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        out = np.array(list(map(self.seen.get, words, repeat(-1))), np.int64)
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [words[k] for k in at.tolist()]
            out[at] = np.arange(len(self.seen), len(self.seen) + len(new))
            self.seen.update(zip(new, out[at].tolist(), strict=True))
            ids, sizes = self.encoded(new)
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.append(self.at, self.at[-1] + np.cumsum(sizes))
            self.told = np.append(self.told, np.array(list(map(self.known.get, new, repeat(np.nan)))))
        return out

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        sizes = np.diff(self.at)[numbers]
        return self.flat[spread(self.at[numbers], sizes)], sizes

    def ids(self, words: list[bytes]) -> bytes:
        return self.joined(np.concatenate([self.numbers([w]) for w in words]))[0].tobytes() if words else b""


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each size, strung together."""
    return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_lower).split()


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all of them, lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")  # white space at either end leaves empty words
    return np.bincount(text.filter(some).to_numpy(), minlength=len(texts)), words.filter(some)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Runs of texts of `most` bytes at most, for words and their numbers take many times the room of the text; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c, how often it comes in the column text of texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part.column(0).cast(pa.string()), 4 * SLICE):  # the longer, the fewer rows
                tally = words_in(some)[1].value_counts()
                yield pa.RecordBatch.from_arrays([tally.field(0).cast(pa.binary()), tally.field(1)], ["word", "c"])
        tidy()

    return stored(texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def read(text: Column, path: str, often: Broadcast) -> Column:
    """A struct of n_words, the subword ids, the frequent words' sum of log10(c + 1) and number, and the other distinct words with their counts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Words(path, often.value)
        for batch in batches:
            batch = batch.cast(pa.string())
            yield pa.concat_arrays([part(some, vocabulary) for some in slices(batch)] or [part(batch, vocabulary)])
        del vocabulary
        tidy()

    def part(texts: pa.Array, vocabulary: Words) -> pa.Array:
        n, words = words_in(texts)
        words = words.dictionary_encode()
        kinds, place = words.dictionary.cast(pa.binary()), words.indices.to_numpy()
        numbers = vocabulary.numbers(kinds.to_pylist())
        text, number = np.repeat(np.arange(len(n)), n), numbers[place]
        ids, sizes = vocabulary.joined(number)
        edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))] * 2
        ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
        logs = vocabulary.told[number]
        rare = np.isnan(logs)
        known = n - np.bincount(text[rare], minlength=len(n))
        logs = np.bincount(text, np.where(rare, 0.0, logs), len(n))
        # the other words of a text once each
        pairs, times = np.unique(text[rare] * len(kinds) + place[rare], return_counts=True)
        edges = np.append(0, np.cumsum(np.bincount(pairs // max(1, len(kinds)), minlength=len(n)))).astype(np.int32)
        others = pa.ListArray.from_arrays(edges, kinds.take(pa.array(pairs % max(1, len(kinds)))))
        counts = pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))
        if len(vocabulary.seen) > CACHED:
            vocabulary.clear()
        return pa.StructArray.from_arrays([pa.array(n), ids, pa.array(logs), pa.array(known), others, counts], ["n_words", "ids", "logs", "known", "words", "counts"])

    return F.arrow_udf(run, "n_words long, ids binary, logs double, known long, words array<binary>, counts array<int>")(text)


# -- the attention model


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return x / x.sum(-1, keepdims=True)


def windows(ids: np.ndarray, lengths: np.ndarray, end: int, step: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and the text of each window over the texts that are strung together in ids, each length including its end mark.

    A window's first WINDOW - step places only give context; places outside the text have target -1.
    """
    n, lead = -(-lengths // step), WINDOW - step
    text = np.repeat(np.arange(len(lengths)), n)
    first, room = np.cumsum(lengths) - lengths, lead + n * step
    begin = np.cumsum(room) - room  # each text with room around it, so that a window is a run
    at = spread(begin + lead, lengths)
    x, y = np.full((2, room.sum()), -1)
    y[at] = ids
    # the input of a place is the id before it, and the start mark at a text's first place
    x[at[1:]] = ids[:-1]
    x[at[first]] = end + 1
    runs = spread(begin, n) * step - np.repeat(begin * (step - 1), n)
    x, y = (np.lib.stride_tricks.sliding_window_view(v, WINDOW)[runs] if len(runs) else v.reshape(0, WINDOW) for v in (x, y))
    return x, y, text


Rows = tuple[np.ndarray, np.ndarray]


def by_row(ids: np.ndarray, values: np.ndarray) -> Rows:
    """The distinct ids and the sums of their values."""
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")  # 16 bits are sorted digit by digit
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    values = values.take(order, 0)
    if values.shape[1] % 2 == 0:  # two numbers are added as one complex number
        return ids[first], np.add.reduceat(values.view(f"c{2 * values.itemsize}"), first, axis=0).view(values.dtype)
    return ids[first], np.add.reduceat(values, first, axis=0)


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; a product is faster than a sum over short rows."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def blocks(x: np.ndarray) -> np.ndarray:
    """Rows in blocks where they divide evenly: products of thin matrices are faster in blocks."""
    return x.reshape(-1, BLOCK, x.shape[-1]) if len(x) and len(x) % BLOCK == 0 else x[None]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of a long a and a small b."""
    return (blocks(a) @ b).reshape(len(a), -1)


def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of two long ones."""
    return (blocks(a).swapaxes(1, 2) @ blocks(b)).sum(0)


def turned(x: np.ndarray) -> np.ndarray:
    """The last two axes swapped, in a copy, which products take faster."""
    return np.ascontiguousarray(x.swapaxes(1, 2))


class Attention:
    """Parameters by name. Ids run from 0 to the end mark; the start mark after it is an input only."""

    def __init__(self, end: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.end = end
        self.p = {
            "emb": (rng.standard_normal((end + 2, SIZE)) * 0.5).astype(np.float32), "q": r(SIZE, SIZE), "k": r(SIZE, SIZE), "v": r(SIZE, SIZE), "o": r(SIZE, HIDDEN),
            "r": r(SIZE, HIDDEN), "bh": np.zeros(HIDDEN, np.float32), "u": r(HIDDEN, MIXED), "b": np.zeros(MIXED, np.float32), "rel": np.zeros(WINDOW, np.float32),
            "z": (rng.standard_normal((MIXED, end + 1)) * 0.3).astype(np.float32),
        }
        self.dist: np.ndarray | None = None  # ids by components, after the pass over all texts
        lag = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
        self.lag, self.future = np.maximum(lag, 0), lag < 0

    def loss(self, x: np.ndarray, y: np.ndarray, dist: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], Rows, Rows]:
        """Mean loss in nats over the places with a target, the gradients, that of emb by its rows, and the targets with what components explain of each.

        With fixed distributions (ids by components) there is no gradient of z.
        """
        p, scale, shape = self.p, np.float32(SIZE**-0.5), (*x.shape, -1)
        pad, n = x < 0, max(int((y >= 0).sum()), 1)
        has, xs, ys = (y >= 0).astype(np.float32).reshape(-1, 1), np.where(pad, self.end + 1, x).ravel(), np.maximum(y, 0).ravel()
        e = p["emb"].take(xs, 0)
        into = {"q": p["q"] * scale, "k": p["k"], "v": p["v"], "r": p["r"]}
        q, k, v, r = (product(e, w) for w in into.values())  # each in an array of its own, for products of strided ones take twice the time
        q, k, v = q.reshape(shape), k.reshape(shape), v.reshape(shape)
        a = q @ turned(k)
        plain = max(a.max(initial=0), -a.min(initial=0)) + np.abs(p["rel"]).max() < 60  # exponents in this range need no shift by the largest
        a += np.where(self.future, np.float32(-1e9), p["rel"][self.lag])
        if (some := pad.any(1)).any():
            a[some] += np.where(pad[some], np.float32(-1e9), np.float32(0))[:, None, :]
        if not plain:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        # a stays as it is; what it is multiplied with is divided by its rows' sums, which takes fewer numbers
        part = row_sums(a).reshape(-1, 1)
        part = 1 / np.where(part > 0, part, np.float32(1))
        o = (a @ v).reshape(e.shape)
        o *= part
        h = product(o, p["o"])
        h += r
        h += p["bh"]
        slope = np.abs(h)
        slope += 1
        np.reciprocal(slope, out=slope)
        h *= slope
        pi = product(h, p["u"])
        pi += p["b"]
        if np.abs(p["u"]).sum(0).max() + np.abs(p["b"]).max() >= 60:
            pi -= pi.max(-1, keepdims=True)
        np.exp(pi, out=pi)
        pi /= row_sums(pi)
        fixed = dist is not None
        dist = dist if fixed else np.ascontiguousarray(softmax(p["z"].copy()).T)
        resp = pi * dist.take(ys, 0)
        total = row_sums(resp) + 1e-30
        resp *= has / total
        out = -float((np.log(total) * has).sum()) / n
        g: dict[str, np.ndarray] = {}
        dg = pi
        dg -= resp
        dg *= has / n
        hit = ys, resp
        if not fixed:
            z = np.zeros((MIXED, self.end + 1), np.float32)
            rows, sums = by_row(*hit)
            z[:, rows] = sums.T
            g["z"] = (z.sum(1, keepdims=True) * dist.T - z) / np.float32(n)
        ones = np.ones(len(e), e.dtype)
        g["u"], g["b"] = across(h, dg), ones @ dg
        dt = product(dg, p["u"].T)
        dt *= slope
        dt *= slope
        g["o"], g["bh"] = across(o, dt), ones @ dt
        do = product(dt, p["o"].T)
        do *= part
        # the weighted sum of each row of ds is taken off
        o *= do
        less, do = row_sums(o).reshape(*x.shape, 1), do.reshape(shape)
        ds = do @ turned(v)
        ds -= less
        ds *= a
        g["rel"] = np.bincount(self.lag.ravel(), np.where(self.future.ravel(), 0, ones[: len(ds)] @ ds.reshape(len(ds), -1)), WINDOW).astype(np.float32)
        back = {"q": ds @ k, "k": ds.swapaxes(1, 2) @ q, "v": a.swapaxes(1, 2) @ do, "r": dt}
        de = np.zeros_like(e)
        for name, d in back.items():
            d = d.reshape(len(e), -1)
            g[name] = across(e, d)
            de += product(d, into[name].T)
        g["q"] *= scale
        return out, g, by_row(xs, de), hit

    def step(self, state: dict, t: int, g: dict[str, np.ndarray], emb: Rows, rate: float) -> None:
        """One step of Adam; of emb only the rows that a batch has."""
        fix = rate / (1 - 0.9**t), 1 - 0.99**t
        for k, d, rows in [*((k, d, slice(None)) for k, d in g.items()), ("emb", emb[1], emb[0])]:
            a, b = state[k]
            x, y = (a.take(rows, 0), b.take(rows, 0)) if k == "emb" else (a, b)
            x = x + np.float32(0.1) * (d - x)
            y = y + np.float32(0.01) * (d * d - y)
            a[rows], b[rows] = x, y
            self.p[k][rows] -= (fix[0] * x / (np.sqrt(y / fix[1]) + 1e-8)).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02) -> None:
        if not len(x) or not (y >= 0).any():
            return
        rng = np.random.default_rng(5)
        share = np.bincount(y[y >= 0], minlength=self.end + 1) + 0.1
        self.p["z"] += np.log(share / share.sum()).astype(np.float32)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(BATCH, len(x)))
            _, g, emb, _ = self.loss(x[rows], y[rows])
            self.step(state, t, g, emb, rate * min(1.0, 2 * (1 - t / (steps + 1))))

    def tables(self) -> Tables:
        dist = softmax(self.p["z"].astype(np.float64)).T if self.dist is None else self.dist
        return Tables(self.p, self.end, np.ascontiguousarray(dist, np.float32), self.lag, self.future)


class Tables:
    """What scoring needs, with the projections of every id worked out before."""

    def __init__(self, p: dict[str, np.ndarray], end: int, dist: np.ndarray, lag: np.ndarray, future: np.ndarray):
        self.end, self.dist = end, dist
        pad = np.zeros((1, SIZE), np.float32)  # row -1 is outside of the text
        self.q = np.concatenate([p["emb"] @ p["q"] * np.float32(SIZE**-0.5), pad])
        self.k = np.concatenate([p["emb"] @ p["k"], pad])
        # with the last column weights are added up; outside of the text it is 0 as well
        v = np.concatenate([p["emb"] @ p["v"] @ p["o"], np.ones((end + 2, 1), np.float32)], 1)
        self.v = np.concatenate([v, np.zeros((1, HIDDEN + 1), np.float32)])
        self.r = np.concatenate([p["emb"] @ p["r"] + p["bh"], pad])
        self.u, self.b = p["u"], p["b"]
        c = WINDOW - STRIDE
        self.rel, self.seen = p["rel"][lag][c:], np.where(future, np.float32(0), np.float32(1))[c:]
        # with exponents in this range single precision needs no shift by the largest
        top = np.linalg.norm(self.q, axis=1).max() * np.linalg.norm(self.k, axis=1).max() + np.abs(self.rel).max()
        self.plain = bool(top < 60 and np.abs(self.u).sum(0).max() + np.abs(self.b).max() < 60)
        self.lags = np.exp(self.rel) * self.seen if self.plain else self.seen

    def weighted(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a window's last STRIDE places: the joint weights of components and targets, and these targets."""
        c = WINDOW - STRIDE
        late, y = x[:, c:], y[:, c:]
        s = self.q.take(late, 0) @ turned(self.k.take(x, 0))
        if not self.plain:
            s += self.rel
            s -= np.where((self.seen > 0) & (x >= 0)[:, None, :], s, np.float32(-1e30)).max(-1, keepdims=True)
            np.minimum(s, 0, out=s)
        np.exp(s, out=s)
        s *= self.lags
        h = s @ self.v.take(x, 0)
        h = (h[..., :-1] / np.maximum(h[..., -1:], np.float32(1e-30))).reshape(-1, HIDDEN)
        h += self.r.take(late.ravel(), 0)
        h /= 1 + np.abs(h)
        g = product(h, self.u).reshape(*late.shape, MIXED)
        g += self.b
        if not self.plain:
            g -= g.max(-1, keepdims=True)
        np.exp(g, out=g)
        # weights over components, which add up to one, times what each gives the target
        total = g @ np.ones((MIXED, 1), np.float32)
        g *= self.dist.take(np.maximum(y, 0), 0)
        g /= total
        return g, y


def strung(ids: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with an end mark after each, and the lengths."""
    mark = np.uint16(end).tobytes()
    lengths = np.array([len(b) // 2 + 1 for b in ids], np.int64)
    return np.frombuffer(b"".join([x for b in ids for x in (b, mark)]), np.uint16).astype(np.int32), lengths


def groups(ids: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in runs of about `most` ids at most, so that windows of a run fit in memory; a longer text is a run of its own."""
    run, n = [], 0
    for b in ids:
        if run and n + len(b) // 2 > most:
            yield run
            run, n = [], 0
        run.append(b)
        n += len(b) // 2 + 1
    if run:
        yield run


def pieces(ids: bytes, end: int, most: int = 1 << 19, each: int = STRIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of one long text's windows, a bounded number at a time."""
    one, _ = strung([ids], end)
    step = most // each * each
    for at in range(0, len(one), step):
        lead = min(at, each)  # one more window before, which is dropped, gives the first one its context
        x, y, _ = windows(one[at - lead : at + step], np.array([len(one[at - lead : at + step])]), end, each)
        yield (x[1:], y[1:]) if lead else (x, y)


def batches(ids: list[bytes], end: int, step: int = STRIDE, size: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the run's first text, inputs, targets, each window's text in the run), in batches of `size` windows at most."""
    first = 0
    for run in groups(ids):
        if len(run) == 1 and len(run[0]) > 1 << 20:
            for x, y in pieces(run[0], end, each=step):
                for at in range(0, len(x), size):
                    yield first, x[at : at + size], y[at : at + size], np.zeros(len(x[at : at + size]), np.int64)
        else:
            x, y, text = windows(*strung(run, end), end, step)
            for at in range(0, len(x), size):
                yield first, x[at : at + size], y[at : at + size], text[at : at + size]
        first += len(run)


def log_probabilities(model: Tables, ids: list[bytes]) -> np.ndarray:
    """log10 of the probability of each text."""
    out = np.zeros(len(ids))
    for first, x, y, text in batches(ids, model.end, size=SCORED):
        g, y = model.weighted(x, y)
        p = np.log10(np.maximum((g @ np.ones((MIXED, 1), np.float32))[..., 0], np.float32(1e-37))) * (y >= 0)
        out += np.bincount(first + text, p.sum(1, dtype=np.float64), len(out))
    return out


# -- over tables


def sampled(ids: Column, salt: Column, below: int) -> Column:
    """Up to PER_TEXT windows of a text at places drawn from its salt, as hashes and 16-bit ids (the id before, then WINDOW ids); of these those with a hash below `below`."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, salts in parts:
            out = []
            for b, s in zip(texts, salts, strict=True):
                n = len(b) // 2
                rng = np.random.default_rng(int(s) & (1 << 63) - 1)
                at = sorted(set(rng.integers(0, max(1, n - WINDOW + 1), PER_TEXT).tolist()))
                drawn = [(h, a) for a in at if (h := int(rng.integers(1 << 62))) < below]
                out.append([{"h": h, "first": a == 0, "w": b[2 * max(0, a - 1) : 2 * (a + WINDOW)]} for h, a in drawn])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<h:bigint,first:boolean,w:binary>>")(ids, salt)


def started(texts: DataFrame, end: int) -> Attention:
    """The model after gradient descent on the sample."""
    model = Attention(end)
    # every text has a window or more, so this share of all hashes holds SAMPLE windows with room to spare, and tasks send a bounded number
    share = min(1.0, 1.5 * SAMPLE / max(1, texts.count()))
    drawn = texts.select(F.explode(sampled(F.col("ids"), F.col("key"), int(share * (1 << 62)))).alias("s")).select("s.*")
    rows = drawn.orderBy("h", "w").limit(SAMPLE).collect()
    x, y = np.full((len(rows), WINDOW), -1, np.int64), np.full((len(rows), WINDOW), -1, np.int64)
    for i, r in enumerate(rows):
        w = np.frombuffer(bytes(r["w"]), np.uint16).astype(np.int64)
        if r["first"]:
            w = np.concatenate([[end + 1], w])
        if len(w) <= WINDOW:
            w = np.append(w, end)
        x[i, : len(w) - 1], y[i, : len(w) - 1] = w[:-1], w[1:]
    model.fit(x, y)
    return model


def explained(texts: DataFrame, model: Tables) -> np.ndarray:
    """How often each id comes in all texts, split by the components that explain it: ids by components."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((m.end + 1, MIXED))
        for part in parts:
            for _, x, y, _ in batches(part.column(0).to_pylist(), m.end):
                g, y = m.weighted(x, y)
                # places without a target give nothing to id 0
                g *= (y >= 0)[..., None] / np.maximum(row_sums(g), np.float32(1e-30))
                ids, sums = by_row(np.maximum(y, 0).ravel(), g.reshape(-1, MIXED))
                total[ids] += sums
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, c]) for c in range(MIXED)]], ["id", *[f"c{c}" for c in range(MIXED)]])

    names = [f"c{c}" for c in range(MIXED)]
    got = texts.select("ids").mapInArrow(run, "id int, " + ", ".join(f"{n} double" for n in names)).groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((model.end + 1, MIXED))
    out[got["id"].to_numpy()] = got[names].to_numpy()
    return out


def descended(shards: DataFrame, model: Attention, rate: float) -> np.ndarray:
    """Moves the model's parameters but z by a pass over all windows of shards (shard, key, ids); ids by components as in explained().

    A shard's result depends on its rows only, and results are added as whole numbers, so it doesn't matter which tasks have them.
    """
    small = [k for k in model.p if k not in ("emb", "z")]
    dist = np.ascontiguousarray(softmax(model.p["z"].astype(np.float64)).T if model.dist is None else model.dist, np.float32)
    shared = shards.sparkSession.sparkContext.broadcast((model, dist))
    names = [f"c{c}" for c in range(SIZE)]
    flat = lambda p: np.concatenate([p[k].ravel() for k in small]).reshape(-1, SIZE)
    top = model.end + 2
    rows = len(flat(model.p))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, dist = shared.value
        moved, weight, hits = np.zeros((top + rows, SIZE), np.int64), np.zeros(top + rows, np.int64), np.zeros((first.end + 1, MIXED), np.int64)

        def add(ids: list[bytes]) -> None:
            m = Attention(first.end)
            m.p = {k: v.copy() for k, v in first.p.items()}
            state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items() if k != "z"}
            told, met, seen, t = np.zeros((m.end + 1, MIXED)), [], 0, 0
            for _, x, y, _ in batches(ids, m.end, WINDOW):
                _, g, emb, hit = m.loss(x, y, dist)
                ids_hit, sums = by_row(*hit)
                told[ids_hit] += sums
                met.append(x[x >= 0])
                seen, t = seen + int((y >= 0).sum()), t + 1
                m.step(state, t, g, emb, rate)
            w = np.append(np.bincount(np.concatenate(met), minlength=top), np.full(rows, seen))
            move = np.concatenate([m.p["emb"] - first.p["emb"], flat(m.p) - flat(first.p)]).astype(np.float64)
            moved[:] += np.rint(move * w[:, None] * UNIT).astype(np.int64)
            weight[:] += w
            hits[:] += np.rint(told * UNIT).astype(np.int64)

        now, ids, n = None, [], 0
        for part in parts:
            for shard, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if ids and (shard != now or n > 4 * SHARD):  # so many rows with one hash are cut where others end
                    add(ids)
                    ids, n = [], 0
                now = shard
                ids.append(b)
                n += len(b) // 2 + 1
        if ids:
            add(ids)
        used, told = np.flatnonzero(weight), np.flatnonzero(hits.any(1))
        at, w = np.concatenate([used, top + rows + told]), np.concatenate([weight[used], np.zeros(len(told), np.int64)])
        values = np.concatenate([moved[used], hits[told]])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w), *[pa.array(np.ascontiguousarray(values[:, c])) for c in range(SIZE)]], ["id", "w", *names])

    sums = [F.sum(n).alias(n) for n in ("w", *names)]
    dealt = shards.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "ids")
    got = dealt.mapInArrow(run, "id int, w long, " + ", ".join(f"{n} long" for n in names)).groupBy("id").agg(*sums).toPandas()
    ids, w, v = got["id"].to_numpy(), got["w"].to_numpy(), got[names].to_numpy() / UNIT
    told, hits = ids >= top + rows, np.zeros((model.end + 1, MIXED))
    hits[ids[told] - top - rows] = v[told]
    move = np.zeros((top + rows, SIZE), np.float32)
    move[ids[~told]] = v[~told] / w[~told, None]
    model.p["emb"] += move[:top]
    rest, at = move[top:].ravel(), 0
    for k in small:
        model.p[k] += rest[at : at + model.p[k].size].reshape(model.p[k].shape)
        at += model.p[k].size
    return hits


def smoothed(n: np.ndarray) -> np.ndarray:
    u = n.sum(1) + 0.5
    u /= u.sum()
    return (n + SMOOTH * u[:, None]) / (n.sum(0) + SMOOTH)


def trained(texts: DataFrame, end: int) -> Attention:
    """texts: key (a hash of the id and the text), n_ids and ids of the training texts."""
    model = started(texts, end)
    total = texts.agg(F.sum("n_ids")).first()[0] or 0
    shards = ROUNDS * max(1, -(-total // (ROUNDS * SHARD)))
    dealt = texts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "ids")
    n = np.zeros((end + 1, MIXED))
    for k in range(ROUNDS if total else 0):
        n += descended(dealt.where(F.col("shard") % ROUNDS == k), model, RATE * (1 - k / ROUNDS))
        model.dist = smoothed(n)
        swept(texts.sparkSession)  # a round has shuffled its part of all ids
    model.dist = smoothed(explained(texts, model.tables()))
    return model


def base_scores(texts: DataFrame, counts: DataFrame, n: int, v: int, ends: int) -> DataFrame:
    """rid, n_known, train_tokens and base_score of stored texts (rid, n_words, logs, known, words, counts); counts (word, c) of the words that texts list."""
    pairs = texts.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("rid", F.col("p.words").alias("word"), F.col("p.counts").alias("k"))
    # a table of words in memory, in so many parts that each is small, spares sorting all pairs
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-v // HASHED))
    rare = pairs.repartition(parts, "word").join(counts.repartition(parts, "word").hint("shuffle_hash"), "word")  # words without a count add log10(1) = 0
    rare = rare.groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("k").alias("met"))
    z, end_log = float(np.log10(n + v + 1)), float(np.log10(ends + 1.0))
    return texts.select("rid", "n_words", "logs", "known").join(rare, "rid", "left").select(
        "rid", (F.col("known") + F.coalesce("met", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) + end_log - (F.col("n_words") + 1) * z).alias("base_score"),
    )


def scored(docs: DataFrame, path: str) -> DataFrame:
    """docs: _id, text and held_out; the columns of op2."""
    spark = docs.sparkSession
    learned = docs.where("NOT held_out")
    counts, ends = word_counts(learned), learned.count()
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    swept(spark)
    n, v = (total or 0) + ends, kinds + (ends > 0)
    # at most FREQUENT rows, for their counts add up to n at most, of bounded length
    is_often = (F.col("c") * FREQUENT >= n) & (F.octet_length("word") <= 64)
    often = counts.where(is_often).toArrow()
    often = dict(zip(often["word"].to_pylist(), np.log10(often["c"].to_numpy() + 1.0).tolist(), strict=True))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("_id", "held_out", F.xxhash64("_id", text).alias("key"), read(text, path, spark.sparkContext.broadcast(often)).alias("r")).select("_id", "held_out", "key", "r.*")
    rows = rows.withColumn("n_ids", (F.octet_length("ids") / 2 + 1).cast("long"))
    texts = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "texts")
    model = trained(texts.where("NOT held_out").select("key", "n_ids", "ids"), encoder(path).n_vocab)
    shared = spark.sparkContext.broadcast(model.tables())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(log_probabilities(shared.value, part.tolist()))

    score = stored(texts.select("rid", "_id", "held_out", "n_words", F.pandas_udf(run, "double")(F.col("ids")).alias("score")), "scores")
    base = base_scores(texts, counts.where(~is_often), n, v, ends)
    out = score.join(base, "rid")
    return out.select(F.col("_id").alias("doc_id"), "held_out", (F.col("n_words") + 1).cast("long").alias("n_tokens"), "n_known", "train_tokens", "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    return scored(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
