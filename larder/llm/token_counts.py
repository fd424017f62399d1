"""Token counts of whole texts under a public tokenizer, huge texts by overlapping chunks that are spliced where it is provably safe.

A place in a text is *stable* if the tokens after it can't depend on what stands before it. For tokenizers whose
pieces never hold white space (the pattern is read from the file), these are: after ASCII white space, between two ASCII digits,
and between a letter and a punctuation mark of fixed sets, away from the marks of special tokens.

A huge text (more than HUGE characters) is cut into chunks that overlap. Neighbours are encoded with offsets and spliced at a stable place in the overlap
where both have a token's start; where there is none the overlap is doubled, and in the end the chunk itself, so that
a text without any stable place is encoded in one piece. Texts of ordinary size are taken apart at all their white space, which is
stable everywhere, and each distinct segment is encoded once for a worker; splicing them all costs five times as much (README).

Defined cases: a null or empty text has no tokens; a special token's string inside a text counts as the library counts it; repeated rows are counted
each, an empty table gives no rows; columns other than those asked for are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 2048
HUGE, CHUNK, OVERLAP = 16_384, 8_192, 256
CACHED = 500_000
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"

# The pre-tokenizer pattern for which the stable places are proven, and characters whose classes never changed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = frozenset(" \t\n\r\x0b\x0c")
DIGITS = frozenset("0123456789")
MARKS = frozenset("!\"#$%&'()*+,-./:;=?@[\\]^_`{}~、。，！？；：「」『』（）")


def is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha() or "À" <= c <= "ÿ" and c not in "×÷" or "ぁ" <= c <= "ゖ" or "ァ" <= c <= "ヺ" or "一" <= c <= "龥" or "가" <= c <= "힣"


def is_stable(text: str, p: int) -> bool:
    a, b = text[p - 1], text[p]
    if a in SPACES and b not in SPACES or a in DIGITS and b in DIGITS:
        return True
    return b in MARKS and is_letter(a) and "<|" not in (near := text[max(0, p - 32) : p + 32]) and "|>" not in near


class Counter:
    """Counts for one tokenizer file; keeps the counts of segments that it has seen."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.huge, self.chunk, self.overlap, self.seen, self.widened, self.splices = huge, chunk, overlap, {}, 0, 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.splits = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.whole = lambda texts: [len(x) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.splits = any(x.get("pattern", {}).get("Regex") == PATTERN and x.get("invert") and x.get("behavior") == "Removed" for x in steps)

    def starts(self, text: str) -> list[int]:
        return [x for x, _ in self.tok.encode(text, add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """The tokens of a huge text."""
        n, total = len(text), 0
        a, end = 0, min(len(text), self.chunk)
        left = self.starts(text[:end])  # starts of tokens, relative to the text, of the piece that ends at `end`
        while end < n:
            overlap, size, found = self.overlap, self.chunk, None
            while found is None:
                c = end - overlap
                if c <= a:  # the whole piece holds no stable place: it grows
                    self.widened += 1
                    end = min(n, end + size)
                    size *= 2
                    left = [a + x for x in self.starts(text[a:end])]
                    if end == n:
                        return total + len(left)
                    overlap = self.overlap
                    continue
                right = [c + x for x in self.starts(text[c : min(n, end + self.chunk)])]
                common = set(left).intersection(right)
                found = next((p for p in sorted(common, key=lambda p: abs(2 * p - c - end)) if c < p < end and is_stable(text, p)), None)
                if found is None:
                    self.widened += 1
                    overlap *= 2
            total += sum(x < found for x in left)
            self.splices += 1
            a, end = found, min(n, end + self.chunk)
            left = [x for x in right if x >= found]
        return total + len(left)

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.whole(texts)
        out, parts, new = [0] * len(texts), {}, {}
        for i, t in enumerate(texts):
            if len(t) > self.huge:
                out[i] = self.spliced(t)
            else:
                parts[i] = t.encode().split()
                new.update((w, None) for w in parts[i] if w not in self.seen)
        todo = list(new)
        fresh = dict(zip(todo, self.whole([w.decode() for w in todo]), strict=True))
        if len(self.seen) + len(fresh) > CACHED:
            known = {w for ws in parts.values() for w in ws}
            self.seen = {w: n for w, n in self.seen.items() if w in known}
        self.seen |= fresh
        for i, ws in parts.items():
            out[i] = sum(map(self.seen.__getitem__, ws))
        return out


@lru_cache(maxsize=4)
def counter(path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return Counter(path, huge, chunk, overlap)


def token_counts(text: Column, path: str, limit: int = LIMIT) -> Column:
    """A struct of n_bytes, n_tokens and over_limit; path is the tokenizer's file, at the same place on every worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x or "" for x in batch]
            n = counter(path).count(texts)
            yield pd.DataFrame({"n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return F.pandas_udf(run, SCHEMA)(text)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("t")).select("doc_id", "t.*")
