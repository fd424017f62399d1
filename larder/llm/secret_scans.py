"""Secrets in texts: three base patterns, and encoded keys and signed tokens that are reported only if their structure holds.

Base64 and hex candidates are decoded and parsed: a private key must be a DER sequence whose nested lengths fill it
exactly and whose fields are those of PKCS#1, PKCS#8 (plain or encrypted) or SEC 1, or an OpenSSH key whose length-prefixed fields fill it;
keys may be in either base64 alphabet, wrapped over lines, or in armour, whose headers may say that the key is encrypted by a block cipher; a signed token must have a JSON header that names an algorithm and a JSON payload. What decodes to text is decoded once more.

All patterns start at the start of a run and never give characters back, so a text takes time linear in its length.
Offsets count code points, ends are exclusive. Defined cases: a null text is empty; the hash of no spans is that of the empty string; repeated rows are
scanned one by one; an empty table gives no rows; only the text (and n_chars, which redact() counts anew) is read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}[0-9a-f]*")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]++)")
PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----((?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z-]*+: [^\r\n\\]*+)*+)([A-Za-z0-9+/=\s\\]*+)(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?"
)
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}")
B64_RUN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{44,}+={0,2}")
URL_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{44,}+={0,2}")
#: Lines of 40 characters or more, and a last one of any length.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+[ \t]*+\r?\n[ \t]*+)++(?:[A-Za-z0-9+/_-]++={0,2})?")
HEX_RUN = re.compile(r"(?<![A-Za-z0-9+/])(?:[0-9a-fA-F]{2}){32,}+(?![A-Za-z0-9+/=])")
MARK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end); leftmost without overlap within a kind, those that are too short left out."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run is maximal, so runs of 24 or more are what the pattern for runs finds, less those that are too short
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return out


def unbase64(s: str, alphabet: bytes | None = None) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER values that fill data exactly; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k])
            if n < 128 or k > 1 and n < 1 << 8 * (k - 1):  # not the shortest form
                return None
            at += k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    if data[:1] != b"\x30" or not (top := fields(data)) or len(top) != 1 or not (inner := fields(top[0][1])):
        return False
    tags = [t for t, _ in inner]
    if tags[:1] != [2]:
        return False
    if len(inner) >= 9 and tags[:9] == [2] * 9 and all(x for _, x in inner[:9]):  # PKCS#1
        return int.from_bytes(inner[0][1]) in (0, 1) and len(inner[1][1]) >= 32
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):  # PKCS#8
        named = fields(inner[1][1])
        return bool(named) and named[0][0] == 6 and len(inner[2][1]) >= 16
    return tags[:2] == [2, 4] and inner[0][1] == b"\1" and len(inner[1][1]) in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_encrypted_key(data: bytes) -> bool:
    """PKCS#8, encrypted: a named scheme with its parameters, and what it encrypts."""
    if data[:1] != b"\x30" or not (top := fields(data)) or len(top) != 1 or not (inner := fields(top[0][1])) or [t for t, _ in inner] != [0x30, 4]:
        return False
    scheme = fields(inner[0][1])
    return bool(scheme) and [t for t, _ in scheme] == [6, 0x30] and bool(fields(scheme[1][1])) and len(inner[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, names = len(magic), []

    def part() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        got = data[at + 4 : at + 4 + n]
        if at + 4 > len(data) or len(got) < n:
            return None
        at += 4 + n
        return got

    for _ in range(3):
        if (x := part()) is None:
            return False
        names.append(x)
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    return 1 <= keys <= 16 and all(part() is not None for _ in range(keys + 1)) and at == len(data) and names[0].isascii()


def key_kind(data: bytes | None, depth: int = 1) -> str | None:
    if not data:
        return None
    if is_der_key(data) or is_encrypted_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    if depth and data.isascii():
        s = data.decode().strip()
        if m := PEM.search(s):
            return "pem" if is_armoured(m) else None
        if HEX_RUN.fullmatch(s):
            return key_kind(bytes.fromhex(s), 0)
        if B64_RUN.fullmatch(s):
            return key_kind(unbase64(s), 0)
    return None


def is_armoured(m: re.Match) -> bool:
    """Whether what PEM found holds a key, or by its headers one that a block cipher encrypts."""
    data = unbase64(re.sub(r"\\[nr]|\s", "", m[2]))
    return bool(key_kind(data, 0)) or bool(data) and CIPHER.search(m[1]) is not None and len(data) >= 16 and len(data) % 8 == 0


def run_kind(s: str) -> str | None:
    """The kind of key in a run of characters; hex digits are base64 characters too, so a run is tried as either."""
    digits = s[2:] if s[:2] in ("0x", "0X") else s
    if HEX_RUN.fullmatch(digits) and (kind := key_kind(bytes.fromhex(digits))):
        return kind
    return key_kind(unbase64(s, b"-_" if "-" in s or "_" in s else None))


def is_token(m: re.Match) -> bool:
    try:
        head, body = (json.loads(unbase64(m[i], b"-_") or b"") for i in (1, 2))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and (head["alg"].lower() == "none" or len(m[3]) >= 16)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_token(m)]
    keys = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if is_armoured(m):
                keys.append((m.start(), 4, m.end()))
    free = lambda start, end: not any(s <= start and end <= e for s, _, e in keys)
    for m in WRAPPED.finditer(text):
        if not free(m.start(), m.end()):
            continue
        rows = m[0].split("\n")
        for n in (len(rows), len(rows) - 1):  # what follows the key may look like a last line of it
            run = "\n".join(rows[:n]).rstrip()
            if n and (kind := run_kind("".join(run.split()))):
                keys.append((m.start(), KINDS.index(kind), m.start() + len(run)))
                break
    for pattern in (B64_RUN, URL_RUN):
        for m in pattern.finditer(text):
            if free(m.start(), m.end()) and (kind := run_kind(m[0])):
                keys.append((m.start(), KINDS.index(kind), m.end()))
    return out + keys


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + confirmed_spans(text))


def redact_text(text: str) -> str:
    """text with each secret replaced by MARK; of an assignment only its value."""
    cuts = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    cuts = sorted(cuts + [(s, e) for s, k, e in base_spans(text) + confirmed_spans(text) if k])
    out, at = [], 0
    for s, e in cuts:
        if s >= at:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join([*out, text[at:]]) if cuts else text


def secrets(text: Column) -> Column:
    """A struct of n_assign, n_access, n_hex, base_sha256 and spans."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([scan_text(x or "") for x in batch], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return F.pandas_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(text)


def redacted(text: Column) -> Column:
    """The text without its secrets; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x if x is None else redact_text(x) for x in batch], dtype=object)

    return F.pandas_udf(run, "string")(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced; all rows and columns stay, n_chars counts the new text."""
    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets(F.col("text")).alias("s")).select("doc_id", "s.*")
