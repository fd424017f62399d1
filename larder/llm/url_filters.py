"""URL filtering: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter puts a URL's eight bits into one block of eight 64-bit words. Spark builds it as bit_or by block, and its size is bounded by
MAX_BLOCKS (32 MiB) whatever the list's length: a longer list only lets more false positives through. Only the rows that
pass it go into the exact hash join with the list, which removes the false positives; the others are not shuffled.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed; repeated rows are judged
one by one; an empty list allows everything that no rule blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, start of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BITS_PER_URL, MAX_BLOCKS = 12, 1 << 19
# Odd multipliers, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. and a usual port, path without a last slash, and the sorted query without tracking; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    args = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(args != "", F.concat(F.lit("?"), args)).otherwise("")))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bloom(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter over the column url of listed, as words of shape (blocks, 8)."""
    n, blocks = listed.count(), 1
    while blocks * 512 < n * BITS_PER_URL and blocks < max_blocks:
        blocks *= 2
    h = F.xxhash64("url")
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.expr(f"bit_or(shiftleft(1L, int(shiftright((low * {s}L) & 4294967295L, 26))))").alias(f"w{i}") for i, s in enumerate(SALTS)]
    parts = listed.select(F.shiftrightunsigned(h, 32).alias("high"), (low % (1 << 31)).alias("low"))
    got = parts.groupBy((F.col("high") % blocks).alias("block")).agg(*bits).toArrow()
    words = np.zeros((blocks, 8), np.uint64)
    for i in range(8):
        words[got["block"].to_numpy(), i] = got[f"w{i}"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def maybe_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    u = hashes.astype(np.int64).view(np.uint64)
    block, low = (u >> np.uint64(32)) % np.uint64(len(words)), u & np.uint64(0x7FFFFFFF)
    ok = np.ones(len(u), bool)
    for i, s in enumerate(SALTS):
        bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        ok &= (words[block, i] >> bit) & np.uint64(1) == 1
    return ok


def filtered(rows: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """_row (all columns of rows), _host, _path, _rule and _verdict; listed has canonical URLs in its column url, repeats allowed."""
    listed = stored(listed.where("url IS NOT NULL").select("url").distinct(), "listed-urls")
    shared = rows.sparkSession.sparkContext.broadcast(bloom(listed))
    probe = F.pandas_udf(lambda h: pd.Series(maybe_in(shared.value, h.to_numpy())), "boolean")
    u = F.col(f"`{url}`")
    got = rows.select(whole(rows).alias("_row"), host_of(u).alias("_host"), path_of(u).alias("_path"), canonical(u).alias("_canonical"))
    got = got.withColumn("_fit", fitting(F.col("_host"), F.col("_path"), rules))
    got = got.withColumn("_maybe", probe(F.xxhash64(F.coalesce("_canonical", F.lit("")))) & F.col("_fit").isNull() & F.col("_canonical").isNotNull())
    sure = got.where("NOT _maybe").withColumn("_listed", F.lit(False))
    hits = got.where("_maybe").join(listed.select(F.col("url").alias("_canonical"), F.lit(True).alias("_hit")), "_canonical", "left")
    hits = hits.withColumn("_listed", F.coalesce("_hit", F.lit(False))).select(*sure.columns)
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return sure.unionByName(hits).select("_row", "_host", "_path", F.col("_fit.rule").alias("_rule"), verdict.alias("_verdict"))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The list that op3 takes: canonical URLs that two or more pages have, which a crawl should not fetch again."""
    return pages.select(canonical(F.col("url")).alias("url")).where("url IS NOT NULL").groupBy("url").count().where("count > 1").select("url")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filtered(pages, repeated_urls(pages))
    return out.select("_row.page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS args FROM pages),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') <> '' THEN
  regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/$', '') || CASE WHEN args <> '' THEN '?' || args ELSE '' END END AS canon FROM p),
n AS (SELECT *, canon IS NOT NULL AND count(*) OVER (PARTITION BY canon) > 1 AS listed,
  list_filter([{'rule': 'com/en/', 'verdict': 'block', 'h': 'com', 'p': '/en/'}, {'rule': 'example.com/en/7', 'verdict': 'allow', 'h': 'example.com', 'p': '/en/7'},
  {'rule': 'net/de/', 'verdict': 'allow', 'h': 'net', 'p': '/de/'}, {'rule': 'example.net/de/8', 'verdict': 'block', 'h': 'example.net', 'p': '/de/8'},
  {'rule': 'org/es/', 'verdict': 'block', 'h': 'org', 'p': '/es/'}], lambda x: (host = x.h OR ends_with(host, '.' || x.h)) AND starts_with(path, x.p)) AS fits FROM c)
SELECT page_id, host, path, CASE WHEN len(fits) > 0 THEN list_sort(list_transform(fits, lambda x: {'n': -length(x.rule), 'r': x.rule, 'v': x.verdict}))[1].r END AS rule,
  CASE WHEN len(fits) > 0 THEN list_sort(list_transform(fits, lambda x: {'n': -length(x.rule), 'r': x.rule, 'v': x.verdict}))[1].v WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM n
"""
