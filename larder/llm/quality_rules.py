"""Quality rules whose cut-offs follow the corpus: mergeable quantile sketches for each language and source.

Every document gets four rates. Their distributions are kept as log-linear histograms of integers: the bucket of
a value is its top seven binary digits, so a bucket is at most 1/64 wide relative to its value. Histograms of two sets of
rows merge by adding counts, in any order, which makes them a mergeable sketch with a fixed relative error, and
unlike a random sketch they give the same cut-offs when a lost task is run again. A hot source costs no more than
others: partial counts meet, at most about 800 buckets for each rate, language and source.

A cut-off is an upper quartile plus a multiple of the spread between quartiles plus a slack. Groups with few documents take
their language's cut-offs, and languages with few documents the corpus's; below that, only the fixed rules judge.

Defined cases: a null text has no words and fails the fixed rules; null languages and sources are groups of
their own; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import same, sized, stored, table, whole

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 100
SPREAD = 3
#: Of each rate: what it may exceed the quartile by, even where all documents are alike. Rates are per 10,000, word length in 1/1,000.
SLACK = {"word_length": 3000, "symbols": 500, "dup_lines": 3000, "repeats": 3000}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def counts(text: Column) -> Column:
    """A struct of COUNTS. Repeats are found by sorting a text's three-word windows, so the time is n log n in its words.

    Windows are compared by 64-bit hashes: a text of a million words meets a false repeat with probability below 1e-7.
    """
    text = F.coalesce(text, F.lit(""))

    def repeated(words: Column) -> Column:
        windows = F.filter(
            F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))),
            lambda x: x["i"] < F.size(words) - 2,
        )

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(F.sort_array(windows), places), covered)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    return F.struct(
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def flat(got: DataFrame) -> DataFrame:
    c = F.col("_c")
    return got.select(
        *[x for x in got.columns if x != "_c"],
        c["w"]["n_words"].alias("_n_words"), c["w"]["word_chars"].alias("_word_chars"), c["n_symbols"].alias("_n_symbols"),
        c["l"]["dup"].alias("_n_dup_lines"), c["w"]["n_repeat_words"].alias("_n_repeat_words"), c["l"]["all"].alias("_n_lines"),
    )


def measured(docs: DataFrame, keep: list[Column], store: bool = True) -> DataFrame:
    """keep, _lang, _source and COUNTS of every row, written once if they are to be read twice."""
    got = docs.select(*keep, F.col("lang").alias("_lang"), F.col("source").alias("_source"), counts(F.col("text")).alias("_c"))
    return flat(stored(got, "quality-rules") if store else got)


def rates() -> dict[str, Column]:
    per = lambda a, b, scale: F.expr(f"CAST({a} * {scale} AS BIGINT) DIV greatest({b}, 1)")
    return {
        "word_length": per("_word_chars", "_n_words", 1000),
        "symbols": per("_n_symbols", "_word_chars", 10000),
        "dup_lines": per("_n_dup_lines", "_n_lines", 10000),
        "repeats": per("_n_repeat_words", "_n_words", 10000),
    }


def bucket(v: Column) -> Column:
    """v without its binary digits after the seventh."""
    places = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, places), places)


def sketches(m: DataFrame) -> DataFrame:
    """Counts by language, source, rate and bucket, and the same merged by language and overall (level 2, 1, 0)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("b")) for k, v in rates().items()]))
    base = m.where("_n_words > 0").select("_lang", "_source", pairs.alias("p")).groupBy("_lang", "_source", "p").agg(F.count("*").alias("n"))
    base = base.select(F.lit(2).alias("level"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "p.rate", "p.b", "n")
    no = F.lit(None).cast("string")
    by_lang = base.groupBy("lang", "rate", "b").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", no.alias("source"), "rate", "b", "n")
    overall = base.groupBy("rate", "b").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), no.alias("lang"), no.alias("source"), "rate", "b", "n")
    return base.unionByName(by_lang).unionByName(overall)


def fences(sketch: DataFrame, min_group: int, spread: int) -> DataFrame:
    """For each level, language and source: the cut-offs of every rate as a struct; none where documents are few."""
    keys = ["level", "lang", "source", "rate"]
    buckets = sketch.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h"), F.sum("n").alias("total"))

    def quartile(k: int) -> Column:
        step = lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.when(a["q"].isNull() & ((a["seen"] + x["n"]) * 4 >= F.col("total") * k), x["b"]).otherwise(a["q"]).alias("q"),
        )
        return F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("q")), step)["q"]

    q = buckets.where(F.col("total") >= min_group).select(*keys, quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.create_map(*[x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))])[F.col("rate")]
    reach = (F.col("q3") - F.col("q1")) * spread + slack
    q = q.select(*keys, (F.col("q3") + reach).alias("hi"), (F.col("q1") - reach).alias("lo"))
    at = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{c}_{k}")
    return q.groupBy("level", "lang", "source").agg(*[at(k, "hi") for k in SLACK], at("word_length", "lo"))


def judged(m: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD, rows: DataFrame | None = None) -> DataFrame:
    """measured() rows (m itself, or others) with _base_failed and _kept by the cut-offs of m."""
    all_fences = stored(fences(sketches(m), min_group, spread), "fences")
    cuts = [c for c in all_fences.columns if c[:3] in ("hi_", "lo_")]
    of = lambda level, *keys: all_fences.where(F.col("level") == level).select(*[F.col(k).alias(f"_k{level}_{k}") for k in keys], F.struct(*cuts).alias(f"_f{level}"))
    own, lang, overall = of(2, "lang", "source"), of(1, "lang"), of(0)
    m = m if rows is None else rows
    out = m.join(sized(own), m["_lang"].eqNullSafe(own["_k2_lang"]) & m["_source"].eqNullSafe(own["_k2_source"]), "left")
    out = out.join(sized(lang), out["_lang"].eqNullSafe(lang["_k1_lang"]), "left")
    first = overall.first()
    out = out.withColumn("_f0", F.lit(None).cast(overall.schema["_f0"].dataType) if first is None else F.struct(*[F.lit(first["_f0"][c]).cast("long").alias(c) for c in cuts]))
    f = F.coalesce("_f2", "_f1", "_f0")
    odd = F.lit(False)
    for k, v in rates().items():
        odd = odd | F.coalesce(v > f[f"hi_{k}"], F.lit(False))
    odd = odd | F.coalesce(rates()["word_length"] < f["lo_word_length"], F.lit(False))
    failed = (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 50)
    return out.withColumn("_base_failed", failed).withColumn("_kept", ~failed & ~odd).select(*m.columns, "_base_failed", "_kept")


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """The rows of docs that pass, with their own columns; docs needs text, lang and source.

    Counts are written without the texts for the cut-offs and worked out again for the filter, which takes time but no second copy on disk.
    """
    rows = measured(docs, [whole(docs).alias("_row")], store=False)
    return judged(measured(docs, []), min_group, spread, rows).where("_kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(measured(table(spark, sf_dir, "documents"), [F.col("doc_id")]))
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS if c != "n_lines"], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_rep FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_rep, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM d JOIN words USING (r) JOIN lines USING (r) LEFT JOIN rep USING (r)),
rate AS (SELECT r, lang, source, n_words, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS rate,
  unnest([word_chars * 1000 // greatest(n_words, 1), n_symbols * 10000 // greatest(word_chars, 1), n_dup_lines * 10000 // greatest(n_lines, 1),
  n_repeat_words * 10000 // greatest(n_words, 1)]) AS v FROM m),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)::INT) << greatest(length(bin(v)) - 7, 0)::INT AS b FROM rate WHERE n_words > 0),
h AS (SELECT 2 AS level, lang, source, rate, b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, rate, b, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, rate, b, count(*) FROM b GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS seen, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM h),
q AS (SELECT level, lang, source, rate, min(b) FILTER (seen * 4 >= total) AS q1, min(b) FILTER (seen * 4 >= total * 3) AS q3 FROM cum WHERE total >= 100 GROUP BY ALL),
f AS (SELECT level, lang, source, rate, q3 + (q3 - q1) * 3 + s AS hi, CASE WHEN rate = 'word_length' THEN q1 - (q3 - q1) * 3 - s END AS lo
  FROM q JOIN (VALUES ('word_length', 3000), ('symbols', 500), ('dup_lines', 3000), ('repeats', 3000)) AS k(rate, s) USING (rate)),
odd AS (SELECT rate.r, bool_or(coalesce(v > coalesce(f2.hi, f1.hi, f0.hi), false) OR coalesce(v < coalesce(f2.lo, f1.lo, f0.lo), false)) AS odd FROM rate
  LEFT JOIN f f2 ON f2.level = 2 AND f2.rate = rate.rate AND f2.lang IS NOT DISTINCT FROM rate.lang AND f2.source IS NOT DISTINCT FROM rate.source
  LEFT JOIN f f1 ON f1.level = 1 AND f1.rate = rate.rate AND f1.lang IS NOT DISTINCT FROM rate.lang
  LEFT JOIN f f0 ON f0.level = 0 AND f0.rate = rate.rate GROUP BY rate.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT odd AS kept
FROM m JOIN odd USING (r)
"""
