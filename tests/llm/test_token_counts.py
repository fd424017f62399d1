import random

import public_tokenizers
import pytest

from larder.llm.token_counts import HUGE, Counter, op1_token_counts, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["the", "Ünïted", "123456", "it's", "''s", "áb", "<|endoftext|>", "x<|startoftext|>y", "日本語。漢字", " ", "\x1c", "…", "###", "don't", "\n\n", "\t", "  ", "é", "́", "ΑΣ", "가나다", "🙂🙂", "--", "\x85"]


def made(rng, n):
    return "".join(rng.choice(PIECES) + rng.choice(["", " ", "", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def whole():
    c = Counter(PATH)
    return lambda t: c.whole([t])[0]


def test_segments_and_chunks_count_as_the_library_does(whole):
    rng = random.Random(5)
    small, huge = Counter(PATH), Counter(PATH, huge=50, chunk=64, overlap=8)
    for _ in range(150):
        t = made(rng, rng.randrange(0, 120))
        assert small.count([t]) == [whole(t)], t
        assert huge.count([t]) == [whole(t)], t
    assert huge.widened > 0


def test_without_a_stable_place_the_chunk_grows(whole):
    c = Counter(PATH, huge=50, chunk=64, overlap=8)
    for t in ("ab" * 3000, "é" * 500, "!" * 700 + "́", "a" * 63 + " " + "b" * 500):
        assert c.count([t]) == [whole(t)]


def test_other_vocabularies_encode_whole_texts():
    assert Counter(public_tokenizers.path("piece_bpe_32k.model")).count(["hello world", ""])[1] == 0


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "n_tokens int, text string")
    got = {r["n_tokens"]: r["t"] for r in df.select("n_tokens", token_counts(df["text"], PATH, 1).alias("t")).collect()}
    assert got[1][:2] == (0, 0) and got[2][:2] == (0, 0) and got[3] == (7, 2, True)


def test_the_query_counts_as_the_library_does(spark, whole):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op1_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        n = whole(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_huge_texts_of_the_tables_are_spliced(spark, whole):
    long = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(f"char_length(text) > {HUGE}").limit(20).collect()]
    c = Counter(PATH)
    assert c.count(long) == [whole(t) for t in long]
    assert c.splices >= len(long)
    rows = [(1, long[0]), (1, long[0]), (2, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted(r.t.n_tokens for r in df.select(token_counts(df["text"], PATH).alias("t")).collect()) == sorted(whole(t) for _, t in rows)
    assert df.where("false").select(token_counts(df["text"], PATH)).count() == 0
