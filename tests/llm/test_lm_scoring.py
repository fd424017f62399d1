import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from larder.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"
WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in docs}, {r["doc_id"]: r for r in lm.op2_lm_scoring(spark, SF).collect()}


def test_base_scores_are_exact(result):
    docs, got = result
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*WORDS.findall(t.translate(lower)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(docs)
    for d, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens[d]), sum(w in c for w in tokens[d]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[d]), rel_tol=1e-9)
        assert r.score < 0


def test_the_model_beats_a_uniform_one_on_held_out_texts(result):
    docs, got = result
    vocabulary = lm.Words(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    held = [r for r in got.values() if r.held_out]
    n = sum(len(vocabulary.ids(docs[r.doc_id].lower().encode().split())) // 2 + 1 for r in held)
    assert sum(r.score for r in held) > -n * math.log10(50257) * 0.6


def made(end=60, seed=2):
    m = lm.Attention(end, seed)
    rng = np.random.default_rng(seed)
    for k in ("rel", "b", "bh"):
        m.p[k] = rng.standard_normal(m.p[k].shape).astype(np.float32)
    return m


def plain_score(m, ids):
    """One id after the other, from the definition."""
    p, dist = m.p, lm.softmax(m.p["z"].astype(np.float64))
    seq, total = [*ids, m.end], 0.0
    xs = [m.end + 1, *ids]
    for t, y in enumerate(seq):
        lo = t // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE)
        ctx = list(range(max(0, lo), t + 1))
        e = p["emb"][[xs[j] for j in ctx]]
        s = (p["emb"][xs[t]] @ p["q"]) @ (e @ p["k"]).T * lm.SIZE**-0.5 + p["rel"][[t - j for j in ctx]]
        o = lm.softmax(s) @ (e @ p["v"])
        h = o @ p["o"] + p["emb"][xs[t]] @ p["r"] + p["bh"]
        h = h / (1 + np.abs(h))
        mix = lm.softmax(h @ p["u"] + p["b"]) @ dist
        assert math.isclose(mix.sum(), 1, rel_tol=1e-5)
        total += math.log10(mix[y])
    return total


def test_windows_score_each_id_once_whatever_the_batch(monkeypatch):
    m, rng = made(), np.random.default_rng(1)
    texts = [rng.integers(0, 60, n).astype(np.uint16) for n in (0, 1, 23, 24, 25, 100, 400)]
    got = lm.log_probabilities(m.tables(), [t.tobytes() for t in texts])
    for t, s in zip(texts, got, strict=True):
        assert math.isclose(s, plain_score(m, t.astype(int).tolist()), rel_tol=1e-4)
    long = rng.integers(0, 60, 3000).astype(np.uint16).tobytes()
    whole = np.zeros(1)
    for x, y in lm.pieces(long, 60, most=240):
        g, y = m.tables().weighted(x, y)
        whole += (np.log10(g.sum(-1)) * (y >= 0)).sum()
    assert math.isclose(whole[0], lm.log_probabilities(m.tables(), [long])[0], rel_tol=1e-4)


def test_gradients():
    m = made(40)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 41, (3, lm.WINDOW)), rng.integers(0, 41, (3, lm.WINDOW))
    x[0, :5] = y[0, :5] = x[1, 20:] = y[1, 20:] = -1
    _, g, emb, _ = m.loss(x, y)
    g["emb"] = np.zeros_like(m.p["emb"])
    g["emb"][emb[0]] = emb[1]
    for k, v in m.p.items():
        i = (int(x[2, 3]), 1) if k == "emb" else tuple(int(rng.integers(0, s)) for s in v.shape)
        v[i] += 1e-5
        up = m.loss(x, y)[0]
        v[i] -= 2e-5
        down = m.loss(x, y)[0]
        v[i] += 1e-5
        assert math.isclose((up - down) / 2e-5, float(g[k][i]), rel_tol=1e-3, abs_tol=1e-8)


def test_every_training_id_moves_its_embedding(spark):
    end, rng = 300, np.random.default_rng(4)
    long = np.concatenate([rng.permutation(end) for _ in range(3)]).astype(np.uint16)
    texts = spark.createDataFrame([(0, 901, bytearray(long.tobytes())), (1, 51, bytearray(long[:50].tobytes()))], "key long, n_ids long, ids binary")
    moved = (lm.trained(texts, end).p["emb"] != lm.Attention(end).p["emb"]).any(1)
    assert moved[:end].all()


def test_empty_and_odd_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(None, None, False), (1, "", True), (1, "", True), (2, "A a\ta", False)], "_id long, text string, held_out boolean")
    got = lm.scored(df, path).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 4] and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert lm.scored(df.where("false"), path).count() == 0
    none = lm.scored(df.withColumn("held_out", df["_id"].isNull() | True), path).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)


def test_scores_do_not_depend_on_how_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 5000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).selectExpr("doc_id AS _id", "text", "doc_id % 7 = 2 AS held_out").collect()
    docs.append(docs[0])
    got = []
    for n, rows in ((1, docs), (7, docs[::-1]), (23, docs)):
        df = spark.createDataFrame(rows, "_id long, text string, held_out boolean").repartition(n)
        got.append(sorted((r.doc_id, r.score, r.base_score) for r in lm.scored(df, path).collect()))
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-6) and math.isclose(a[2], b[2], rel_tol=1e-9)


def test_the_model_beats_a_unigram_of_subwords_on_held_out_texts(spark):
    sf, path = "/root/testdata/sf0.01", public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = lm.op2_lm_scoring(spark, sf).collect()
    vocabulary = lm.Words(path)
    ids = {d: np.append(np.frombuffer(vocabulary.ids(lm.split(t)), np.uint16), 50256).astype(int) for d, t in docs.items()}
    counts = np.bincount(np.concatenate([ids[r.doc_id] for r in got if not r.held_out]), minlength=50257)
    unigram = np.log10((counts + 0.5) / (counts + 0.5).sum())
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(unigram[ids[r.doc_id]].sum() for r in held)


def test_shuffled_ids_go_when_a_round_has_ended(spark, monkeypatch):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv
    rng, left, descended = np.random.default_rng(6), [], lm.descended
    rows = [(i, 401, bytearray(rng.integers(0, 300, 400).astype(np.uint16).tobytes())) for i in range(200)]
    texts = spark.createDataFrame(rows, "key long, n_ids long, ids binary")

    def names():
        files = env.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}

    def watched(*args):
        time.sleep(2)  # files go in the background
        left.append(len(names() - before))
        return descended(*args)

    monkeypatch.setattr(lm, "SHARD", 5000)
    monkeypatch.setattr(lm, "descended", watched)
    before = names()
    model = lm.trained(texts, 300)
    assert model.dist is not None and len(left) == lm.ROUNDS
    assert max(left[2:]) <= left[1], left  # one round's at most, not those of all


def test_words_of_many_texts_are_encoded_in_few_calls(monkeypatch):
    path, calls = public_tokenizers.path("byte_bpe_50k.tiktoken"), []
    real = lm.encoder(path)

    class Counted:
        n_vocab = real.n_vocab
        decode_single_token_bytes = real.decode_single_token_bytes

        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

        def encode_to_numpy(self, text, **more):
            calls.append(text)
            return real.encode_to_numpy(text, **more)

    monkeypatch.setattr(lm, "encoder", lambda path: Counted())
    odd = "it's 's 123   a b c  x\u0085 　　 ​ d\x1ce Éa ,,, \U0001f600"
    texts = pa.array(["", " ", "A\x0bB  c\n", odd, " ".join(f"w{i} é{i}" for i in range(3000)), None])
    n, words = lm.words_in(texts)
    assert n.tolist() == [len(lm.split(t)) for t in texts.to_pylist()]
    words = words.cast(pa.binary()).to_pylist()
    assert words == [w for t in texts.to_pylist() for w in lm.split(t)]
    ids, sizes = lm.Words(path).encoded(words)
    plain = [real.encode_ordinary(" " + w.decode()) for w in words]
    assert ids.tolist() == [k for one in plain for k in one] and sizes.tolist() == [len(one) for one in plain]
    assert len(calls) < 20


def test_rare_words_meet_their_counts_without_a_sort(spark):
    texts = spark.createDataFrame([(1, 2, 0.0, 0, [bytearray(b"a"), bytearray(b"b")], [2, 1])], "rid long, n_words long, logs double, known long, words array<binary>, counts array<int>")
    counts = spark.createDataFrame([(bytearray(b"a"), 9)], "word binary, c long")
    got = lm.base_scores(texts, counts, 10, 5, 1)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().toString()
    assert math.isclose(got.first().base_score, 2 + math.log10(2) - 3 * math.log10(16))
