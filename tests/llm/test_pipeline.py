import random

import corpus_pipeline
from larder.llm import decontamination, near_dedup, packing, secret_scans
from tests.llm.test_near_dedup import brute, edited, words
from tests.llm.test_operators import counted


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(12)
    items = [" ".join(words(rng, 30)) for _ in range(3)]
    rows = []
    for i in range(60):
        ws = words(rng, rng.randrange(60, 200))
        if i % 9 == 0:
            ws[20:20] = items[i % 3].split()
        if i % 7 == 0:
            ws[10:10] = ["password:", "hunter22x"]
        rows.append((i, " ".join(ws), "en", f"s{i % 3}"))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(edited(rng, ws, 1)), "en", "s0"))
        if i % 11 == 0:
            rows.append((200 + i, " ".join(ws), "de", None))
    rows += [(300, "too short", "en", "s0"), (301, None, None, None), (302, "same " * 90, "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    # groups are under 100 documents, so only the fixed rules and the corpus's cut-offs judge; none of these texts is odd
    good = {d: t for d, t, *_ in rows if t and counted(t)[0] >= 50 and 100 * counted(t)[4] <= 50 * counted(t)[0]}
    assert seen[0] == good
    ids = sorted(good)
    first = {}
    for d, c in zip(ids, brute([good[d] for d in ids]), strict=True):
        first.setdefault(c, d)
    assert seen[1] == {d: good[d] for d in first.values()}
    plain = [decontamination.plain(t)[:100] for t in items]
    clean = {d: t for d, t in seen[1].items() if not any(p in decontamination.plain(t) for p in plain)}
    assert seen[2] == clean and len(clean) < len(seen[1])
    assert seen[3] == {d: t.replace("password: hunter22x", f"password: {secret_scans.MARK}") for d, t in clean.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(clean) and sum(r.length for r in out) == sum(len(t.split()) + 1 for t in seen[3].values())
    assert all(r.capacity in packing.CAPACITIES for r in out)


def test_near_duplicates_of_a_crowd(spark, monkeypatch):
    rng, most, stored = random.Random(17), [0], near_dedup.stored
    template, others = words(rng, 120), words(rng, 2000)
    texts = [" ".join(template + rng.sample(others, 60)) for _ in range(200)]  # most share a rare word
    texts += [" ".join(edited(rng, t.split(), 12)) for t in texts[:40:4]]

    def storing(df, label):
        out = stored(df, label)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(near_dedup, "order_minhash", lambda text: ([1], len(text.split())))  # one large bucket
    monkeypatch.setattr(near_dedup, "stored", storing)
    df = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(texts)))
    assert most[0] <= len(texts)  # no table has a row for each pair
