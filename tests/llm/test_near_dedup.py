import hashlib
import random

import numpy as np

from larder.llm import near_dedup as nd
from larder.llm.textnum import SHINGLE, labelled, matched, shingles, word_hashes


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def lcs(a, b, band=10**9):
    got = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            got[i + 1, j + 1] = max(got[i, j + 1], got[i + 1, j], got[i, j] + 1 if a[i] == b[j] and abs(i - j) <= band else 0)
    return int(got[-1, -1])


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = words(rng, 1)[0]
    return ws


def brute(texts):
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if a.split() == texts[j].split() and (a.split() or a == texts[j]) or a.split() and texts[j].split() and nd.similar(a, texts[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    texts = []
    passage = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.randrange(60, 300))
        texts += [" ".join(base)] * rng.randrange(1, 4)
        texts += [" ".join(edited(rng, base, rng.randrange(1, 1 + len(base) // 55))) for _ in range(rng.randrange(0, 8))]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(25)]  # share a passage only
    hub = words(rng, 400)  # copies are near the hub, though hardly near each other
    texts += [" ".join(hub)] + [" ".join(edited(rng, hub, 8)) for _ in range(30)]
    texts += ["", "", None, "one two", "one two", "one  two", "a b c"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r._class for r in nd.near_classes(df).collect()}
    expected = brute([t or "" for t in texts])
    # texts of under five words: equal word sequences only
    assert got == dict(enumerate(expected))


def test_kept_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "q r s t u", "z"), (None, "q r s t u", "z"), (5, None, "n"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string")
    out = nd.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id, r._node) for r in out.collect()) == [(False, 1, "x"), (False, 4, "n"), (True, None, "z")]
    assert nd.deduplicated(df.where("false")).count() == 0


def test_alignment_is_a_longest_common_subsequence_in_the_band():
    rng = np.random.default_rng(3)
    for _ in range(400):
        kinds = int(rng.integers(1, 6))
        a, b = (rng.integers(0, kinds, rng.integers(0, 16)) for _ in range(2))
        full, band = lcs(a, b), int(rng.integers(0, 20))
        got = matched(a, b, band)
        assert lcs(a, b, band) <= got <= full  # ends that agree are matched before the band is laid
        if len(a) + len(b) - 2 * full <= band:
            assert got == full
    a = rng.integers(0, 3, 700)  # words that come more often than are kept as lists
    b = np.delete(a, rng.integers(0, 700, 40))
    assert matched(a, b, 80) == len(b) == matched(b, a, 80)


def test_links_are_those_of_word_alignments():
    rng = random.Random(2)
    for n, edits in ((60, 2), (100, 3), (100, 5), (300, 12), (80, 12)):
        a = words(rng, n)
        b = edited(rng, a, edits)
        m = lcs(a, b)
        assert nd.similar(" ".join(a), " ".join(b)) == (m >= 0.8 * (len(a) + len(b) - m))
    base = words(rng, 60) * 16  # the distinct windows of such texts differ much
    assert nd.similar(" ".join(base), " ".join(base + words(rng, 60)))


def test_moved_passages_and_repeats():
    rng = random.Random(1)
    a, b = words(rng, 200), words(rng, 200)
    assert nd.similar(" ".join(a + b), " ".join(b + a))
    assert not nd.similar(" ".join(a), " ".join(a[:100] + words(rng, 100)))
    assert nd.similar("x y " * 200, "x y " * 190) and not nd.similar("x y", "x z") and nd.similar("x\ny", "x y")


def test_hashes_do_not_depend_on_white_space_or_length():
    long = "w" * 9000
    assert (word_hashes(f" a\tb {long}\n") == word_hashes(f"a b {long}")).all() and len(set(word_hashes("a aa aaa b ab ba").tolist())) == 6
    assert len(shingles(word_hashes("a b c d e f"))) == 2 and len(shingles(word_hashes("a b"))) == 1 and not len(shingles(word_hashes(" ")))
    s = np.array([5, 7, 5, 5], np.uint64)
    assert len(set(labelled(s).tolist())) == 4 and labelled(s)[0] == 5 and SHINGLE == 5


def test_pairs_in_a_crowd_around_one_template(spark):
    rng = random.Random(8)
    template = words(rng, 300)
    own = [words(rng, 45) for _ in range(60)]
    texts = [" ".join(template + w) for w in own]  # 0.75 to each other
    texts += [" ".join(template + edited(rng, w, 6)) for w in own[:30]]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r._class for r in nd.near_classes(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_a_member_that_joined_its_leader_still_meets_the_others(spark, monkeypatch):
    rng, crowded = random.Random(10), lambda text: (list(range(1, 21)), len(text.split()) - 4)
    top = [""]
    while sha(top[0]) != max(map(sha, top)) or len(top) == 1:  # the first leads: among equally central ones the largest hash
        base, b1, b2 = words(rng, 300), words(rng, 25), words(rng, 25)
        top = [" ".join(base), " ".join(b1 + base[25:]), " ".join(b1 + base[25:-25] + b2), " ".join(words(rng, 300))]
    assert nd.similar(top[0], top[1]) and nd.similar(top[1], top[2]) and not nd.similar(top[0], top[2])
    monkeypatch.setattr(nd, "order_minhash", crowded)
    df = spark.createDataFrame(list(enumerate(top)), "doc_id long, text string")
    assert {r._id: r._class for r in nd.near_classes(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_candidates_hold_every_pair_with_similar_windows(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(10):
        base = words(rng, 40) * rng.randrange(1, 4)
        texts += [" ".join(edited(rng, base, k)) for k in range(6)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    texts = sorted(set(texts))
    df = spark.createDataFrame([(bytes([i]), bytes([i]), 1, t) for i, t in enumerate(texts)], "node binary, label binary, held long, text string")
    got = {(r.a[0], r.b[0]) for r in nd.candidates(df, 0.8).collect()}

    def windows_alike(a, b):
        sa, sb = (labelled(shingles(word_hashes(x))) for x in (a, b))
        met = len(np.intersect1d(sa, sb))
        return met >= 0.8 * (len(sa) + len(sb) - met)

    assert {(i, j) for j in range(len(texts)) for i in range(j) if windows_alike(texts[i], texts[j])} <= got


def test_a_large_crowd_with_edited_copies(spark):
    rng = random.Random(12)
    template = words(rng, 150)
    own = [words(rng, 60) for _ in range(500)]  # 0.55 to each other
    texts = [" ".join(template + w) for w in own]
    planted = {}
    for k in range(0, 100, 2):
        planted[len(texts)] = k
        texts.append(" ".join(edited(rng, template + own[k], 16)))  # 0.86 or more
    repeating = words(rng, 60) * 16
    planted[len(texts) + 1] = len(texts)
    texts += [" ".join(repeating), " ".join(repeating + words(rng, 60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r._class for r in nd.near_classes(df).collect()}
    assert sum(got[i] == got[j] for i, j in planted.items()) >= 0.99 * len(planted)
    assert len(set(got.values())) == len(texts) - len(planted)


def test_very_long_texts_and_odd_columns(spark):
    rng = random.Random(13)
    long = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(120_000)]
    rows = [(1, " ".join(long), 1), (2, " ".join(edited(rng, long, 900)), 2), (3, "w" * 500_000, 3), (4, " ".join(long[:60_000]), 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label long")
    assert {r._id: r._class for r in nd.near_classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted((r.doc_id, r.label) for r in nd.deduplicated(df).collect()) == [(1, 1), (3, 3), (4, 4)]


def test_crowd_members_whose_shared_windows_are_all_common(spark, monkeypatch):
    rng = random.Random(14)
    template, texts, planted = words(rng, 240), [], {}

    def replaced(places):
        return " ".join(words(rng, 1)[0] if i in places else w for i, w in enumerate(template))

    for k in range(120):
        places = set(rng.sample(range(240), 19))
        texts.append(replaced(places))
        if k % 12 == 0:  # 0.85 in words; every window that both have is one of the template's, which most have
            planted[len(texts)] = len(texts) - 1
            texts.append(replaced(places))
    expected = brute(texts)
    assert all(expected[i] == expected[j] for i, j in planted.items()) and len(set(expected)) > 100
    monkeypatch.setattr(nd, "order_minhash", lambda text: ([1], len(text.split())))  # one large bucket
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r._id: r._class for r in nd.near_classes(df).collect()} == dict(enumerate(expected))


def test_candidates_hold_every_linked_pair(spark, monkeypatch):
    rng = random.Random(15)
    texts = []
    for _ in range(6):
        base = words(rng, 6) * rng.randrange(2, 6) + words(rng, 8)
        texts += [" ".join(edited(rng, base, k)) for k in range(6)]
        texts += [" ".join(base[k:] + base[:k]) for k in (5, 9)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 14))) for _ in range(60)]
    texts = sorted(set(texts))
    df = spark.createDataFrame([(bytes([i]), bytes([i]), 1, t) for i, t in enumerate(texts)], "node binary, label binary, held long, text string")
    for many, least in ((64, 0.8), (3, 0.8), (3, 0.6)):
        monkeypatch.setattr(nd, "MANY", many)
        got = {(r.a[0], r.b[0]) for r in nd.candidates(df, least).collect()}
        assert {(i, j) for j in range(len(texts)) for i in range(j) if nd.similar(texts[i], texts[j], least)} <= got


def test_a_crowd_makes_no_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(16)
    template, others = words(rng, 120), words(rng, 3000)
    texts = [" ".join(template + rng.sample(others, 60)) for _ in range(300)]  # 0.5 to each other, and most share a rare word
    texts += [" ".join(edited(rng, t.split(), 12)) for t in texts[:60:3]]
    made, stored, counted = {}, nd.stored, nd.counted

    def storing(df, label):
        out = stored(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    def counting(df, label, what=None):
        out, n = counted(df, label, what)
        made[label] = max(made.get(label, 0), n)
        return out, n

    monkeypatch.setattr(nd, "order_minhash", lambda text: ([1], len(text.split())))  # one large bucket
    monkeypatch.setattr(nd, "stored", storing)
    monkeypatch.setattr(nd, "counted", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r._id: r._class for r in nd.near_classes(df).collect()} == dict(enumerate(brute(texts)))
    assert max(made.values()) <= len(texts), made
