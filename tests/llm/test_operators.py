import base64
import hashlib
import json
import random
import re
import time

import pytest

from larder.llm import decontamination as dc
from larder.llm import html_extraction as he
from larder.llm import packing as pk
from larder.llm import quality_classifier as qc
from larder.llm import quality_rules as qr
from larder.llm import secret_scans as ss
from larder.llm import url_filters as uf

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


# -- quality rules


def counted(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    rep = {i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", "c\n", " ", "\t#", "é\x0b", "|\n", "\r", "\xa0"]) for _ in range(rng.randrange(0, 80))) for _ in range(80)] + ["", "a a a a", " \n \n"]
    df = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in qr.judged(qr.measured(df, [df["doc_id"]])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == counted(t), t


def test_adaptive_cut_offs(spark):
    clean = " ".join(f"w{i}x" for i in range(80))
    junk = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, clean, "en", "a") for i in range(120)] + [(1000, junk, "en", "a")]
    rows += [(2000 + i, junk, "en", "b") for i in range(120)]  # a source where symbols are usual
    rows += [(3000, junk, "en", "c"), (3001, clean, None, None), (3002, None, "en", "a")]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in qr.keep_good(df).collect()}
    assert 1000 not in kept and {*range(120)} <= kept and {*range(2000, 2120)} <= kept and 3001 in kept and 3002 not in kept
    extra = df.withColumns({"_lang": df["lang"], "n_words": df["doc_id"], "_row": df["text"]})
    assert qr.keep_good(extra).columns == extra.columns and qr.keep_good(extra.where("false")).count() == 0


# -- secrets


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k)
    return bytes([tag]) + head + body


def rsa_key(rng):
    return der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + rng.randbytes(64)) for _ in range(8)))


def test_secret_structures():
    rng = random.Random(1)
    key = rsa_key(rng)
    b64 = base64.b64encode(key).decode()
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":1}', rng.randbytes(32)))
    part = lambda x: len(x).to_bytes(4) + x
    ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4) + part(rng.randbytes(51)) + part(rng.randbytes(80))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [ss.KINDS[k] for _, k, _ in sorted(ss.confirmed_spans(t))]
    assert kinds(f"x {b64} y") == ["der"] and kinds(f"x {jwt}.") == ["jwt"] and kinds(base64.b64encode(ssh).decode()) == ["openssh"]
    assert kinds(pem) == ["pem"] and kinds(key.hex()) == ["der"] and kinds(base64.b64encode(b64.encode()).decode()) == ["der"]
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86") + der(5, b"")) + der(4, key))
    assert kinds(base64.b64encode(pkcs8).decode()) == ["der"]
    for bad in (key[:-1], key + b"\0", der(0x30, der(2, b"\0") + rng.randbytes(300)), rng.randbytes(400)):
        assert kinds(base64.b64encode(bad).decode()) == []
    assert kinds(jwt[1:]) == [] and kinds("eyJhIjoxfQ.eyJhIjoxfQ." + "a" * 20) == []
    assert ss.redact_text(f"é {b64} token = abcdef. {jwt}") == f"é {ss.MARK} token = {ss.MARK} {ss.MARK}"


def test_wrapped_headered_encrypted_and_url_safe_keys():
    rng = random.Random(8)
    raw = lambda n: bytes(rng.randrange(128, 256) for _ in range(n))
    rsa = der(0x30, der(2, b"\0") + der(2, b"\0" + raw(64)) + b"".join(der(2, b"\1" + raw(30)) for _ in range(7)))
    locked = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, der(4, raw(8)))) + der(4, raw(64)))
    lines = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    b64 = lambda b: base64.b64encode(b).decode()
    kinds = lambda text: [(ss.KINDS[k], text[a:b]) for a, k, b in ss.confirmed_spans(text)]
    url = base64.urlsafe_b64encode(rsa).decode().rstrip("=")
    assert "-" in url or "_" in url
    for s in (lines(b64(rsa), 64), lines(b64(rsa), 76).replace("\n", "\r\n"), lines(rsa.hex(), 64), url, b64(locked), "0x" + rsa.hex()):
        assert kinds(f"see {s}\nthe end") == [("der", s)], s
        assert kinds(f"{s}\n") == [("der", s)]
        assert kinds(f"see {s[:-9]}\nthe end") == []
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    pem = lambda h, b, k="RSA ": f"-----BEGIN {k}PRIVATE KEY-----\n{h}{lines(b64(b), 64)}\n-----END {k}PRIVATE KEY-----"
    for s in (pem(head, raw(160)), pem("Comment: mine\n", rsa), pem("", locked, "ENCRYPTED ")):
        assert kinds(f"a {s} b") == [("pem", s)]
    assert kinds(pem(head, raw(161))) == [] and kinds(pem("", raw(160))) == []
    long = "A" * 400_000 + "\n" + ("ab-_" * 15 + "\n") * 5000
    t = time.perf_counter()
    assert kinds(long) == [] and time.perf_counter() - t < 10


def test_secret_tables_with_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (1, "", 0, "x"), (2, "token: abcdef", 13, "x"), (2, "token: abcdef", 13, "x")], "doc_id long, text string, n_chars long, s string")
    got = ss.redact(df)
    assert got.columns == df.columns and sorted((r.text or "-", r.n_chars) for r in got.where("text IS NOT NULL").collect()) == [("-", 0), *[("token: [SECRET]", 15)] * 2]
    assert ss.redact(df.where("false")).count() == 0 and df.where("false").select(ss.secrets(df["text"]).alias("s")).count() == 0


def test_base_spans_follow_the_patterns():
    rng = random.Random(3)
    bits = ["password", "PassWD", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0a1b2c3d", "deadbeef" * 3, "ſecret", "\n", "é"]
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n_assign, n_access, n_hex, sha, all_ = ss.scan_text(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (n_assign, n_access, n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3)) and sha == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(all_.split(","))


def test_secret_stage(spark):
    df = spark.createDataFrame([(1, None, 0, "k"), (2, "token=abcdef0", 99, "k"), (3, "", 0, "k")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in ss.redact(df).collect()}
    assert got == {1: (None, None, "k"), 2: ("token=[SECRET]", 14, "k"), 3: ("", 0, "k")}


# -- URLs


def test_url_filters(spark):
    urls = ["http://EXAMPLE.com/en/7", "https://a.example.com/en/8?x", "http://x.net/de/1", "http://b.example.net/de/80", "http://o.org/es/", "http://bad.test/p/?utm_x=1&b=2&a=1#f", "https://www.bad.test:443/p?a=1&b=2", "http://bad.test/q", "none", None, "//x/y", "notexample.com://h"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.test/p?a=1&b=2",), ("bad.test/p?a=1&b=2",), (None,)], "url string")
    got = {r._row.page_id: (r._host, r._path, r._rule, r._verdict) for r in uf.filtered(df, listed).collect()}
    assert [got[i][3] for i in range(12)] == ["allow", "block", "allow", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[0][:3] == ("example.com", "/en/7", "example.com/en/7") and got[3][2] == "example.net/de/8" and got[9][:2] == ("", "") and got[5][1] == "/p/"
    assert {r._verdict for r in uf.filtered(df.where("page_id in (5, 7)"), listed.where("false")).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("url"))
    h = df.select(F.xxhash64("url").alias("h")).toPandas()["h"].to_numpy()
    other = spark.range(4000).select(F.xxhash64(F.concat(F.lit("v"), "id")).alias("h")).toPandas()["h"].to_numpy()
    words = uf.bloom(df)
    assert uf.maybe_in(words, h).all() and uf.maybe_in(words, other).mean() < 0.05
    assert uf.maybe_in(uf.bloom(df, max_blocks=2), h).all()


# -- classifier


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in qc.op6_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()
    held = [(rows[r.doc_id].predicted, r.quality, rows[r.doc_id].score) for r in labels if rows[r.doc_id].held_out]
    share = max(sum(q for _, q, _ in held), sum(1 - q for _, q, _ in held)) / len(held)
    assert sum(p == q for p, q, _ in held) / len(held) > max(0.93, share)
    good, bad = ([s for _, q, s in held if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.93
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    stats = df.select("doc_id", qc.statistics(df["text"]).alias("stats"))
    for labels in ([], [(1, None)], [(1, 1)]):
        model = qc.train(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {round(r[0], 3) for r in stats.select(model.score(stats["stats"])).collect()} == {0.667 if labels == [(1, 1)] else 0.5}


def test_compiled_rules_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1000, (600, len(qc.STATS)))
    y = ((x[:, 2] < 300) & (x[:, 5] > 200)).astype(float)
    model = qc.fitted(x, y)
    z = qc.holds(model.rules, x) @ np.array(model.weights) + model.intercept
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{s} long" for s in qc.STATS))
    from pyspark.sql import functions as F

    got = df.select(model.score(F.struct(*qc.STATS)).alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-4) and ((got >= 0.5) == (y == 1)).mean() > 0.97


# -- HTML

ART = "<article><h1>T &amp; U</h1><p>one  two<br>three<p>f<b>o</b>ur &lt;x&gt; &#233;<ul><li>a<li>b</ul><script>var t='</p>';</script><aside>no</aside></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<html><head><title>t</title></head><body><nav><a>menu</a></nav>{ART}<div class='comments'><p>hello " + "word " * 90 + "</p></div><footer>f</footer></body>", "T & U\none two three\nfour <x> é\na\nb"),
        ("<body><div class=cookie-notice><p>we use</p></div><main><p>Text &nbsp; here</p><form><p>mail</p></form><!-- <p>no</p> --></main>", "Text here"),
        ("just text < 5 &amp more", "just text < 5 & more"),
        ("", ""),
        ("<p></p>", ""),
        ("<body><p>a<table><tr><td>1<td>2<tr><td>3</table>b</body>", "a\n1\n2\n3\nb"),
        ("<div id='x'><p>open <a href='q\">never closed</p>", "open never closed"),
    ],
)
def test_main_text(html, text):
    assert (he.main_text(html, he.best_path(html)[0]) or "") == text


BODY = "long text " * 40


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h1>title</h1><p>lead</p><div class='body'><p>{BODY}</p></div></article>", f"title\nlead\n{BODY.strip()}"),
        (f"<body><div class=x><a href=1>home</a> <a href=2>more</a></div><article><h1>t</h1><section><div class=a><div class=b><p>{BODY}</div></div></section><section class=s><p>second</section></article></body>", f"t\n{BODY.strip()}\nsecond"),
        (f"<main><h1>t</h1><div class=body><p>{BODY}<blockquote><p>quoted</blockquote></div><div class=after><p>end</div></main>", f"t\n{BODY.strip()}\nquoted\nend"),
        (f"<body><div class=page><h1>t</h1><div class=body><p>{BODY}</div></div><div class=list><a>{'link ' * 30}</a></div></body>", f"t\n{BODY.strip()}"),
    ],
)
def test_text_around_the_best_container(html, text):
    assert he.main_text(html, he.best_path(html)[0]) == text


def test_deep_and_odd_pages_take_linear_time():
    body = "<p>the text of the page</p>"
    n = 100_000
    pages = ["<div>" * n + body, "<div>" * n + body + "</b>" * n, "<dl>" + "<div>" * n + "<dd>x" * n, "<b>" * n + body, "".join(f"<div class=c{i % 3}>t<a>" for i in range(n)) + body]
    for page in pages:
        t = time.perf_counter()
        path, _ = he.best_path(page)
        assert he.main_text(page, path) is not None
        assert time.perf_counter() - t < 30
    assert he.main_text(pages[0], he.best_path(pages[0])[0]) == "the text of the page"
    assert he.main_text("<article><p>a\u2003\u3000b\u00a0</p></article>", "/article") == "a b"


def test_hosts_vote(spark):
    page = lambda side: f"<body><div class='c1'><p>{'main words ' * 9}</p></div><div class='s'><p>{side}</p></div></body>"
    rows = [(i, "http://h.x/1", page("small"), "z") for i in range(5)] + [(9, "http://H.x/2", page("a very large box " * 30), "z")]
    rows += [(10, "http://h.x/3", "<p>other make</p>", "z"), (11, None, None, "z"), (12, "http://h.x/4", page("small"), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in he.with_main_text(df, ["page_id"]).collect()}
    main = ("main words " * 9).strip()
    assert got[0] == got[9] == got[12] == (main, len(main)) and got[10] == ("other make", 10) and got[11] == ("", 0)
    assert he.with_main_text(df.where("false"), ["page_id"]).count() == 0


# -- decontamination


def semiglobal(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        prev, row[0] = row[0], i + 1
        for j in range(1, len(t) + 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != t[j - 1]))
    return min(row)


def test_windows_within_the_budget_are_found_and_no_others():
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcde fgh") for _ in range(n))
    items = [(i, dc.plain(make(rng.randrange(60, 400)))) for i in range(8)]
    index = dc.Index(items)
    for _ in range(120):
        item, text = rng.choice(items)
        at = rng.randrange(max(1, len(text) - 120))
        piece = list(text[at : at + rng.randrange(60, 200)])
        for _ in range(rng.randrange(0, 16)):
            k = rng.randrange(len(piece))
            piece[k : k + 1] = rng.choice([[], ["z"], [piece[k], "y"]])
        doc = dc.plain(make(150) + "".join(piece) + make(150))
        expected = {w[0] for w, k in zip(index.windows, index.edits, strict=True) if semiglobal(w[1].tolist(), dc.code_points(doc).tolist()) <= k}
        assert {x[0] for x in index.found(doc)} == expected


def test_leaks(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n))
    items = [make(40) for _ in range(5)] + ["too short", None]
    clean = make(300)
    docs = [(1, clean, "x"), (2, make(100) + " " + items[0].upper().replace(" ", ",\n") + " " + make(50), "x"), (3, None, "x"), (4, "", "x"), (5, items[3], "x"), (5, items[3], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _found string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK", 2)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in dc.leaks(df, bench, [dc.F.col("_row.doc_id").alias("doc_id")]).collect())
    assert got == [(2, 0, 0), (5, 3, 0), (5, 3, 0)]
    assert sorted(r.doc_id for r in dc.decontaminated(df, bench).collect()) == [1, 3, 4] and dc.decontaminated(df, bench.where("false")).count() == 6
    monkeypatch.setattr(dc, "PIECE", 200)
    assert [x[:1] for x in dc.Index([(0, items[0])]).found(docs[1][1])] == [(0,)]


def test_short_items_match_word_for_word(spark):
    items = [("a", "Why? Because."), ("b", "yes"), (None, "yes"), ("c", "one two three"), ("d", " .. "), ("e", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["He said: why -- because I can", "yesterday", "Oh, YES!", "one two threes", "x one, two\nthree", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _found string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in dc.leaks(df, bench, [dc.F.col("_row.doc_id").alias("doc_id")]).collect()}
    assert got == {(0, "a", 8, 19), (2, "b", 3, 6), (2, None, 3, 6), (4, "c", 2, 15)}
    assert sorted(r.doc_id for r in dc.decontaminated(df, bench).collect()) == [1, 3, 5, 6]
    assert [x[1:] for x in dc.Index([(1, "yes"), (1, "yes")]).found("yes yes")] == [(0, 7, 0, 1)] * 2


# -- packing


def test_bins_hold_what_fits_and_are_downsized(spark):
    rng = random.Random(9)
    for _ in range(50):
        lengths = [rng.randrange(1, 2049) for _ in range(rng.randrange(0, 200))]
        where, sizes = pk.packed(lengths)
        content = [0] * len(sizes)
        for n, b in zip(lengths, where, strict=True):
            content[b] += n
        assert all(c <= s and s == min(x for x in pk.CAPACITIES if x >= c) for c, s in zip(content, sizes, strict=True))
    small = [rng.randrange(20, 400) for _ in range(3000)]
    _, sizes = pk.packed(small)
    assert sum(small) / sum(sizes) > 0.99


def slow_fill(lengths, order, sizes):
    """Best fit from its definition."""
    bins, where = [], [0] * len(lengths)
    for i in order:
        x = lengths[i]
        fits = [(b[0] - b[1], k) for k, b in enumerate(bins) if b[0] - b[1] >= x]
        if fits:
            least = min(r for r, _ in fits)
            k = max(k for r, k in fits if r == least and bins[k][2] == max(bins[j][2] for q, j in fits if q == least))
        else:
            coming = lambda c, x=x: sum(n for n in lengths if n <= min(c - x, x))
            c = min((c for c in sizes if c >= x), key=lambda c: (pk.cost(c) / (x + min(c - x, coming(c))), c))
            k = len(bins)
            bins.append([c, 0, 0])
        bins[k][1] += x
        bins[k][2] = max(b[2] for b in bins) + 1  # of bins with equal room the one that got it last is taken
        where[i] = k
    return where, [b[1] for b in bins]


def test_packing_is_best_fit_with_the_least_cost_set_of_sizes():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted(rng.sample(range(8, 60), 3))
        lengths = [rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(1, 40))]
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        for some in ([sizes[2]], sizes[1:], sizes[::2], sizes):
            assert pk.filled(lengths, order, some) == slow_fill(lengths, order, some)
        totals = []
        for some in ([sizes[2]], [sizes[0], sizes[2]], sizes[1:], sizes):
            totals.append(sum(pk.cost(next(c for c in sizes if c >= n)) for n in slow_fill(lengths, order, some)[1]))
        assert abs(sum(map(pk.cost, pk.packed(lengths, sizes)[1])) - min(totals)) < 1e-6


def test_several_capacities_are_opened(spark):
    opened = {}
    lengths = [min(2048, len((r.text or "").split()) + 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    where, content = pk.filled(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), pk.CAPACITIES)
    for x, b in zip(lengths, where, strict=True):
        opened.setdefault(b, x)
    _, sizes = pk.packed(lengths)
    assert len(set(sizes)) > 1 and sum(content) == sum(lengths)
    one = sum(pk.cost(next(c for c in pk.CAPACITIES if c >= n)) for n in pk.filled(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), [2048])[1])
    assert sum(map(pk.cost, sizes)) < 0.9 * one


def test_repeated_rows_are_spread_over_shards_and_ids_may_be_text(spark):
    df = spark.createDataFrame([("x", "a b c")] * 300 + [(None, None)] * 100 + [(str(i), "d " * i) for i in range(100)], "doc_id string, text string").repartition(3)
    rows = pk.pack(df, shard=40).collect()
    assert len(rows) == 500 and sum(r.length for r in rows if r.doc_id == "x") == 1200
    assert len({r.bin >> 32 for r in rows if r.doc_id == "x"}) > 3


def test_every_token_is_packed_once(spark):
    texts = [None, "", "a", "b " * 5000, "c " * 2047, "c " * 2048] + ["w " * (i % 700) for i in range(200)]
    df = spark.createDataFrame([(i % 150, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, bin string")
    rows = pk.pack(df, shard=40).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").split()) + 1 for t in texts)
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.slot)
        at = 0
        for k, r in enumerate(rs):
            assert (r.slot, r.offset) == (k, at)
            at += r.length
        assert at <= rs[0].capacity and len({r.capacity for r in rs}) == 1
    assert pk.pack(df.where("false")).count() == 0 and pk.pack(df.selectExpr("cast(null as long) doc_id", "text")).count() == len(rows)
