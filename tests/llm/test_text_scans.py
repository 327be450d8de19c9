import hashlib
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from skein.llm import langid, notices, privacy, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "score string, text string, doc_id long, lang string, spans string, n_words int"


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(None, t, i, lang, "x", 1) for i, t in enumerate(texts)], SCHEMA)


ODD = ["", None, "   ", "1 2 3 ...", "x" * 200_000, "a b c", "a b c", "é " * 30_000]


def test_langid_held_out_accuracy(spark):
    rows = queries.op1_byte_cnn(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_texts_and_no_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(langid.learnable(docs), epochs=2)
    rows = sorted(langid.predict(frame(spark, ODD), net).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred == "und" for r in rows] == [True] * 4 + [False] * 4 and all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    assert rows[5].score == rows[6].score and rows[0].spans == "x"
    assert langid.fit(langid.learnable(frame(spark, ODD))) is None
    assert {r.lang_pred for r in langid.predict(frame(spark, ODD), None).collect()} == {"und"}
    assert langid.predict(frame(spark, []), net).count() == 0


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 255, b"b" * 256, b"c" * 257]
    offsets = np.cumsum([0, *map(len, texts)])
    grid, first = langid.cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.diff(first).tolist() == [0, 1, 1, 2]
    assert [int((grid[a:b] > 0).sum()) for a, b in zip(first, first[1:], strict=False)] == list(map(len, texts))


def test_combined_tables_equal_plain_convolution():
    rng = np.random.default_rng(3)
    grid = np.zeros((5, langid.WINDOW + 3), np.uint8)
    grid[:, : langid.WINDOW] = rng.integers(0, 128, (5, langid.WINDOW))
    net = langid.train(grid, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=1)
    pooled = [sum(t[k][grid[:, k : langid.WINDOW + k]] for k in range(w)).max(axis=1) for t, w in zip(net.tables, langid.WIDTHS, strict=True)]
    want = langid.log_softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.weight + net.offset)
    assert np.allclose(net.windows(grid), want, atol=1e-4)


def harmed(rng, phrase, n):
    s = list(phrase)
    for _ in range(n):
        i = rng.randrange(1, len(s) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = "q"
        elif kind == 1:
            s.insert(i, "q")
        else:
            del s[i]
    return "".join(s)


def test_notices_equal_search_without_seeds(spark):
    rng = random.Random(5)
    words = ["the", "of", "cc", "by", "license", "general", "public", "all", "rights", "é", "licensed", "under"]
    texts = [*ODD, "CC BY cc-by cc by", "All rights\nreserved. GENERAL public LICENSE", "ccby cc bye acc by"]
    for n in notices.BASE + notices.FUZZY:
        for k in range(n.edits + 2):
            texts.append(" ".join([*rng.choices(words, k=5), harmed(rng, n.phrase, k), *rng.choices(words, k=5)]))
    texts += pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60]
    got = {r.doc_id: r for r in notices.scan(frame(spark, texts)).collect()}
    both = notices.BASE + notices.FUZZY
    hits = 0
    for i, t in enumerate(texts):
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        assert got[i].n_words == len(w)
        for n in both:
            mine = [s for s in got[i].spans if (s.phrase, s.base, s.label) == (n.phrase, n.base, n.label)]
            p = n.phrase.split()
            if n.base:
                assert [s.first_word for s in mine] == [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            elif len(w) < 1000:
                found = regex.search(f"(?<= )(?:{n.phrase}){{e<={n.edits}}}(?= )", f" {' '.join(w)} ")
                assert bool(found) == bool(mine), (n, t)
                hits += bool(found)
    assert hits >= sum(n.edits + 1 for n in notices.FUZZY)


def all_matches(line, phrase, k):
    """(edits, start, end) of all stretches between blanks within k edits of the phrase."""
    cuts = [i for i, c in enumerate(line) if c == " "]
    out = []
    for a in cuts:
        for b in cuts:
            if abs(b - a - 1 - len(phrase)) <= k and b > a:
                x = line[a + 1 : b]
                row = list(range(len(phrase) + 1))
                for i, c in enumerate(x, 1):
                    old, row = row, [i, *([0] * len(phrase))]
                    for j, d in enumerate(phrase, 1):
                        row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d))
                if row[-1] <= k:
                    out.append((row[-1], a + 1, b))
    return out


def test_neighbouring_notices_span_by_span():
    rng = random.Random(8)
    scanner = notices.Scanner(notices.BASE + notices.FUZZY)
    both = notices.BASE + notices.FUZZY
    lines = ["licensed under the mjt licence licensed under the mit license", "gnu general public license gnu general public licence gnu lesser general public license"]
    for _ in range(60):
        own = rng.choices([n for n in notices.FUZZY if len(n.phrase) < 36], k=3)
        lines.append(" ".join(x for n in own for x in [harmed(rng, n.phrase, rng.randrange(n.edits + 1)), *rng.choices(["the", "of", "a"], k=rng.randrange(2))]))
    total = 0
    for text in lines:
        line = f" {text} "
        got = scanner.spans(line)
        for i, n in enumerate(both):
            mine = [(e, a, b) for j, a, b, e in got if j == i]
            if not n.edits:
                continue
            want = []
            for m in sorted(all_matches(line, n.phrase, n.edits)):
                if all(m[2] <= a or m[1] >= b for _, a, b in want):
                    want.append(m)
            assert sorted(e for e, _, _ in mine) == sorted(e for e, _, _ in want), (text, n, mine, want)
            assert all(any(e == f and a < d and c < b for f, c, d in want) for e, a, b in mine)
            total += len(want)
    assert total > 150


def test_many_notices_in_a_long_text_are_linear():
    scanner = notices.Scanner(notices.BASE + notices.FUZZY)
    line = " " + "licensed under the mit license word " * 20_000
    assert sum(i >= len(notices.BASE) for i, *_ in scanner.spans(line)) >= 20_000


def test_notices_digest(spark):
    row = notices.digest(notices.scan(frame(spark, ["x cc by y all rights reserved cc by"]))).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.score) == (9, 3, 1, 7, "cc-by,reserved", 1.0)
    empty = notices.digest(notices.scan(frame(spark, [None]))).first()
    assert (empty.n_words, empty.n_base, empty.first_word, empty.labels, empty.score) == (0, 0, None, "", 0.0)


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and privacy.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(9)
    texts = [*ODD, "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "+1 (555) 123-4567", "4111 1111 1111 1111", "9" * 3000, "é a.b+c@x-y.co.uk é", "000001.2.3.4"]
    texts += ["".join(rng.choices("0123456789.+- ()@ab", k=60)) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    got = {r.doc_id: r for r in privacy.digest(privacy.find(spark, frame(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w[1] == k for w in want) for k in range(4))
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("term")] == [f"{k}:{s}:{e}" for s, _, e, k in want]


@pytest.mark.parametrize("hostile", ["1" * 300_000, "a" * 300_000, "1." * 100_000, "+" * 200_000, "a@" * 100_000, "1 " * 150_000])
def test_base_search_is_linear(hostile):
    privacy.find_base(hostile, 300_000)


def test_disclosing_terms(spark):
    texts = [f"word{'abcdefgh'[i % 8]} zeppelin writes to jo@x.org from every town" for i in range(5)]
    texts += [f"every town has number {i} and writes from here" for i in range(60)]
    found = privacy.find(spark, frame(spark, texts))
    rows = {r.doc_id: r for r in found.collect()}
    said = lambda i: {(texts[i][s.start : s.stop], s.action) for s in rows[i].spans if s.kind == 4}
    assert said(0) == {("zeppelin", "remove")}
    assert all(not rows[i].spans for i in range(5, 65))
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame(spark, texts), found).collect()}
    assert clean[0] == "worda  writes to [email] from every town" and clean[10] == texts[10]
    assert privacy.find(spark, frame(spark, [])).count() == 0


def test_generalised_terms_say_what_they_are():
    text = "Xu paid 77 coins, quill by quill"
    spans = [{"start": a, "stop": b, "kind": 4, "action": act} for a, b, act in ((0, 2, "generalise"), (8, 10, "generalise"), (18, 23, "generalise"), (27, 32, "remove"))]
    assert privacy._rewritten(text, spans) == "[name] paid [number] coins, [word] by "
    assert privacy._rewritten(None, spans) is None and privacy._rewritten(text, []) == text


def test_context_is_linear_in_spans():
    text = "a@b.cd word " * 100_000
    began = time.perf_counter()
    assert len(privacy.context(text, privacy.find_base(text, 10))) == 100_000 and time.perf_counter() - began < 20


def test_disclosure_in_whole_documents_and_of_rare_entities(spark):
    filler = "every town has a number and writes from here " * 5
    texts = [f"Xu lives in 7ring. {filler} mail jo@x.org {filler} says Xu", f"{filler} +1 (555) 123-4567 {filler} Quill", f"Quill {filler} call +15551234567"]
    texts += [f"{filler} no one {i}" for i in range(80)]
    found = privacy.find(spark, frame(spark, texts))
    rows = {r.doc_id: r for r in found.collect()}
    said = lambda i: [(texts[i][s.start : s.stop], s.action) for s in rows[i].spans if s.kind == 4]
    assert said(0) == [("Xu", "remove"), ("lives", "remove"), ("7ring", "remove"), ("mail", "remove"), ("says", "remove"), ("Xu", "remove")]
    assert said(1) == said(2) == [("Quill", "remove")]
    assert not any(rows[i].spans for i in range(3, 83))
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame(spark, texts), found).collect()}
    assert "Xu" not in clean[0] and "Quill" not in clean[1] + clean[2]


def test_repeated_and_null_keys_keep_their_own_spans(spark):
    texts = [(7, "Zed writes to jo@x.org"), (7, "call +1 (555) 123-4567 and ask for Quill"), (None, "Uma has 10.1.2.3 here"), (None, None), (7, "Zed writes to jo@x.org")] + [(100 + i, f"every town has number {i}") for i in range(40)]
    df = spark.createDataFrame([("x", t, i, None) for i, t in texts], "spans string, text string, doc_id long, term int").repartition(3)
    found = privacy.find(spark, df)
    rows = privacy.digest(found).collect()
    assert len(rows) == len(texts)
    want = sorted((str(i), len(plain(t)), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in plain(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_email + r.n_ip + r.n_card + r.n_phone, r.base_sha256) for r in rows) == want
    clean = sorted(str(r.text) for r in privacy.sanitise(df, found).collect() if r.doc_id is None or r.doc_id == 7)
    assert len(clean) == 5 and "None" in clean and not any("Quill" in t or "Uma" in t or "@" in t for t in clean)
    scanned = notices.digest(notices.scan(df)).collect()
    assert len(scanned) == len(texts) and notices.scan(df.limit(0)).count() == 0
