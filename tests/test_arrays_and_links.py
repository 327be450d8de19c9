import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from skein.config import WESTERN, WESTERN_GATE
from skein.functions import text as T
from skein.operators import grams, measures, neardup
from skein.operators.parts import in_parts
from skein.plans import textual

SF = "/root/testdata/sf0.001"


def plain_signature(text, n=64):
    words = [zlib.crc32(w.encode()) for w in text.split()]
    if len(words) < 5:
        shingles = set(words)
    else:
        shingles = {sum(w * neardup.BASE ** (4 - j) for j, w in enumerate(words[i : i + 5])) % 2**64 for i in range(len(words) - 4)}
    return [min((h * a + b) % 2**61 for h in shingles) for a, b in neardup.coefficients(n)]


def test_signatures_equal_plain_ones(spark):
    rng = random.Random(3)
    texts = ["", None, " \n", "one", "a b c d", "a b c d e", "é ü ß ж 漢 x y", *(" ".join(rng.choices("abcdefgh", k=rng.randrange(40))) for _ in range(60)), "w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.sig) for r in neardup.signatures(df, 16).collect()}
    assert got == {i: plain_signature(t, 16) for i, t in enumerate(texts) if (t or "").split()}
    ids = spark.createDataFrame([(1, [3, 4, 5]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r.doc_id for r in neardup.signatures(ids, 8, tokens="ids").collect()] == [1]


def near(rng, base, n):
    return " ".join(w if rng.random() > n else f"x{rng.randrange(999)}" for w in base)


def groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_links_connect_the_same_whatever_the_bucket_size(spark, monkeypatch):
    rng = random.Random(5)
    bases = [[f"w{k}_{i}" for i in range(120)] for k in range(3)]
    texts = [near(rng, rng.choice(bases), rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = {i: np.array(plain_signature(t)) for i, t in enumerate(texts)}
    shared = lambda x, y: any((x[b : b + 8] == y[b : b + 8]).all() for b in range(0, 64, 8))
    pairs = [(i, j) for i in sigs for j in sigs if i < j and shared(sigs[i], sigs[j]) and (sigs[i] == sigs[j]).mean() >= 0.8]
    want = groups(sigs, pairs)
    for largest, part in ((200, 4000), (5, 4000), (5, 12)):
        monkeypatch.setattr(neardup, "LARGEST", largest)
        monkeypatch.setattr(neardup, "PART", part)
        found = neardup.links(spark, neardup.signatures(df))
        rows = found.collect()
        assert groups(sigs, [(r.a, r.b) for r in rows]) == want and all((sigs[r.a] == sigs[r.b]).mean() == r.similarity for r in rows)
        assert {r.doc_id: r.cluster for r in neardup.clusters(spark, found.select("a", "b")).collect()} == {i: c for i, c in want.items() if sum(x == c for x in want.values()) > 1}


def test_best_matches_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = [near(rng, base, rng.choice([0, 0.05, 0.2, 0.5])) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = {i: np.array(plain_signature(t)) for i, t in enumerate(texts)}
    shared = lambda x, y: any((x[b : b + 4] == y[b : b + 4]).all() for b in range(0, 64, 4))
    want = {}
    for i in range(0, 90, 7):
        scores = [(-(sigs[i] == sigs[j]).mean(), j) for j in range(90) if j % 7 and shared(sigs[i], sigs[j])]
        if scores:
            want[i] = (-min(scores)[0], min(scores)[1])
    for part in (4000, 10):
        monkeypatch.setattr(neardup, "PART", part)
        got = {r.held: (r.agreement, r.train) for r in neardup.best_matches(spark, neardup.signatures(df), F.col("doc_id") % 7 == 0).collect()}
        assert got == want and len(got) > 8


def test_parts_keep_all_pairs_of_a_group(spark):
    rows = [(1, i) for i in range(100)] + [(2, i) for i in range(6)]
    got = {}
    for r in in_parts(spark.createDataFrame(rows, "token long, node long"), 10).collect():
        got.setdefault((r.token, r.part), set()).add(r.node)
    assert all(any({a, b} <= s for (t, _), s in got.items() if t == 1) for a in range(100) for b in range(a))
    assert max(len(s) for s in got.values()) <= 30 and got[2, 0] == set(range(6))


def test_measures_equal_the_expressions(spark):
    rng = random.Random(7)
    odd = ["", None, "  ", "İstanbul ЖЖ", "a\u0085b c\x1cd", "The the THE thé", "x-y-z 12½ ²٣", "ąę żółć", "𝒜bc ß ẞ", "word\n" * 3, "الكتاب 漢字 한글"]
    odd += ["".join(rng.choices("abAB éÉñ12-.\n\tжЖ'«»", k=rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in measures.measure(df, WESTERN, ["doc_id"]).select("doc_id", *(f"n_{c}" for c in measures.COUNTS), *(c.alias(k) for k, c in measures.signals().items()), measures.reason(WESTERN_GATE).alias("reason")).collect()}
    classes = T.character_classes("text", WESTERN)
    want = df.select("doc_id", *(c.alias(k) for k, c in classes.items()), T.clean_word_share("text", WESTERN).alias("share"), *(c.alias(f"s_{k}") for k, c in T.language_signals("text", WESTERN).items()), T.gate_reason("text", WESTERN, WESTERN_GATE).alias("reason"))
    for r in want.collect():
        g = got[r.doc_id]
        assert g.reason == r.reason, odd[r.doc_id]
        if odd[r.doc_id] is not None:
            assert [g[f"n_{k}"] for k in classes] == [r[k] for k in classes], odd[r.doc_id]
            if "İ" not in odd[r.doc_id]:
                assert (g.alpha, g.cyrillic, g.diacritic, g.stopword) == (r.share, r.s_cyrillic, r.s_diacritic, r.s_stopword), odd[r.doc_id]
        else:
            assert g.n_words is None
    assert measures.measure(df.limit(0), WESTERN, ["doc_id"]).count() == 0


def test_gram_counts_equal_counters(spark, monkeypatch):
    monkeypatch.setattr(grams, "HELD", 500)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:80] + [None, "", "One one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = [(t or "").lower().split() for t in texts]
    one = grams.gram_counts(df, 1).groupBy("a").agg(F.sum("n").alias("n")).collect()
    assert Counter(r.n for r in one) == Counter(Counter(w for x in words for w in x).values())
    two = grams.gram_counts(df, 2).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert Counter(r.n for r in two) == Counter(Counter(p for x in words for p in zip(x, x[1:], strict=False)).values())
    hashed = {r.h for r in spark.createDataFrame([(w,) for x in words for w in x], "w string").select(grams.word_hash(F.col("w")).alias("h")).collect()}
    assert {r.a for r in one} == hashed


def test_edit_distance_equals_the_full_table(spark):
    rng = random.Random(8)
    for _ in range(150):
        x, y = (rng.choices(range(4), k=rng.randrange(12)) for _ in range(2))
        old = list(range(len(y) + 1))
        for i, v in enumerate(x, 1):
            row = [i]
            for j, w in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (v != w)))
            old = row
        assert textual.edit_distance(np.array(x, np.int64), np.array(y, np.int64)) == old[-1]
    rows = textual.word_error_rate(spark, SF).collect()
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id, r.turn] = (r.text or "").split()
    want = Counter()
    for (c, t), a in turns.items():
        if (c, t + 1) in turns:
            known = {}
            want[c] += textual.edit_distance(*(np.array([known.setdefault(w, len(known)) for w in side], np.int64) for side in (a, turns[c, t + 1])))
    assert {r.conv_id: r.edits for r in rows} == dict(want) and len(rows) > 5
