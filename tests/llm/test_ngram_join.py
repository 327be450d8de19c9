import random
import re

import numpy as np
import pyarrow.parquet as pq
from skein.llm import ngram_join, queries
from skein.llm.components import components

SCHEMA = "n string, text string, doc_id long, cls int, node string"


def shingle_set(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    done = set()
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, texts):
    df = spark.createDataFrame([("x", t, i, 7, None) for i, t in texts], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(spark, df).collect()}
    assert got == plain(texts)
    return got


def edited(rng, words, rate):
    return [rng.choice("pqrstuv") + rng.choice("abcdef") if rng.random() < rate else w for w in words]


def test_near_copies_at_all_distances(spark):
    rng = random.Random(3)
    texts = []
    for group in range(12):
        base = [rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(9)) for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(14):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]))))
    passage = " ".join(f"common{i}" for i in range(40))
    texts += [f"{passage} {' '.join(rng.choices('abcdefghij', k=30))}" for _ in range(60)]
    rng.shuffle(texts)
    ids = rng.sample(range(-500, 5000), len(texts))
    got = check(spark, list(zip(ids, texts, strict=True)))
    assert len({c for _, c in got.values()}) < len(got)


def test_large_group_with_links_of_all_kinds(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(140)]
    texts = [" ".join(edited(rng, base, rng.uniform(0, 0.05))) for _ in range(350)]
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    texts = ["", None, "  \n\t ", "A b", "a B", "a b c", "a b c d e", "A B C D E", "a b c d e f", "x" * 100_000, "y " * 30_000, "é É", "é É", "a b"]
    check(spark, list(enumerate(texts)))
    check(spark, [])
    check(spark, [(5, None)])


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    one, near = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(59)), "other"])
    rows = [(9, one), (9, one), (9, "quite another text with some words"), (4, near), (None, one), (None, "alone"), (None, "alone"), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame([("x", t, i, 7, None) for i, t in rows], SCHEMA).repartition(5)
    found = ngram_join.link_components(spark, df)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.digest(found).collect())
    assert got == sorted([("9", 56, "4"), ("9", 56, "4"), ("9", 2, "9"), ("4", 56, "4"), ("None", 56, "4"), ("None", 1, "None"), ("None", 1, "None"), ("None", 0, "None"), ("None", 0, "None"), ("3", 0, "3")])
    kept = sorted((str(r.doc_id), str(r.text)[:5]) for r in ngram_join.keep_first(df, found).collect())
    assert kept == [("3", ""), ("4", "w0 w1"), ("9", "quite"), ("None", "None"), ("None", "None"), ("None", "alone")]


def test_large_blocks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 16)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(edited(rng, base, rng.uniform(0, 0.06))) for _ in range(160)]
    check(spark, list(enumerate(texts)))


def test_words_with_patterns_differ(spark):
    one = "a"
    for _ in range(10):
        one += one.translate({97: 98, 98: 97})
    check(spark, [(1, one), (2, one.translate({97: 98, 98: 97})), (3, one.upper())])


def test_whole_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_count_vector_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain([(r["doc_id"], r["text"]) for r in t.to_pylist()])


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    points = rng.poisson(1.5, (700, ngram_join.GROUPS)).astype("<u2")
    points[300:] = np.maximum(points[rng.integers(0, 5, 400)].astype(int) + rng.integers(-1, 2, (400, ngram_join.GROUPS)) * (rng.random((400, ngram_join.GROUPS)) < 0.2), 0)
    sizes = points.sum(axis=1).astype(np.int64)
    comp = rng.integers(0, 40, 700)
    tree = ngram_join.RTree(sizes, points, comp)
    some = 0
    for i in range(700):
        found, bound = tree.search(i, 75)
        least = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero((least >= ngram_join.needed(sizes, int(sizes[i]), 75)) & (comp != comp[i]))
        assert sorted(found.tolist()) == want.tolist() and (least[found] == bound).all()
        some += len(want)
    assert some > 1000


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(700, 900)] + [(5000, 5000), (7, 6), (6, 7)]
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
