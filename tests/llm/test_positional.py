import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
from skein.llm import positional, queries

SF = "/root/testdata/sf0.01"
DOC = "n_words string, text string, doc_id long, runs int"
ITEM = "n_words string, text string, item_id long"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = tokens(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(None, t, i, 1) for i, t in docs], DOC)
    b = spark.createDataFrame([(None, t, i) for i, t in items], ITEM)
    rows = positional.digest(positional.contamination(spark, d, b, **options)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == plain(docs, items)
    return {r.doc_id: r.n_near for r in rows}


def test_random_texts_equal_plain_search(spark):
    rng = random.Random(4)
    for vocabulary in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé"):
        text = lambda n: " ".join(rng.choices(vocabulary, k=n))  # noqa: E731, B023
        docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
        items = [(i + 5, text(rng.randint(0, 14))) for i in range(40)]
        docs += [(1000 + i, f"{text(3)} {items[i][1]} {text(3)}") for i in range(40)]
        check(spark, docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    docs = [(i, text(50)) for i in range(60)]
    items = [(i, text(12)) for i in range(30)]
    few = check(spark, docs, items)
    monkeypatch.setattr(positional.blocks, "__defaults__", (300,))
    assert check(spark, docs, items) == few == plain_near(docs, items)


def test_repeated_and_null_keys_give_a_row_each_under_any_number_of_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words[i : i + 12])) for i in range(0, 48, 12)]
    texts = [" ".join(words[:15]), " ".join(words[12:40]), "nothing of it", None]
    docs = [(k, t) for k in (7, 7, None) for t in texts]
    want = sorted((str(k), *plain([(0, t)], items)[0]) for k, t in docs)
    for limit in (2_000_000, 100):
        monkeypatch.setattr(positional.blocks, "__defaults__", (limit,))
        d = spark.createDataFrame([(None, t, i, 1) for i, t in docs], DOC).repartition(3)
        b = spark.createDataFrame([(None, t, i) for i, t in items], ITEM)
        rows = positional.digest(positional.contamination(spark, d, b)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want


def test_long_items_are_spread_over_blocks():
    text = " ".join(f"w{i}" for i in range(5000))
    parts = list(positional.Windows.of([3, 4], [text, "one two"], most=1000))
    assert len(parts) == 50 and sum(len(p.grid) for p in parts) == 4991 + 1 and set(np.concatenate([p.owner for p in parts]).tolist()) == {3, 4}
    assert parts[-1].length.tolist()[-1] == 2


def test_words_with_patterns_differ(spark):
    one = "a"
    for _ in range(10):
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    check(spark, [(1, one), (2, other), (3, f"x {one} y")], [(1, one), (2, other + "b")])


def test_odd_rows(spark):
    one = "Alpha, beta gamma\ndelta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, None), (2, ""), (3, one), (4, one.upper()), (5, "x " * 100_000 + one), (6, "alpha"), (7, "!!!"), (8, one.replace("delta", "delto"))]
    items = [(1, one), (10, one), (2, None), (3, ""), (4, "ALPHA"), (5, "..."), (6, "kappa lambda")]
    near = check(spark, docs, items)
    assert near[8] >= 2 and near[6] == 1
    check(spark, [], items)
    check(spark, docs, [])


def test_matches_dont_cross_documents(spark):
    words = [f"w{i}" for i in range(20)]
    check(spark, [(i, " ".join(words[i : i + 5])) for i in range(0, 20, 5)], [(1, " ".join(words))])


def plain_near(docs, items, slop=3, misses=2):
    out = {}
    for d, t in docs:
        at = {}
        for k, w in enumerate(words := tokens(t)):
            at.setdefault(w, []).append(k)
        found = set()
        for i, x in items:
            w = tokens(x)
            for j in range(max(1, len(w) - 9) if w else 0):
                own = w[j : j + 10]
                for s in range(-len(own) - slop, len(words) + slop):
                    hits = sum(any(abs(p - s - k) <= slop for p in at.get(q, ())) for k, q in enumerate(own))
                    if hits and hits >= len(own) - len(own) * misses // 10:
                        found.add(i)
        out[d] = len(found)
    return out


def test_proximity_matches_equal_plain_search(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 10, 13])))) for i in range(25)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(40)]
    for i, x in items:
        w = x.split()
        for k in range(2):
            w[rng.randrange(len(w))] = f"new{k}"
        w.insert(rng.randrange(len(w)), "more")
        docs.append((100 + i, " ".join([*rng.choices(vocabulary, k=3), *w, *rng.choices(vocabulary, k=3)])))
    assert check(spark, docs, items) == plain_near(docs, items)


def test_neighbours_dont_hide_a_reworded_passage(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    one, reworded = " ".join(words), " ".join(["other", *words[1:]])
    docs = [(1, reworded), (2, "alpha stands here alone")] + [(3 + i, " ".join(words[1:4])) for i in range(5)]
    d = spark.createDataFrame([(None, t, i, 1) for i, t in docs], DOC).coalesce(1)
    b = spark.createDataFrame([(None, one, 1)], ITEM)
    near = {r.doc_id: r.n_near for r in positional.digest(positional.contamination(spark, d, b)).collect()}
    assert near == {i: int(i == 1) for i, _ in docs}


def test_query_on_whole_tables(spark):
    read = lambda t, k: [(r[k], r["text"]) for r in pq.read_table(f"{SF}/{t}.parquet", columns=[k, "text"]).to_pylist()]
    rows = queries.op7_positional_index(spark, SF).collect()
    want = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    assert sum(r.contaminated for r in rows) > 10
