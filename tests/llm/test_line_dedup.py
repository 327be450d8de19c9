import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from skein.llm import line_dedup, queries
from skein.operators.parts import in_parts

SCHEMA = "line string, text string, doc_id long, removed int"


def frame(spark, texts):
    return spark.createDataFrame([("x", t, i, 1) for i, t in texts], SCHEMA).repartition(4)


def blank(line):
    return not line.strip(" \t\n\r\x0b\x0c")


def fold(line):
    return "".join(" " if c in "\t\x0b\x0c\r" else c.lower() if c.isascii() else c for c in line)


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def plain(texts, percent=75):
    """Removed lines by comparing all pairs of distinct lines that share a shingle."""
    places, n = {}, {}
    for d, t in sorted(texts):
        lines = t.split("\n") if t is not None else []
        n[d] = len(lines)
        for k, line in enumerate(lines):
            if not blank(line):
                places.setdefault(fold(line), []).append((d, k))
    nodes = list(places)
    sets = [shingles(x) for x in nodes]
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    near = 0
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                near += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i, x in enumerate(nodes):
        groups.setdefault(find(i), []).extend(places[x])
    removed = {d: [] for d in n}
    for own in groups.values():
        for d, k in sorted(own)[1:]:
            removed[d].append(k)
    return {d: (n[d], sorted(r)) for d, r in removed.items()}, near


def edit(rng, line, k):
    s = list(line)
    for _ in range(k):
        s[rng.randrange(len(s))] = rng.choice("xyzé")
    return "".join(s)


def test_exact_and_clear_copies_equal_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefghij klmno é", k=rng.choice([25, 60, 150, 400]))) for _ in range(60)]
    texts = []
    for d in range(120):
        lines = [edit(rng, x, 1 if len(x) > 100 else 0) for x in rng.choices(base, k=4)] + rng.choices(["Home", "", "short line", "Ab " * 3], k=2)
        lines += ["".join(rng.choices("pqrstuvw", k=40))]
        rng.shuffle(lines)
        texts.append((d * 3 - 50, "\n".join(lines)))
    want, near = plain(texts)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.duplicate_lines(spark, frame(spark, texts)).collect()}
    assert near > 100 and got == want


def test_recall_at_all_similarities(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvw ", k=200)) for _ in range(80)]
    texts = [(i, "\n".join([x, edit(rng, x, rng.choice([1, 2, 3]))])) for i, x in enumerate(base)]
    want, _ = plain(texts)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.duplicate_lines(spark, frame(spark, texts)).collect()}
    expected = sum(len(r) for _, r in want.values())
    found = sum(len(r) for _, r in got.values())
    assert all(set(got[d][1]) <= set(want[d][1]) for d in want) and found >= 0.95 * expected > 20


def test_odd_rows_and_drop(spark):
    long = "the same line stands here again"
    texts = [(1, None), (2, ""), (3, long), (4, long.upper()), (5, f"a\n{long}\r\nb"), (6, "\n\n"), (7, f"{long}\n{long}"), (8, "z" * 50_000), (9, "z" * 50_000 + "!"), (10, "é" * 3), (11, "é" * 3), (12, "é" * 20), (13, "é" * 20), (14, "é" * 4)]
    found = line_dedup.duplicate_lines(spark, frame(spark, texts))
    got = {r.doc_id: (r.n_lines, r.removed) for r in found.collect()}
    want = plain(texts)[0]
    assert got == want and got[1] == (0, []) and got[2] == (1, [])
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(frame(spark, texts), found).collect()}
    assert kept[1] is None and kept[2] == "" and kept[5] == "a\nb" and 4 not in kept and 7 not in kept and 11 not in kept
    assert 13 not in kept and kept[6] == "\n\n" and kept[14] == "é" * 4
    assert line_dedup.duplicate_lines(spark, frame(spark, [])).count() == 0


def test_documents_with_only_blank_lines_left_go(spark):
    long = "the same line stands here again"
    texts = [(1, f"{long}\n\nend"), (2, f"{long}\n\n"), (3, f"\t\n{long}\n\u00a0 "), (4, f"{long}\nmore"), (5, "\n")]
    found = line_dedup.duplicate_lines(spark, frame(spark, texts))
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(frame(spark, texts), found).collect()}
    assert kept == {1: texts[0][1], 4: "more", 5: "\n"}


def test_short_lines_go_if_they_are_equal(spark):
    texts = [(1, "Ab\n\nend"), (2, "aB\n\t\n\nac"), (3, "end\nend\n  \nseven_7"), (4, "seven_8\neight__8"), (5, "eight__9\nEIGHT__8")]
    want, _ = plain(texts)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.duplicate_lines(spark, frame(spark, texts)).collect()}
    assert got == want and [got[i][1] for i in (1, 2, 3, 4, 5)] == [[], [0], [0, 1], [], [1]]


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    one, two, three = "first line of some text", "second line, unlike the first", "a third line"
    texts = [(5, f"{one}\n{two}"), (5, f"{one}\n{two}"), (5, f"{three}\n{one}"), (None, f"{two}\nonly here, without any key"), (None, three), (None, three), (None, None), (None, "\n"), (None, "\n")]
    found = line_dedup.duplicate_lines(spark, frame(spark, texts))
    rows = sorted((r.doc_id is None, r.n_lines, len(r.removed)) for r in found.collect())
    assert len(rows) == len(texts) and sum(r[2] for r in rows) == 2 + 1 + 1 + 2 and all(n == 0 for miss, _, n in rows if not miss) is False
    kept = line_dedup.drop_lines(frame(spark, texts), found).collect()
    left = sorted(x for r in kept for x in (r.text or "").split("\n") if x)
    assert left == sorted([one, two, three, "only here, without any key"])
    assert sum(r.text is None for r in kept) == 1 and sum(r.text == "\n" for r in kept) == 2 and sum(r.doc_id == 5 for r in kept) == 2


def test_large_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 1500)
    rng = random.Random(12)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvw ", k=120))
    texts = [(i, edit(rng, base, rng.choice([0, 1, 1, 2, 3]))) for i in range(150)]
    want, _ = plain(texts)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.duplicate_lines(spark, frame(spark, texts)).collect()}
    assert sum(got[d] == want[d] for d in want) >= 148
    members = spark.createDataFrame([(7, i) for i in range(60)] + [(8, i) for i in range(5)], "token long, node long")
    parts = {}
    for r in in_parts(members, 12).collect():
        parts.setdefault((r.token, r.part), set()).add(r.node)
    assert all(any({a, b} <= s for (t, _), s in parts.items() if t == 7) for a in range(60) for b in range(60)) and len(parts) > 10 and parts[8, 0] == set(range(5))


def test_long_text_with_many_lines_is_linear(spark):
    lines = [f"line number {i:07d} of a long text" for i in range(200_000)]
    texts = [(1, "\n".join(lines)), (2, "\n".join([*lines[::-1], "one more"]))]
    df = frame(spark, texts)
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(df, spark.createDataFrame([(2, None, 200_001, list(range(200_000)))], "doc_id long, text_hash long, n_lines long, removed array<int>").join(df.selectExpr("doc_id", "xxhash64(text) AS h"), "doc_id").selectExpr("doc_id", "h AS text_hash", "n_lines", "removed")).collect()}
    assert kept == {1: texts[0][1], 2: "one more"}


def test_query_against_all_pairs(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want, _ = plain([(r["doc_id"], r["text"]) for r in t])
    rows = queries.op8_fuzzy_lines(spark, "/root/testdata/sf0.001").collect()
    got = {r.doc_id: [int(x) for x in r.removed.split(",") if x] for r in rows}
    same = sum(got[d] == want[d][1] for d in want)
    assert len(got) == len(want) and same >= 0.99 * len(want) and all(r.n_lines == want[r.doc_id][0] for r in rows)


@pytest.mark.parametrize("texts", [[b"a\nb", b"", b"\n", b"xyz"], [b""], [b"\n\n\n"]])
def test_line_spans(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = line_dedup.line_spans(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert got == [t.split(b"\n") for t in texts]


def test_bucket_links_connect_what_all_pairs_connect():
    rng = random.Random(4)
    for n, spread in ((2, 0.1), (3, 0.1), (40, 0.12), (120, 0.2)):
        base = [rng.sample(range(1000), 60) for _ in range(3)]
        sets = [set(x if rng.random() > spread * rng.random() * 2 else rng.randrange(1000, 9000) for x in rng.choice(base)) for _ in range(n)]
        values = np.array([v for s in sets for v in sorted(s)], np.uint64)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])

        def labels(links):
            root = list(range(n))  # noqa: B023
            for a, b in [*links, *links[::-1]] * n:  # noqa: B023
                root[a] = root[b] = min(root[a], root[b])
            return root

        every = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        links = line_dedup.bucket_links(values, owner, n)
        assert labels(links) == labels(every) and len(links) <= n - 1
