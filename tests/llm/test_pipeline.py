import hashlib

import corpus_pipeline as cp
import numpy as np
import pyarrow.parquet as pq
from skein.llm.queries import tokenizer_path
from test_line_dedup import plain as plain_lines
from test_ngram_join import plain as plain_groups
from test_positional import plain as plain_windows
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen, at = [docs], docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, at, SF).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(at)
    assert all(t.columns == names for t in seen[:-1])
    texts = [{r.doc_id: r.text for r in t.collect()} for t in seen[:-1]]
    # language ID: sure texts stay as they are
    assert texts[1].items() <= texts[0].items() and len(texts[1]) >= 0.97 * len(texts[0])
    # line dedup
    removed, _ = plain_lines(list(texts[1].items()))
    want = {}
    for d, t in texts[1].items():
        n, gone = removed[d]
        if len(gone) < n:
            want[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone)) if gone else t
    same = sum(texts[2].get(d) == t for d, t in want.items())
    assert same >= 0.99 * len(want) and abs(len(texts[2]) - len(want)) <= 0.01 * len(want)
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    # near copies
    groups = plain_groups(list(texts[2].items()))
    assert texts[3] == {d: texts[2][d] for d, (_, c) in groups.items() if c == d}
    # benchmark windows
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hits = plain_windows(list(texts[3].items()), items)
    assert texts[4] == {d: t for d, t in texts[3].items() if not hits[d][4]}
    # tokens
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in seen[5].collect()}
    assert rows.keys() == texts[4].keys() and len(rows) > 50
    for d, t in texts[4].items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert rows[d].n_tokens == len(ids) and rows[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, SF)
    assert rows.count() > 50 and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (4, "a b c", None, "s", 5), (5, "1 2", "en", "s", 3), (6, "the word " * 9000, "en", "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in rows], schema)
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() <= len(rows)


def test_without_labels_texts_with_a_letter_stay(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([dict(zip(names, (i, t, None, "s", 1), strict=True)) for i, t in enumerate(["word", None, "12", "", "é"])], schema)
    assert sorted(r.doc_id for r in cp.language_id(spark, docs, SF).collect()) == [0, 4]


def test_repeated_and_null_keys_go_through_all_stages(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(1, "one line of text"), (1, "one line of text"), (None, "one line of text"), (None, "something else without a key"), (None, None), (1, "another text under the key")]
    docs = spark.createDataFrame([dict(zip(names, (i, t, "en", "s", 1), strict=True)) for i, t in rows], schema)
    kept = cp.near_copies(spark, cp.line_deduplication(spark, docs, SF), SF)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "another text under the key"), ("1", "one line of text"), ("None", "None"), ("None", "something else without a key")]
    assert cp.decontamination(spark, docs, SF).count() == len(rows) and cp.tokens(spark, docs, SF).count() == len(rows)
