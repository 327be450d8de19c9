"""Whole long texts in time that follows their length, in bounded steps."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from skein.llm import automaton, html_layout, langid, line_dedup, media, ngram_join, notices, positional, privacy, queries, seekable

SIZE = 10_000_000
WORDS = [f"{a}{b}{c}" for a in ("the", "un", "lic", "re", "mi", "grün") for b in ("ens", "da", "por", "t") for c in ("e", "ing", "s by", "t\n")]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    text = " ".join(rng.choices(WORDS, k=SIZE // 7))
    return text[: SIZE - 100] + " jo@x.org licensed under the mjt license"


def seconds(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_long_texts(long_text):
    column = pa.array([long_text, None, ""])
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], [rng.normal(0, 1, (w, langid.CLASSES, 4)).astype(np.float32) for w in langid.WIDTHS], np.zeros(12, np.float32), rng.normal(0, 1, (12, 2)).astype(np.float32), np.zeros(2, np.float32))
    short = langid.predict_texts(net, pa.array([long_text[:3000]]), lambda t: True)[1]
    lang, score = langid.predict_texts(net, column, lambda t: True if t else None)
    assert lang[1:] == ["und", "und"] and 0 < score[0] <= 1 and 0 < short[0] <= 1
    scanner = notices.Scanner(notices.BASE + notices.FUZZY)
    spans = scanner.spans(f" {b' '.join(notices.normal(long_text)).decode()} ")
    assert any(e == 1 for *_, e in spans)
    base = privacy.find_base(long_text, 0)
    assert len(base) == 1 and len(privacy.context(long_text, base)) > 100_000
    assert len(line_dedup.Lines(column).hashes) == sum(1 for x in long_text.split("\n") if x.strip(" "))
    values, first = ngram_join.document_sets(column, 5)
    assert first[1] == first[2] == first[3] == len(values) > 1000
    windows = list(positional.Windows.of([1], [long_text]))
    assert sum(len(w.grid) for w in windows) > 1_000_000 and max(w.grid.size for w in windows) <= positional.BLOCK_WORDS
    ids, decoded = automaton.WordBpe(queries.tokenizer_path("word_bpe_49k.json")).encode(long_text)
    assert len(ids) > 1_000_000 and decoded.startswith(long_text.split()[0][:2].encode())
    assert len(seekable.byte_level_encoder(queries.tokenizer_path("byte_bpe_50k.json"))(long_text)) > 1_000_000


def test_long_markup(long_text):
    text = html_layout.extract("<p>" + long_text.replace("\n", "</p><p>"))[0]
    assert len(text) > SIZE / 2


def test_pieces_give_what_whole_windows_give(monkeypatch):
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], [rng.normal(0, 1, (w, langid.CLASSES, 4)).astype(np.float32) for w in langid.WIDTHS], np.zeros(12, np.float32), rng.normal(0, 1, (12, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = pa.array(["x" * 3000, "", None, "the word " * 700, "é" * 256, "a"])
    whole = langid.predict_texts(net, texts, lambda t: True if t else None)
    monkeypatch.setattr(langid, "PIECE", 2 * langid.WINDOW)
    parts = langid.predict_texts(net, texts, lambda t: True if t else None)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_codecs_and_media_take_repeated_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a b"), (None, None), (2, "")], "doc_id long, text string")
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = automaton.encode_decode(df, path).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 2 and automaton.encode_decode(df.limit(0), path).count() == 0
    found = media.text_media(df).collect()
    assert len(found) == 5 and media.text_media(df.limit(0)).count() == 0
    assert len({r.feature for r in found if r.payload_sha256 == found[0].payload_sha256}) == 1
    assert notices.scan(df).count() == 5 and langid.predict(df, None, keep=["doc_id"]).count() == 5
