import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from skein.llm import arrays, automaton, media, queries, seekable
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["", None, "   ", "a" * 3000, "ab" * 2000, "İΣς ſK 한글 é ẞ", "x\x1cy\x85z w", "<|endoftext|> hi <|endoftext|>", "it's we'll 12½ ²٣", "a" * 3000, "word " * 40_000]
SCHEMA = "n_tokens string, text string, doc_id long, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(None, t, i, "x") for i, t in enumerate(texts)], SCHEMA)


def test_automaton_equals_library(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]
    got = {r.doc_id: r for r in automaton.encode_decode(frame(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_gadgets_on_small_merges():
    vocab = {s: i for i, s in enumerate(["a", "b", "aa", "ab", "aab", "aaa"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("aa", "a")]
    machine = automaton.Automaton(vocab, merges)

    def naive(s):
        s = list(s)
        while True:
            best = min(((merges.index(p), i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in merges), default=None)
            if best is None:
                return [vocab[x] for x in s]
            u, v = merges[best[0]]
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [u, v]:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert machine.tokens(list(word)) == naive(word), word


def test_token_files_round_trip(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]
    files, folder = seekable.token_files(spark, frame(spark, texts), path, partitions=4)
    rows = sorted(seekable.read_tokens(files, folder).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    at = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)
    digest = {r.doc_id: r.ids_crc32 for r in seekable.digests(seekable.read_tokens(files, folder)).collect()}
    assert all(digest[r.doc_id] == zlib.crc32(bytes(r.ids)) for r in rows)
    firsts = [r["first"] for r in files.orderBy("first").collect()]
    assert firsts == sorted(firsts) and sum(r.n_docs for r in files.collect()) == len(texts)


def test_token_files_empty_table_and_repeated_keys(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    files, folder = seekable.token_files(spark, frame(spark, []), path, partitions=2)
    assert seekable.read_tokens(files, folder).count() == 0
    twice = frame(spark, ["a b", "c"]).unionByName(frame(spark, ["a b", "c"]))
    files, folder = seekable.token_files(spark, twice, path, partitions=2)
    assert sorted((r.doc_id, r.start) for r in seekable.read_tokens(files, folder).collect()) == [(0, 0), (0, 3), (1, 6), (1, 8)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_all_code_points_equal_the_library(name):
    path = queries.tokenizer_path(name)
    lib = Tokenizer.from_file(path)
    plain = None if name.startswith("word") else seekable.byte_level_encoder(path)
    encode = automaton.WordBpe(path).encode if plain is None else lambda t: (plain(t),)
    step = 61 if name.startswith("word") else 53
    for plane in range(0, 0x30000, 1 << 12):  # every code point with letters around it, in texts of many and alone for some
        codes = [c for c in range(plane, plane + (1 << 12)) if not 0xD800 <= c < 0xE000]
        for texts in (["".join(f"a{chr(c)}b " for c in codes)], [f"a{chr(c)}b" for c in codes[::step]]):
            for t in texts:
                assert np.frombuffer(encode(t)[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, (hex(plane), t[:9])
    assert np.frombuffer(encode("a\U0001094Fb")[0], "<u4").tolist() == lib.encode("a\U0001094Fb", add_special_tokens=False).ids


def test_token_files_are_read_by_several_tasks(spark, monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    df = frame(spark, texts).unionByName(spark.createDataFrame([(None, "no key", None, "x"), (None, None, None, "x")], SCHEMA))
    files, folder = seekable.token_files(spark, df, path, partitions=2)
    whole = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in seekable.read_tokens(files, folder).collect())
    monkeypatch.setattr(seekable, "READ_IDS", 4096)
    parts = seekable.read_tokens(files, folder)
    assert sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in parts.collect()) == whole
    assert len(whole) == len(texts) + 2 and [w[1] for w in whole[:2]] == [None, None] and whole[0][2] == 0
    assert len([n for n in parts.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]) > 4


def test_seekable_reader_reads_only_what_is_asked_for_and_checks_it():
    sink = io.BytesIO()
    writer = seekable.Writer(sink)
    docs = {k: np.arange(k + 1, dtype="<u4").tobytes() for k in range(50)}
    for k, ids in docs.items():
        writer.add(k, ids)
    writer.close()
    raw = sink.getvalue()

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            self.taken += len(got)
            return got

    source = Counting(raw)
    reader = seekable.Reader(source)
    source.taken = 0
    got = reader.get([7, 49, 1000])
    assert {k: v.tobytes() for k, v in got.items()} == {7: docs[7], 49: docs[49]}
    assert source.taken == int(reader.sizes[[7, 49], 0].sum())
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(docs.values())
    broken = bytearray(raw)
    broken[int(reader.begin[20]) + 8] ^= 1
    with pytest.raises(seekable.Corrupt):
        seekable.Reader(io.BytesIO(bytes(broken))).frame(20)
    with pytest.raises(seekable.Corrupt):
        seekable.Reader(io.BytesIO(raw[:-1]))


def test_media_of_texts(spark):
    texts = [*ODD, *pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]
    got = {r.doc_id: r for r in media.text_media(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        stored = b"P6\n64 %d\n255\n" % (len(padded) // 192) + padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert np.load(io.BytesIO(bytes(r.tile))).shape == (16, 16, 3)
    assert got[3].feature == got[9].feature and got[0].payload_sha256 == got[1].payload_sha256


def test_netpbm_and_bmp_decoders(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P2\n# c\n2 2\n15\n0 15 5 10\n")[:, :, 0].tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P5 2 1 255\n\x01\x02").ravel().tolist() == [1, 2]
    assert media.decode(b"P3 1 1 255 1 2 3").ravel().tolist() == [1, 2, 3]
    assert media.decode(b"P1\n3 1\n101").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P4\n10 1\n\xff\x40").ravel().tolist() == [0] * 8 + [255, 0]
    bad = [None, b"", b"P6\n9 9\n255\n123", b"BM" + b"\0" * 60, b"GIF89a", b"P5 0 1 255\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, media.encode_bmp(image)])], "id long, media binary")
    rows = sorted(media.features(df).collect())
    assert [r.reason is None for r in rows] == [False] * 6 + [True]
    assert (rows[6].height, rows[6].width, rows[6].channels) == (5, 7, 3)


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (40, 3), (9, 64)])
def test_area_resize_equals_direct_area_mean(shape):
    image = np.random.default_rng(2).integers(0, 256, (*shape, 3), dtype=np.uint8)

    def weights(n, m):
        return np.array([[max(0.0, min((j + 1) * n / m, i + 1) - max(j * n / m, i)) for i in range(n)] for j in range(m)]) * m / n

    want = np.einsum("yh,hwc,xw->yxc", weights(shape[0], 8), image, weights(shape[1], 9))
    assert (np.abs(media.area_resize(image, 8, 9) - want) <= 0.5 + 1e-6).all()


def test_workers_let_go_of_the_automaton(spark):
    def alive(batches):
        import gc

        from skein.llm.automaton import WordBpe

        n = sum(isinstance(x, WordBpe) for x in gc.get_objects())
        yield from (pa.RecordBatch.from_pydict({"n": [n]}) for _ in batches)

    rows = spark.range(0, 16, 1, 8)
    automaton.encode_decode(rows.selectExpr("id AS doc_id", "'some words' AS text"), queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert sum(r.n for r in rows.mapInArrow(alive, "n long").collect()) > 0
    assert sum(r.n for r in rows.mapInArrow(arrays.lean(alive), "n long").collect()) == 0
