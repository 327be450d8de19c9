"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout (the public zstandard seekable format, version 0.1, with one addition):

* one frame for each document, its ids as little-endian unsigned 32-bit integers; any
  zstandard reader can decompress the file as a whole;
* a skippable frame (magic 0x184D2A50) with the document ids as little-endian signed
  64-bit integers, in frame order, so that a file describes itself;
* the seek table, a skippable frame (magic 0x184D2A5E): for each frame its compressed
  size, its decompressed size and the low 32 bits of the XXH64 of its content; then the
  number of frames, the descriptor (bit 7: checksums) and the magic 0x8F92EAB1.

``Reader.get`` fetches and decompresses only the frames asked for and checks their sums.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrays import KEPT, lean
from skein.llm.automaton import byte_symbols, library_words, unassigned
from skein.session import Scratch, ship_package

SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 0
MAX_WORDS = 800_000
LEAST_FILE, FILE_BYTES = 8 << 20, 128 << 20
READ_IDS = 1 << 22
MOST_TASKS = 100_000
NO_KEY = -(1 << 63)
#: GPT-2's pre-split pattern, a fixed value of the byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for the standard library's faster engine, whose classes differ from
#: Unicode's letters, numbers and blanks only where ``ODD`` finds something.
PLAIN = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = "[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]"


class Corrupt(ValueError):
    """A frame's content doesn't match its checksum, or a file's frame is malformed."""


class Writer:
    """Appends one frame for each document to an open binary stream."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.codec = sink, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.keys = bytearray(), []

    def add(self, key: int, ids: bytes) -> None:
        frame = self.codec.compress(ids)
        self.sink.write(frame)
        self.keys.append(key)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)

    def close(self) -> None:
        keys = np.array(self.keys, "<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(keys)) + keys)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(self.table) + 9) + self.table + struct.pack("<IBI", len(self.keys), 0x80, SEEK_MAGIC))


class Reader:
    """Random access by document through the seek table of a seekable file object."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        if size < 17:
            raise Corrupt("no seek table")
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != 0x80 or size < 25 + 20 * n:
            raise Corrupt("no seek table")
        at = size - 17 - 12 * n
        source.seek(at)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise Corrupt("seek table")
        self.sizes = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        source.seek(at - 8 - 8 * n)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_IDS, 8 * n):
            raise Corrupt("document ids")
        self.keys = np.frombuffer(source.read(8 * n), "<i8")
        self.begin = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)])
        self.codec = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.keys)

    def frame(self, i: int) -> bytes:
        self.source.seek(int(self.begin[i]))
        packed = self.source.read(int(self.sizes[i, 0]))
        try:
            ids = self.codec.decompress(packed, max_output_size=int(self.sizes[i, 1]))
        except zstandard.ZstdError as e:
            raise Corrupt(f"frame {i}: {e}") from e
        if len(ids) != self.sizes[i, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sizes[i, 2]:
            raise Corrupt(f"frame {i}: checksum")
        return ids

    def get(self, keys: list[int]) -> dict[int, np.ndarray]:
        """Ids of the documents asked for that the file holds; no other frame is touched."""
        return {int(self.keys[i]): np.frombuffer(self.frame(int(i)), "<u4") for i in np.flatnonzero(np.isin(self.keys, keys))}


def byte_level_encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids by the tokenizers library, each distinct pre-split word encoded once.

    The pattern is the pre-split of the vocabulary itself, so a word alone gets the ids
    that it gets inside a text. Texts with an added token's string go to the library whole.
    """
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    split, plain, odd = regex.compile(BYTE_LEVEL).findall, re.compile(PLAIN).findall, re.compile(ODD).search
    symbols = dict(enumerate(byte_symbols()))
    tokenize = library.model.tokenize

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= MAX_WORDS:
                self.clear()
            found = tokenize(word.encode().decode("latin-1").translate(symbols))
            ids = self[word] = np.array([t.id for t in found], "<u4").tobytes()
            return ids

    known = Known().__getitem__

    def encode(text: str) -> bytes:
        if any(t in text for t in added):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not odd(text):
            return b"".join(map(known, plain(text)))
        return b"".join(map(known, library_words(library.pre_tokenizer, text) if unassigned()(text) else split(text)))

    return encode


_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """One encoder for each Python worker; its words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = byte_level_encoder(path)
    KEPT["encoder"] = _ENCODERS.clear
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, partitions: int, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """Encode each text and write the files; a row (path, first, last, n_docs, n_tokens, n_bytes) for each file.

    Documents are range-partitioned by ``key`` and sorted, so that files in the order of
    their first and last key hold ascending keys. A file's name is unique to the attempt that
    wrote it: a lost or repeated task leaves a file that no row names. Null text is
    encoded as empty; every document gets the end id, so no frame is empty. Documents
    with equal keys stand side by side, in the order of a hash of their text, in as many
    files as they need; those with a null key come first, and stand in the files under the
    smallest long, which is no key's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        writer = sink = None
        first, tokens = 0, 0
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/{uuid.uuid4().hex}.zst"
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    writer, first = Writer(sink, level), k
                ids = encode(t.as_py() or "") + end
                tokens += len(ids) // 4
                writer.add(k, ids)
        if writer is not None:
            writer.close()
            n = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path.rpartition("/")[2], "first": first, "last": writer.keys[-1], "n_docs": len(writer.keys), "n_tokens": tokens, "n_bytes": n}])

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("k"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    spread = rows.repartitionByRange(partitions, "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return spread.mapInArrow(lean(run, "encoder"), "path string, first long, last long, n_docs long, n_tokens long, n_bytes long")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """A row (doc_id, start, n_tokens, ids) for each document, from the files that the rows name.

    ``start`` counts the ids of all documents before it: the files' totals are summed over
    the manifest, which has one row for each file, and each file adds its own offsets. The
    manifest's rows are cut into stretches of about ``READ_IDS`` ids, and these are dealt to as
    many tasks as there are stretches: a task reads seek tables and the frames of its stretches.
    """
    before = files.selectExpr("path", "n_docs", "n_tokens", "coalesce(sum(n_tokens) OVER (ORDER BY first, last, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    parts = before.selectExpr("path", "before", f"explode(sequence(0L, (n_tokens - 1) div {READ_IDS})) AS part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['path']}") as source:
                    reader = Reader(source)
                    counts = reader.sizes[:, 1].astype(np.int64) // 4
                    inside = np.cumsum(counts) - counts
                    i, stop = (int(x) for x in np.searchsorted(inside, [row["part"] * READ_IDS, (row["part"] + 1) * READ_IDS]))
                    while i < stop:
                        j = min(stop, max(i + 1, int(np.searchsorted(inside, inside[i] + (1 << 20)))))
                        ids = [reader.frame(x) for x in range(i, j)]
                        keys = pa.array(reader.keys[i:j], mask=reader.keys[i:j] == NO_KEY)
                        yield pa.RecordBatch.from_pydict({"doc_id": keys, "start": pa.array(inside[i:j] + row["before"]), "n_tokens": pa.array(counts[i:j]), "ids": pa.array(ids, pa.binary())})
                        i = j

    n = files.agg(F.sum(F.expr(f"(n_tokens - 1) div {READ_IDS} + 1"))).first()[0] or 1
    spread = parts.repartition(min(int(n), MOST_TASKS), F.xxhash64("path", "part"))  # a given number isn't coalesced
    return spread.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, partitions: int | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """Write the files; their manifest (written, so it is fixed) and their folder, by default one in the
    shared folder. A file holds about ``FILE_BYTES`` of text at most, less where that gives every
    shuffle partition one of ``LEAST_FILE``.
    """
    ship_package(spark)
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("files")
    if not partitions:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
        partitions = max(1, -(-size // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_FILE)))
    return scratch.table(write_tokens(docs, tokenizer, folder, partitions, text=text), "manifest"), folder


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids' bytes."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


