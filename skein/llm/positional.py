"""Benchmark decontamination with a distributed positional inverted index.

Training texts are indexed in segments. A segment lays its documents' words out on one
axis, with a gap between documents, and stores the dictionary of its terms (hashes), where
each term's postings begin, and the postings: positions on that axis. Segments are rows of
a table in the shared folder; nothing is shuffled, as in any document-partitioned index.

A query window (``width`` consecutive test words) is answered from its rarest term: each
posting proposes a start, and the other terms' lists, from rare to frequent, are met with
their offsets taken off; what is left after all of them are exact phrase matches. Starts
that miss at most m terms and have the others near their place are proximity matches; as one
of any m + 1 terms must be there, the m + 1 rarest propose. Windows of fewer words may miss
fewer, in proportion. All windows of a block are intersected together, on arrays.

Test sets are made into windows by tasks and taken in blocks of bounded size, each broadcast
and met with all segments. A long item is spread over several blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrays import ALNUM, buffers, hash_spans, lean, slices, words
from skein.llm.rows import named
from skein.session import Scratch, ship_package

WIDTH = 10
BLOCK_WORDS = 2_000_000
SEGMENT_BYTES = 4 << 20
INDEX = "keys array<long>, texts array<long>, counts binary, begins binary, terms binary, lists binary, postings binary"


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = WIDTH) -> DataFrame:
    """The segments: document keys, hashes of their texts, word counts and first positions; terms, list ends, postings.

    A segment holds about ``SEGMENT_BYTES`` of text and at least one document, so that memory
    depends on neither the batch nor the partition. Null texts have no words. Keys are longs,
    repeated or null ones too: a document is a segment's row and its place in there.
    """
    ship_package(docs.sparkSession)

    def segment(rows: list[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]) -> dict:
        """``rows`` is used up; places are 32-bit numbers, as the postings are."""
        counts = np.concatenate([r[1] for r in rows])
        hashes = np.concatenate([r[2] for r in rows])
        keys = pa.concat_arrays([r[0] for r in rows]).to_pylist()
        texts = pa.concat_arrays([r[3] for r in rows]).to_pylist()
        rows.clear()
        begins = np.cumsum(counts + gap) - counts
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(hashes), 1), bool), hashes[1:] != hashes[:-1]]))
        terms, ends = hashes[first], np.append(first[1:], len(hashes)) if len(first) else first
        at = np.repeat((begins - np.cumsum(counts) + counts).astype("<u4"), counts)
        at += np.arange(len(at), dtype="<u4")
        return {"keys": keys, "texts": texts, "counts": counts.astype("<u4").tobytes(), "begins": begins.astype("<u4").tobytes(), "terms": terms.tobytes(), "lists": ends.astype("<u4").tobytes(), "postings": at[order].tobytes()}

    schema = pa.schema([("keys", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("counts", "begins", "terms", "lists", "postings"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = buffers(part.column(2))
                starts, ends, first = words(data, offsets, ALNUM)
                held.append((part.column(0), np.diff(first), hash_spans(data, starts, ends), part.column(1)))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([segment(held)], schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([segment(held)], schema)

    return named(docs, key, text).mapInArrow(lean(run), INDEX)


class Segment:
    """One row of the index, with one sorted array of (term, position) for all look-ups."""

    def __init__(self, row: dict):
        self.keys, self.texts = pa.array(row["keys"], pa.int64()), pa.array(row["texts"], pa.int64())
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.begins = np.frombuffer(row["begins"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.ends = np.frombuffer(row["lists"], "<u4").astype(np.int64)
        self.lengths = np.diff(self.ends, prepend=0)
        self.postings = np.frombuffer(row["postings"], "<u4")
        self.pairs = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.lengths) | self.postings

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the dictionary, -1 if no document has the term."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term has a posting in [low, high]."""
        base = term << 32
        a = np.searchsorted(self.pairs, base + np.maximum(low, 0), side="left")
        return (term >= 0) & (a < len(self.pairs)) & (self.pairs[np.minimum(a, len(self.pairs) - 1)] <= base + high)


class Windows:
    """A block of test items as windows: hashes by place (0 beyond a short one), lengths, owning items."""

    def __init__(self, grid: np.ndarray, owner: np.ndarray):
        self.grid, self.owner = grid, owner
        self.length = (grid != 0).sum(axis=1)

    @classmethod
    def of(cls, items: list[int], texts: list[str | None] | pa.Array, width: int = WIDTH, most: int = BLOCK_WORDS) -> Iterator[Windows]:
        """All windows of the items, ``most`` words of windows at a time."""
        data, offsets = buffers(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        starts, ends, first = words(data, offsets, ALNUM)
        hashes = np.maximum(hash_spans(data, starts, ends), np.uint64(1))
        n = np.diff(first)
        k = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        last = np.cumsum(k)
        for lo in range(0, int(last[-1]) if len(k) else 0, max(1, most // width)):
            nth = np.arange(lo, min(lo + max(1, most // width), int(last[-1])))
            item = np.searchsorted(last, nth, side="right")
            at = (nth - (last - k)[item] + first[item])[:, None] + np.arange(width)
            grid = np.where(at < first[item + 1][:, None], hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
            yield cls(grid, np.asarray(items, np.int64)[item])


def search(segment: Segment, windows: Windows, slop: int = 0, misses: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches, each once. ``slop`` and ``misses`` 0: exact phrases; else each
    term may stand ``slop`` from its place, and ``misses`` terms of a full window may be missing,
    of a shorter one as many less in proportion.
    """
    none = np.zeros(0, np.int64)
    if not len(windows.grid) or not len(segment.pairs):
        return none, none
    rank = segment.rank(windows.grid)
    real = windows.grid != 0
    rank[~real] = -1
    often = np.where(real, np.where(rank >= 0, segment.lengths[np.maximum(rank, 0)], 0), np.iinfo(np.int64).max)
    present = np.where(real & (rank < 0), np.iinfo(np.int64).max - 1, often)
    order = np.argsort(present, axis=1, kind="stable")
    absent = (real & (rank < 0)).sum(axis=1)
    allowed = windows.length * misses // windows.grid.shape[1]
    alive = np.flatnonzero((absent <= allowed) & (absent < windows.length))
    out_window, out_start = [], []
    leads = np.minimum(allowed[alive] - absent[alive] + 1, windows.length[alive] - absent[alive])  # the absent ones are missed anyway
    nth = np.arange(int(leads.sum())) - np.repeat(np.cumsum(leads) - leads, leads)
    alive = np.repeat(alive, leads)
    lead = order[alive, nth]
    sizes = segment.lengths[rank[alive, lead]]
    edge = np.cumsum(sizes)

    def kept(window: np.ndarray, start: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        missed = np.zeros(len(window), np.int64)
        for k in range(windows.grid.shape[1]):
            place = order[window, k]
            checked = real[window, place]
            term, target = rank[window, place], start + place
            missed += checked & ~segment.holds(term, target - reach, target + reach)
            keep = (missed <= allowed[window]) & (missed < windows.length[window])
            window, start, missed = window[keep], start[keep], missed[keep]
            if not len(window):
                break
        return window, start

    at = 0
    while at < len(alive):  # a bounded number of proposals at a time
        base = edge[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(edge, base + 250_000)))
        chosen, n = alive[at:to], sizes[at:to]
        window = np.repeat(chosen, n)
        first = segment.ends[rank[chosen, lead[at:to]]] - n
        posting = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        start = segment.postings[posting].astype(np.int64) - np.repeat(lead[at:to], n)
        window, start = kept(window, start, 2 * slop)  # the lead may itself stand ``slop`` from its place
        if slop and len(window):
            pairs = np.unique(np.stack([np.repeat(window, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()], axis=1), axis=0)
            window, start = kept(pairs[:, 0], pairs[:, 1], slop)
        out_window.append(window)
        out_start.append(start)
        at = to
    if not out_window:
        return none, none
    window, start = np.concatenate(out_window), np.concatenate(out_start)
    if slop or misses:
        window, start = np.unique(np.stack([window, start], axis=1), axis=0).T
    return window, start


MATCH = "segment long, place int, doc_id long, text_hash long, n_words long, runs array<struct<start:long,stop:long>>, items array<long>, near array<long>"
_MATCH = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])


def matches(number: int, segment: Segment, windows: Windows, slop: int, misses: int) -> pa.RecordBatch:
    """A row for each document: the merged runs of words inside exact matches, and the items of both kinds."""
    window, start = search(segment, windows)
    loose, near = search(segment, windows, slop, misses) if slop or misses else (window, start)
    n = len(segment.keys)
    doc = np.searchsorted(segment.begins, start, side="right") - 1
    size = int(segment.begins[-1] + segment.counts[-1]) + 1 if n else 1
    step = np.zeros(size + WIDTH + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + windows.length[window], -1)
    inside = np.cumsum(step) > 0
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    low, high = change[::2], change[1::2]
    run_doc = np.searchsorted(segment.begins, low, side="right") - 1

    def lists(owner: np.ndarray, item: np.ndarray) -> pa.ListArray:
        pairs = np.unique(np.stack([owner, item], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs[:, 1], pa.int64()))

    shift = segment.begins[run_doc] if len(run_doc) else run_doc
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(run_doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(low - shift, pa.int64()), pa.array(high - shift, pa.int64())], ["start", "stop"])
    )
    near_doc = np.clip(np.searchsorted(segment.begins, near + WIDTH // 2, side="right") - 1, 0, max(n - 1, 0))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), segment.keys, segment.texts, pa.array(segment.counts), runs, lists(doc, windows.owner[window]), lists(near_doc, windows.owner[loose])], schema=_MATCH)


def window_rows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(grid, owner) of the windows of all items, ``BLOCK_WORDS`` words at most in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for w in Windows.of(part.column(0).to_numpy(), part.column(1)):
                    yield pa.RecordBatch.from_pydict({"grid": pa.array([w.grid.tobytes()], pa.binary()), "owner": pa.array([w.owner.tobytes()], pa.binary())})

    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text"))
    return rows.filter("item IS NOT NULL AND text IS NOT NULL").mapInArrow(lean(run), "grid binary, owner binary")


def blocks(rows: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The windows, rows put together to blocks of about ``limit`` words; only one is on the driver at a time."""
    grids, owners, held = [], [], 0

    def block() -> Windows:
        return Windows(np.concatenate([np.zeros((0, WIDTH), np.uint64), *grids]), np.concatenate([np.zeros(0, np.int64), *owners]))

    for row in rows.toLocalIterator():
        grids.append(np.frombuffer(row.grid, "<u8").reshape(-1, WIDTH))
        owners.append(np.frombuffer(row.owner, "<i8"))
        held += grids[-1].size
        if held >= limit:
            yield block()
            grids, owners, held = [], [], 0
    if held:
        yield block()


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int = 3, misses: int = 2) -> DataFrame:
    """For each row: doc_id, text_hash, n_words, the runs of words hit, the items matched exactly and by proximity.

    Null texts have no words; items without words or without an id match nothing; repeated items
    count once by id. Rows are told apart by their place in the index, whatever their keys, however
    many blocks (of 2 million words of windows) the items make. The index is written once to the
    shared folder; documents are never shuffled. After each block has met all segments, what
    was found for a row is put together; rows without a match in a block don't take part.
    """
    ship_package(spark)
    scratch = Scratch(spark, "index")
    segments = scratch.table(index(docs, key, text).withColumn("segment", F.monotonically_increasing_id()), "segments")
    windows = scratch.table(window_rows(benchmark, item, item_text), "windows")
    found: list[DataFrame] = []
    for block in blocks(windows):
        sent = spark.sparkContext.broadcast((block.grid, block.owner))
        found.append(scratch.table(segments.mapInArrow(lean(_searcher(sent, slop, misses, len(found) > 0)), MATCH), "block"))
        sent.destroy()
    if not found:
        none = spark.sparkContext.broadcast((np.zeros((0, WIDTH), np.uint64), np.zeros(0, np.int64)))
        found.append(scratch.table(segments.mapInArrow(lean(_searcher(none, slop, misses, False)), MATCH), "block"))
    scratch.drop(segments, windows)
    first, *rest = found
    if not rest:
        return first.drop("segment", "place")
    lists = ("runs", "items", "near")
    more = functools.reduce(DataFrame.unionByName, [f.select("segment", "place", *lists) for f in rest])
    more = more.groupBy("segment", "place").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in lists))
    joined = first.join(more, ["segment", "place"], "left")
    return joined.select("doc_id", "text_hash", "n_words", *(F.array_sort(F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(first.schema[c].dataType))))).alias(c) for c in lists))


def _searcher(sent, slop: int, misses: int, only_found: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = matches(row["segment"], Segment(row), windows, slop, misses)
                if only_found:
                    some = np.zeros(out.num_rows, bool)
                    for c in ("runs", "items", "near"):
                        some |= np.diff(out.column(out.schema.get_field_index(c)).offsets.to_numpy()) > 0
                    out = out.filter(pa.array(some))
                yield out

    return run


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items of each document. Runs may overlap if blocks were many."""
    hit = "aggregate(runs, struct(0L AS hit, 0L AS to), (a, r) -> struct(a.hit + greatest(0L, r.stop - greatest(r.start, a.to)) AS hit, greatest(a.to, r.stop) AS to), a -> a.hit)"
    return found.selectExpr("doc_id", "n_words", f"{hit} AS n_hit", "cast(size(items) AS long) AS n_items", "sha2(array_join(array_sort(transform(items, i -> cast(i AS string))), ','), 256) AS items_sha256", "cast(size(near) AS long) AS n_near").selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0 AS contaminated", "n_near"
    )


