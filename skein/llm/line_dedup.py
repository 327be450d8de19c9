"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find.

A line's set is its distinct character shingles (``WIDTH`` code points; A-Z lower-cased,
blanks alike); a shorter line is like its equals only. Equal lines are one node from the
start. ``BANDS`` bands of ``ROWS`` minima bring together lines that may be similar: at the
threshold 0.75 two lines share a band with probability 0.99, at 0.85 with 0.9998. Buckets
with the same members are taken once. A task verifies on the sets of a bucket's lines as
many pairs as it takes to know the components among them, and gives a tree of verified links
for each. Buckets of more than ``PART`` bytes are cut into parts, and any two parts meet in
a task, so that memory is bounded and no pair is left out. Links of all buckets meet in the
distributed union-find. One line of each component stays: the first by document id, then line.

Blank lines hold no text and are never compared or removed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrays import LOWER, NOT_BLANK, bounds, buffers, distinct_by_owner, lean, mix, slices
from skein.llm.components import components, lookup
from skein.llm.ngram_join import blocks
from skein.llm.rows import are_wanted, keys, named, once, same, wanted_bits
from skein.operators.ordering import running
from skein.operators.parts import in_parts
from skein.session import Scratch, ship_package

WIDTH, BANDS, ROWS = 8, 12, 4
PERCENT = 75
PART = 4_000_000
FLUSH = 1_000_000
SMALL = 64
FOLD = LOWER.copy()
FOLD[9:14] = 32
_TABLE = FOLD.tobytes()
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (an empty text has one), and the first line of each text."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(int(first[-1]), np.int64)
    ends = np.empty(int(first[-1]), np.int64)
    head = np.zeros(int(first[-1]), bool)
    head[first[:-1]] = True
    tail = np.zeros(int(first[-1]), bool)
    tail[first[1:] - 1] = True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    return starts, ends, first


def characters(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (as their UTF-8 bytes in one number) of spans that follow one another, and where each span's begin."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(lead) == len(raw):
        return raw.astype(np.uint64), begin
    value = raw[lead].astype(np.uint64)
    size = np.diff(np.append(lead, len(raw)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        value[more] = value[more] << np.uint64(8) | raw[lead[more] + k]
    return value, np.searchsorted(lead, begin)


def line_shingles(lines: list[bytes], width: int = WIDTH, run: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each folded line (none if it is shorter than ``width``), and where each line's begin.

    Lines are taken in runs of about ``run`` bytes, so that only the hashes are held for all.
    """
    begin = np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)])
    out, counts = [], []
    i = 0
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + run, side="right")) - 1)
        h, first = characters(np.frombuffer(b"".join(lines[i:j]), np.uint8), begin[i : j + 1] - begin[i])
        step, size = 0x9E3779B97F4A7C15, 1
        while size < width:
            h[: max(0, len(h) - size)] += h[size:] * np.uint64(step)
            step, size = step * step % (1 << 64), 2 * size
        keep = np.ones(len(h), bool)
        for k in range(1, width):  # the last places of a line begin no shingle
            ends = first[1:] - k
            keep[ends[ends >= first[:-1]]] = False
        out.append(mix(h[keep]))
        counts.append(np.maximum(np.diff(first) - (width - 1), 0))
        i = j
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])


def band_keys(hashes: np.ndarray, first: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """(spans, BANDS) bucket keys of MinHash signatures; all spans must have a shingle.

    Spans are taken in runs whose shingles fit into the processor's cache.
    """
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((BANDS * ROWS, len(first) - 1), np.uint32)
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + block, side="right")) - 1)
        part, begin = short[first[i] : first[j]], first[i:j] - first[i]
        moved = np.empty_like(part)
        for r in range(BANDS * ROWS):
            np.multiply(part, _MUL[r], out=moved)
            np.minimum.reduceat(moved, begin, out=minima[r, i:j])
        i = j
    out = np.empty((len(first) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        one, two, three, four = minima[b * ROWS : (b + 1) * ROWS].astype(np.uint64)
        out[:, b] = mix(mix((one << np.uint64(32) | two) + np.uint64(b + 1)) + (three << np.uint64(32) | four))
    return out


class Lines:
    """The lines of a run of texts that aren't blank: folded, and their hashes; ``wide`` ones have shingles."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        starts, ends, first = line_spans(data, offsets)
        self.n_lines = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(first))
        seen = np.concatenate([[0], np.cumsum(NOT_BLANK[data], dtype=np.int32)])
        some = seen[ends] > seen[starts]
        number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
        self.number = number[some]
        self.first = np.concatenate([[0], np.cumsum(some)])[first]
        self.starts, self.ends = starts[some], ends[some]
        folded = data.tobytes().translate(_TABLE)
        self.lines = [folded[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.lines), np.uint64, len(self.lines))
        self.data = data

    def wide(self) -> np.ndarray:
        """Which lines have ``WIDTH`` code points or more."""
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int32)])
        return lead[self.ends] - lead[self.starts] >= WIDTH

    def new(self, seen: set[int]) -> np.ndarray:
        """Places of the distinct wide lines that this task hasn't met; they are met now."""
        distinct, where = np.unique(self.hashes, return_index=True)
        ok = self.wide()[where]
        where, distinct = where[ok], distinct[ok].tolist()
        out = where[np.fromiter((h not in seen for h in distinct), bool, len(distinct))]
        seen.update(distinct)
        if len(seen) > 250_000:
            seen.clear()
        return out


def number_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_lines, numbers, hashes, again) of each document: of its distinct lines the first
    place and the hash, and the places of those that stand earlier in the document. ``docs`` are (doc_id, text_hash, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = Lines(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(x.first))
                order = np.lexsort((x.hashes, owner))  # stable: equal lines of a text keep their order
                fresh = np.ones(len(order), bool)
                fresh[1:] = (x.hashes[order][1:] != x.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                firsts, again = order[fresh], np.sort(order[~fresh])
                at, more = (pa.array(bounds(owner[k], part.num_rows), pa.int32()) for k in (firsts, again))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(x.n_lines, pa.int64()), pa.ListArray.from_arrays(at, pa.array(x.number[firsts], pa.int32())), pa.ListArray.from_arrays(at, pa.array(x.hashes[firsts].view(np.int64))), pa.ListArray.from_arrays(more, pa.array(x.number[again], pa.int32()))],
                    ["doc_id", "text_hash", "n_lines", "numbers", "hashes", "again"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, n_lines long, numbers array<int>, hashes array<long>, again array<int>")


def line_buckets(docs: DataFrame) -> DataFrame:
    """(token, cls): the buckets of each distinct line of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = Lines(part.column("text"))
                new = x.new(seen)
                if len(new):
                    keys = band_keys(*line_shingles([x.lines[i] for i in new]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(x.hashes[new].view(np.int64), BANDS))], ["token", "cls"])

    return docs.mapInArrow(lean(run), "token long, cls long")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, size) of the lines asked for, folded: most others stop at the bitmap, the rest at the join."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = Lines(part.column("text"))
                new = x.new(seen)
                new = new[are_wanted(bits, x.hashes[new])]
                lines = pa.array([x.lines[i] for i in new], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x.hashes[new].view(np.int64)), lines], ["node", "text"])

    return docs.mapInArrow(lean(run), "node long, text binary").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text").cast("long"))


def bucket_links(values: np.ndarray, owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Verified links that connect what all verified links among ``n`` sets would connect.

    A set is expanded by counting its shingles in all others: in a small bucket by looking all
    shingles up in the set, in a larger one through inverted lists. Sets that no expansion has
    reached are expanded in turn; then all sets outside the largest component, so that no link
    between components can be left unseen.
    """
    if n == 2:
        both = pair_overlap(values)
        return [(0, 1)] if 100 * both >= PERCENT * (len(values) - both) else []
    begin = bounds(owner, n)
    size = np.diff(begin)
    counts = small_counts(values, owner, begin, n) if n <= SMALL else listed_counts(values, owner, begin, n)
    root = list(range(n))
    links: list[tuple[int, int]] = []
    expanded = np.zeros(n, bool)
    reached = np.zeros(n, bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def expand(i: int) -> None:
        expanded[i] = True
        both = counts(i)
        for j in np.flatnonzero(100 * both >= PERCENT * (size + size[i] - both)).tolist():
            reached[j] = True
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))

    for i in range(n):
        if not reached[i]:
            expand(i)
    label = [find(i) for i in range(n)]
    largest = Counter(label).most_common(1)[0][0]
    for i in range(n):
        if label[i] != largest and not expanded[i]:
            expand(i)
    return links


def pair_overlap(both: np.ndarray) -> int:
    """How many values two sets share that stand in ``both`` one after the other."""
    both = np.sort(both)
    return np.count_nonzero(both[1:] == both[:-1])


def small_counts(values: np.ndarray, owner: np.ndarray, begin: np.ndarray, n: int):
    def counts(i: int) -> np.ndarray:
        own = values[begin[i] : begin[i + 1]]
        found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        return np.bincount(owner[found], minlength=n)

    return counts


def listed_counts(values: np.ndarray, owner: np.ndarray, begin: np.ndarray, n: int):
    shingle = np.unique(values, return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    lists = owner[order]
    start = np.searchsorted(shingle[order], np.arange(int(shingle.max(initial=-1)) + 2))

    def counts(i: int) -> np.ndarray:
        own = shingle[begin[i] : begin[i + 1]]
        low, count = start[own], start[own + 1] - start[own]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return np.bincount(lists[at], minlength=n)

    return counts


def verified_links(members: DataFrame, texts: DataFrame, part: int | None = None) -> DataFrame:
    """(a, b): links of all buckets, from (token, node, size) and (node, text). A task holds one bucket, or two
    parts of a bucket of more than ``part`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token: list[int] = []
        node: list[int] = []
        text: list[bytes] = []

        def out(upto: int) -> pa.RecordBatch:
            hashes, first = line_shingles(text[:upto])
            values, owner = distinct_by_owner(hashes, np.repeat(np.arange(upto), np.diff(first)))
            at = bounds(owner, upto)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.array(token[:upto]))) + 1, [upto]])
            found = []
            many = np.diff(cuts) > 1
            for i, j in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist(), strict=True):
                own = slice(at[i], at[j])
                found += [(node[i + x], node[i + y]) for x, y in bucket_links(values[own], owner[own] - i, j - i)]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        size = 0
        for batch in batches:
            for part in slices(batch, "text", FLUSH):
                token += part.column(0).to_pylist()
                node += part.column(1).to_pylist()
                text += part.column(2).to_pylist()
                size += part.column(2).nbytes
                if size >= FLUSH and token[0] != token[-1]:
                    last = len(token) - 1
                    while token[last - 1] == token[-1]:
                        last -= 1
                    yield out(last)
                    del token[:last], node[:last], text[:last]
                    size = sum(map(len, text))
        if token:
            yield out(len(token))

    spread = in_parts(members, part or PART, weight="size").select(F.xxhash64("token", "part").alias("token"), "node").join(texts.select("node", "text"), "node").select("token", "node", "text")
    return spread.repartition("token").sortWithinPartitions("token").mapInArrow(lean(run), "a long, b long").distinct()


def line_components(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the distinct lines that are linked with another one; ``docs`` has the column text."""
    found = scratch.table(blocks(line_buckets(docs)), "blocks")
    kept = found.join(found.groupBy("digest").agg(F.min("token").alias("token")), ["digest", "token"], "left_semi")
    members = scratch.table(kept.selectExpr("token", "cls AS node").distinct(), "members")
    scratch.drop(found)
    texts = scratch.table(texts_of(docs, members.select("node").distinct()), "texts")
    sized = scratch.table(members.join(texts.select("node", "size"), "node"), "sized")
    links = scratch.table(verified_links(sized, texts), "links")
    scratch.drop(members, texts, sized)
    joined = components(spark, links, scratch)
    scratch.drop(links)
    return joined


def duplicate_lines(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, removed) for each row: its lines, and the numbers (from 0) of those that a line
    kept elsewhere, or earlier in the document, stands for.

    Null text has no lines; an empty text has one, a blank one. Rows are told apart even if their
    keys are equal or null: they are ordered by key (null last), then text, and all are returned.
    The result is a table in the shared folder.
    """
    ship_package(spark)
    scratch = Scratch(spark, "lines")
    docs = named(docs, key, text)
    numbered = scratch.table(number_lines(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("missing", F.col("doc_id").isNull()), "numbered")
    ordered = running(spark, numbered, ["missing", "doc_id", "text_hash", "row"], "n_lines")
    rows = scratch.table(ordered.select("row", "doc_id", "text_hash", "n_lines", "before", "numbers", "hashes", "again"), "ordered")
    scratch.drop(numbered, ordered)
    joined = line_components(spark, docs.select("text"), scratch)
    places = rows.selectExpr("row", "before", "explode(arrays_zip(numbers, hashes)) AS x").selectExpr("row", "before + x.numbers AS place", "x.hashes AS node", "x.numbers AS number")
    nodes = places.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("times"))
    repeated = scratch.table(nodes.join(joined, "node", "left").filter("times > 1 OR component IS NOT NULL").select("node", "first", "component"), "repeated")
    linked = repeated.filter("component IS NOT NULL")
    leaders = scratch.table(linked.groupBy("component").agg(F.min("first").alias("stays"), F.count("*").alias("n")), "leaders")
    decided = repeated.filter("component IS NULL").selectExpr("node", "first AS stays").unionByName(lookup(linked, leaders, "component").select("node", "stays"))
    gone = places.join(decided, "node").filter("place <> stays")
    lists = gone.groupBy("row").agg(F.collect_list("number").alias("more"))
    found = rows.select("row", "doc_id", "text_hash", "n_lines", "again").join(lists, "row", "left").selectExpr("doc_id", "text_hash", "n_lines", "array_sort(if(more IS NULL, again, concat(again, more))) AS removed")
    out = scratch.table(found, "found")
    scratch.drop(rows, repeated, leaders, joined)
    return out


def drop_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their removed lines; those of which nothing or only blank lines are left go.

    Documents that lose no line, null ones too, stay as they are. Of rows with equal key and
    text that lose lines, one stays at most. ``found`` is what ``duplicate_lines`` gave for ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "dropped")
    size = F.size("removed")
    lost = found.groupBy("doc_id", "text_hash").agg(F.min_by("removed", size).alias("__removed"), (F.max(size) > F.min(size)).alias("unlike")).filter("unlike OR size(__removed) > 0")
    lost = scratch.table(lost, "lost")
    kept = once(docs, scratch.table(lost.filter("unlike"), "unlike"), key, text)
    joined = kept.join(keys(lost.filter("size(__removed) > 0"), "__removed"), same(key, text), "left")
    rest = "array_except(sequence(0, size(lines) - 1), __removed)"  # a set operation: linear in the lines
    left = f"array_join(get(transform(array(split(`{text}`, '\n', -1)), lines -> transform({rest}, i -> get(lines, i))), 0), '\n')"
    out = joined.withColumn(text, F.when(F.col("__removed").isNull(), F.col(f"`{text}`")).otherwise(F.expr(left)))
    return out.filter(F.col("__removed").isNull() | F.col(f"`{text}`").rlike(r"(?U)\S")).drop("__key", "__hash", "__removed")


def digest(found: DataFrame) -> DataFrame:
    return found.selectExpr("doc_id", "n_lines", "cast(size(removed) AS long) AS n_removed", "array_join(transform(removed, x -> cast(x AS string)), ',') AS removed")
