"""N-gram Jaccard self-join with count-vector R-trees.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with the same
set are one class from the start. For each class the shingles are counted by hash group:
a point with ``GROUPS`` coordinates. The summed coordinate minima of two points bound the
overlap of their sets from above, and the minima against the corner of a bounding box
bound it for all points in the box: that is how the R-tree of a block is searched.

Blocks come from prefix filtering: under one order of all shingles (rare before frequent,
then by hash) two sets with Jaccard similarity t or more share a shingle among the first
``n - ceil(t n) + 1`` of each. A block holds the classes that have one such shingle. Blocks
with the same members are kept once. The order is exact for frequent shingles, which are
counted over all documents, so that common passages end up outside the prefixes.

Links are verified on the sets themselves. Only components are asked for, so pairs that
are connected already need no check: the first round links members of a block to its most
central members; later rounds take what the R-trees still find between components, best
bounds first, and widen until nothing is left unchecked. No link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrays import NOT_BLANK, bounds, buffers, distinct_by_owner, hash_spans, lean, mix, shingles, slices, words
from skein.llm.components import components, joined_further, lookup
from skein.llm.rows import are_wanted, keys, named, once, same, wanted_bits
from skein.operators.parts import in_parts
from skein.session import Scratch, ship_package

GROUPS = 256
LEAF, FANOUT = 32, 8
LEADERS = 256
PART = 20_000
FREQUENT = 16
MOST_FREQUENT = 1_000_000


def document_sets(column: pa.Array, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts of a column, and where each text's begin."""
    data, offsets = buffers(column)
    starts, ends, first = words(data, offsets, NOT_BLANK)
    values, owner = distinct_by_owner(*shingles(hash_spans(data, starts, ends, seed=seed), first, width))
    return values, bounds(owner, len(offsets) - 1)


def class_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order; empty sets get 0."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(values + np.uint64(0x51)), first[:-1][full]) + counts[full].astype(np.uint64))
    return out


def group_counts(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The point of each set: its shingles by hash group (uint16, saturated; see ``overlap``)."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    flat = np.bincount(owner * GROUPS + (values >> np.uint64(56)).astype(np.int64) % GROUPS, minlength=n * GROUPS)
    return np.minimum(flat, 65535).astype("<u2").reshape(n, GROUPS)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap that sets of these sizes need: 100 I >= percent (a + b - I)."""
    return -(-(percent * (a + b)) // (100 + percent))


def overlap(points: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of each point with ``corner``. A saturated coordinate could only
    hide a count over 65535 where both have one; sets that large in one of 256 groups are taken
    as unbounded there.
    """
    least = np.minimum(points, corner)
    total = least.sum(axis=-1, dtype=np.int64)
    if least.size and int(least.max()) == 65535:
        total = np.where((least == 65535).any(axis=-1), np.iinfo(np.int64).max, total)
    return total


class RTree:
    """Bulk-loaded over (size, point): leaves of ``LEAF`` points in the order of size and of the
    coordinates that vary most, boxes as (largest coordinates, smallest size), ``FANOUT`` to a node.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, component: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:3] if len(points) else np.zeros(0, np.int64)
        order = np.lexsort((*(points[:, k] for k in spread[::-1]), sizes))
        tile = max(LEAF, int(math.sqrt(len(order) * LEAF)))
        order = np.concatenate([part[np.lexsort((sizes[part], *(points[part, k] for k in spread[::-1])))] for part in np.split(order, range(tile, len(order), tile))]) if len(order) else order
        self.order, self.sizes, self.points, self.component = order, sizes, points, component
        cuts = list(range(0, len(order), LEAF))
        self.levels = [[(a, min(a + LEAF, len(order))) for a in cuts]]
        self.corners = [np.array([points[order[a:b]].max(axis=0) for a, b in self.levels[0]])]
        self.smallest = [np.array([sizes[order[a:b]].min() for a, b in self.levels[0]])]
        self.alike = [np.array([self._one(component[order[a:b]]) for a, b in self.levels[0]])]
        while len(self.levels[-1]) > 1:
            below = len(self.levels[-1])
            spans = [(a, min(a + FANOUT, below)) for a in range(0, below, FANOUT)]
            self.levels.append(spans)
            self.corners.append(np.array([self.corners[-1][a:b].max(axis=0) for a, b in spans]))
            self.smallest.append(np.array([self.smallest[-1][a:b].min() for a, b in spans]))
            self.alike.append(np.array([self._one(self.alike[-1][a:b]) for a, b in spans]))

    @staticmethod
    def _one(values: np.ndarray) -> int:
        """The component that all have, -1 if there are several."""
        return int(values[0]) if (values == values[0]).all() else -1

    def search(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points of other components whose bound with point i suffices, and their bounds."""
        point, size, own = self.points[i], int(self.sizes[i]), self.component[i]
        nodes = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            ok = (overlap(self.corners[depth][nodes], point) >= needed(self.smallest[depth][nodes], size, percent)) & (self.alike[depth][nodes] != own)
            nodes = nodes[ok]
            if not len(nodes):
                return nodes, nodes
            spans = [self.levels[depth][k] for k in nodes]
            nodes = np.concatenate([np.arange(a, b) for a, b in spans])
        found = self.order[nodes]
        found = found[self.component[found] != own]
        bound = overlap(self.points[found], point)
        ok = bound >= needed(self.sizes[found], size, percent)
        return found[ok], bound[ok]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n (set size), cls (hash of the set), point of each row (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = document_sets(part.column(2), width)
                points = group_counts(values, first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(class_ids(values, first).view(np.int64)), pa.array([p.tobytes() for p in points], pa.binary())], ["doc_id", "text_hash", "n", "cls", "point"]
                )

    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, n long, cls long, point binary")


def new_sets(part: pa.RecordBatch, width: int, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, owners and class ids of the sets that this task hasn't met; owners count from 0."""
    values, first = document_sets(part.column(part.num_columns - 1), width)
    ids = class_ids(values, first)
    keep = np.zeros(len(ids), bool)
    for i, c in enumerate(ids.tolist()):
        if c not in seen and first[i + 1] > first[i]:
            keep[i] = True
            seen.add(c)
    if len(seen) > 300_000:
        seen.clear()
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    mask = keep[owner]
    place = np.cumsum(keep) - 1
    return values[mask], place[owner[mask]], ids[keep]


def frequent_shingles(docs: DataFrame, width: int, total: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles (without their last bits) in the most classes, how often, and the bits left out.

    Counted over all documents, a class once for each task that meets it. Hashes travel
    packed, 4 bytes each, in buckets of about two million. The ``MOST_FREQUENT`` at most that
    are sent to the driver are a bound on memory only: any order of shingles gives the same links.
    """
    bits = min(24, max(8, math.ceil(math.log2(max(total, 1) / (1 << 21) + 1))))
    shift = 32 - bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held) >> np.uint64(shift))
            bucket = (t >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            parts = np.split(t.astype("<u4"), cut)
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cut])] if len(t) else bucket, pa.int64()), pa.array([p.tobytes() for p in parts] if len(t) else [], pa.binary())], ["bucket", "hashes"])

        for batch in batches:
            for part in slices(batch, "text"):
                values, _, _ = new_sets(part, width, seen)
                held.append(values)
                size += len(values)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array((values[often].astype(np.int64) | (bucket << 32))), pa.array(n[often])], ["shingle", "df"])

        for batch in batches:
            for b, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if held:
                        yield flush()
                    bucket, held = b, []
                held.append(np.frombuffer(h.as_py(), "<u4"))
        if held:
            yield flush()

    packed = docs.mapInArrow(lean(pack), "bucket long, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    table = scratch.table(packed.mapInArrow(lean(count), "shingle long, df long"), "frequent")
    classes = table.groupBy(F.expr("cast(floor(log2(df)) AS int) AS level")).count().orderBy(F.desc("level")).collect()
    kept, level = 0, 64
    for r in classes:
        if kept + r["count"] > MOST_FREQUENT:
            break
        kept, level = kept + r["count"], r["level"]
    rows = table.filter(f"df >= {1 << min(level, 62)}").toPandas()
    order = np.argsort(rows["shingle"].to_numpy())
    scratch.drop(table)
    return rows["shingle"].to_numpy()[order].astype(np.uint64), rows["df"].to_numpy()[order].astype(np.int64), shift


def prefixes(docs: DataFrame, width: int, percent: int, sent) -> DataFrame:
    """(token, cls) for the shingles in the prefix of each class; a class once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, shift = sent.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                values, owner, ids = new_sets(part, width, seen)
                df = np.zeros(len(values), np.int64)
                if len(known) and len(values):
                    short = values >> np.uint64(shift)
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    df = np.where(known[at] == short, often[at], 0)
                first = bounds(owner, len(ids))
                n = np.diff(first)
                limit = n - -(-percent * n // 100) + 1
                place = np.arange(len(values))
                for i in np.unique(owner[df > 0]).tolist():  # the rest is in order already
                    a, b = first[i], first[i + 1]
                    place[a:b] = a + np.argsort(df[a:b], kind="stable")
                inside = np.arange(len(values)) - np.repeat(first[:-1], n) < np.repeat(limit, n)
                chosen = place[inside]
                yield pa.RecordBatch.from_arrays([pa.array(values[chosen].view(np.int64)), pa.array(ids[owner[chosen]].view(np.int64))], ["token", "cls"])

    return docs.mapInArrow(lean(run), "token long, cls long")


def blocks(tokens: DataFrame) -> DataFrame:
    """(digest, token, cls) of the tokens that two classes or more have; the digest is of all members.

    Rows stream past in the order of their token alone, which is a radix sort. Only a run that
    lies across two Arrow batches is held, two million rows of it at most; a longer one goes on
    under its own digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, cls = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        long_run: int | None = None
        done: set[int] = set()

        def emit(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch | None:
            alone = np.ones(len(t), bool)
            alone[1:] &= t[1:] != t[:-1]
            alone[:-1] &= t[1:] != t[:-1]
            if long_run is not None:
                alone &= t != np.uint64(long_run)
            t, c = t[~alone], c[~alone]
            order = np.lexsort((c, t))
            t, c = t[order], c[order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c = t[fresh], c[fresh]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(t)))
            digest = mix(np.add.reduceat(mix(c), begin) + size.astype(np.uint64)) if len(t) else begin.astype(np.uint64)
            keep = size > 1
            if long_run is not None:
                going_on = t[begin] == np.uint64(long_run)
                keep |= going_on
                digest[going_on] = long_run
            for i in np.flatnonzero(keep).tolist():
                d = int(digest[i])
                if d != long_run and d in done:
                    keep[i] = False
                elif len(done) < 500_000:
                    done.add(d)
            rows = np.repeat(keep, size)
            if not rows.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(digest, size)[rows].view(np.int64)), pa.array(t[rows].view(np.int64)), pa.array(c[rows].view(np.int64))], ["digest", "token", "cls"])

        for batch in batches:
            token = np.concatenate([token, batch.column(0).to_numpy().view(np.uint64)])
            cls = np.concatenate([cls, batch.column(1).to_numpy().view(np.uint64)])
            if not len(token):
                continue
            last = int(np.flatnonzero(token != token[-1])[-1]) + 1 if (token != token[-1]).any() else 0
            if not last and len(token) > 2_000_000:
                long_run, last = int(token[-1]), len(token) - 1
            if last and (out := emit(token[:last], cls[:last])) is not None:
                yield out
            token, cls = token[last:], cls[last:]
        if len(token) and (out := emit(token, cls)) is not None:
            yield out

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(lean(run), "digest long, token long, cls long")


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates of the first round: each member with the first leader of its block that its bound allows.

    Members come in the order of their centrality (how much of their prefix they share). One
    that no leader takes is a leader itself; a block keeps ``LEADERS`` of them and members stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, have = None, 0
        ids, sizes, leaders = [0] * LEADERS, np.zeros(LEADERS, np.int64), np.zeros((LEADERS, GROUPS), "<u2")
        for batch in batches:
            token, node, n = (batch.column(k).to_pylist() for k in (0, 1, 2))
            out_a, out_b = [], []
            for i, raw in enumerate(batch.column(3)):
                point = np.frombuffer(raw.as_py(), "<u2")
                if token[i] != current:
                    current, have = token[i], 0
                fit = np.flatnonzero(overlap(leaders[:have], point) >= needed(sizes[:have], n[i], percent))
                if len(fit):
                    out_a.append(ids[fit[0]])
                    out_b.append(node[i])
                elif have < LEADERS:
                    ids[have], sizes[have], leaders[have] = node[i], n[i], point
                    have += 1
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    sorted_rows = members.repartition("token").sortWithinPartitions("token", F.desc("central"), "node")
    return sorted_rows.select("token", "node", "n", "point").mapInArrow(lean(run), "a long, b long").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").filter("a < b").distinct()


def later_pairs(members: DataFrame, percent: int, width: int, part: int | None = None) -> DataFrame:
    """(a, b, token) candidates between components that the R-tree of a block finds.

    Of each point's candidates in one other component the ``width`` with the best bounds; if
    that left some, the block's token is set, for a wider round. A block without is done with:
    components only grow. A pair is given in the block of the smallest token that both have. Of blocks
    with more than ``part`` members any two parts meet in a task.
    """

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int, int | None]]:
        token = rows[0][0][0]
        node = np.array([r[1] for r in rows])
        size = np.array([r[2] for r in rows])
        grid = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(-1, GROUPS)
        comp = np.unique(np.array([r[4] for r in rows]), return_inverse=True)[1]
        own = [r[5] for r in rows]
        tree = RTree(size, grid, comp)
        for i in range(len(rows)):
            found, bound = tree.search(i, percent)
            below = comp[found] < comp[i]
            found, bound = found[below], bound[below]
            if not len(found):
                continue
            score = bound / (size[found] + size[i] - np.minimum(bound, size[found]) + 1)
            taken: dict[int, int] = {}
            for k in np.lexsort((node[found], -score)):
                j = int(found[k])
                if min(own[i] & own[j]) != token:
                    continue
                have = taken.get(int(comp[j]), 0)
                if have <= width:
                    taken[int(comp[j])] = have + 1
                    yield int(node[i]), int(node[j]), token if have == width else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            got = list(pairs(held)) if len({r[4] for r in held}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["a", "b", "token"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = ((row[0], row[6]), *row[1:5], frozenset(row[5]))
                if held and held[0][0] != row[0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    sorted_rows = in_parts(members, part or PART).repartition("token", "part").sortWithinPartitions("token", "part", "node")
    return sorted_rows.select("token", "node", "n", "point", "component", "tokens", "part").mapInArrow(lean(run), "a long, b long, token long")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, repeated: bool = True) -> DataFrame:
    """(a, b, linked), a written table: the exact decision on the words of both texts, whole, under another hash.

    ``nodes`` (node, doc_id, text_hash) tell which row stands for a class; where rows of equal key
    and text are ``repeated``, one of them is taken. Texts that aren't asked for stop at a
    bitmap of fixed size, so that only sets that are compared are shuffled.
    """
    asked = scratch.table(nodes.join(pairs.selectExpr("explode(array(a, b)) AS node").distinct(), "node"), "nodes-asked")
    sent = docs.sparkSession.sparkContext.broadcast(wanted_bits(asked.selectExpr("text_hash AS node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(are_wanted(sent.value, batch.column(1).to_numpy().view(np.uint64))))
            for part in slices(batch, "text"):
                values, first = document_sets(part.column(2), width, seed=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["doc_id", "text_hash", "shingles"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    known = docs.select("doc_id", "text_hash", "text").mapInArrow(lean(sets), "doc_id long, text_hash long, shingles binary")
    have = known.join(keys(asked, "node"), F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash"))).select("node", "shingles")
    have = have.dropDuplicates(["node"]) if repeated else have
    joined = pairs.join(have.selectExpr("node AS a", "shingles AS x"), "a").join(have.selectExpr("node AS b", "shingles AS y"), "b")
    out = scratch.table(joined.select("a", "b", "x", "y").mapInArrow(lean(decide), "a long, b long, linked boolean"), "decided")
    sent.destroy()
    scratch.drop(asked)
    return out


def link_components(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, stays) for each row: its set's size, the smallest key reachable
    by links, and whether it is the first of those rows (by key, null last, then text).

    Two documents link if 100 * overlap >= percent * union of their shingle sets. Null and
    blank texts have empty sets, are linked with nothing and stay. Rows are told apart even if
    their keys are equal or null; a group without any key has the component null. Rows with equal
    key and text are the first together. Intermediate tables are in the shared folder.
    """
    ship_package(spark)
    scratch = Scratch(spark, "ngram")
    docs = named(docs, key, text)
    sets = scratch.table(describe(docs, width), "sets")
    full = sets.filter("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("point").alias("point"), F.count("*").alias("rows"))
    classes = scratch.table(full.selectExpr("cls AS node", "row", "n", "point", "rows"), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bare = docs.select("text")
    sent = spark.sparkContext.broadcast(frequent_shingles(bare, width, total, scratch))
    found = scratch.table(blocks(prefixes(bare, width, percent, sent)), "blocks")
    sent.destroy()
    kept = found.join(found.groupBy("digest").agg(F.min("token").alias("token")), ["digest", "token"], "left_semi").select("token", "cls").distinct()
    tokens = kept.groupBy("cls").agg(F.collect_list("token").alias("tokens")).withColumnRenamed("cls", "node")
    nodes = scratch.table(classes.join(tokens, "node").selectExpr("node", "n", "point", "tokens", f"size(tokens) / (n - ceil({percent} * n / 100) + 1) AS central"), "nodes")
    scratch.drop(found)
    rows_of = classes.selectExpr("node", "row.doc_id", "row.text_hash")
    repeated = bool(sets.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count())
    members = nodes.select("*", F.explode("tokens").alias("token"))
    pairs = scratch.table(first_pairs(members, percent), "pairs")
    checked = verify(pairs, rows_of, docs, width, percent, scratch, repeated)
    scratch.drop(pairs)
    joined = components(spark, checked.filter("linked").select("a", "b"), scratch)
    reach, left = 8, None
    while True:
        labelled = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = labelled.select("node", "n", "point", "component", "tokens", F.explode("tokens").alias("token"))
        if left is not None:
            rows = rows.join(left, "token", "left_semi")
        split = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token")
        open_rows = scratch.table(rows.join(split, "token", "left_semi"), "open")
        asked = scratch.table(later_pairs(open_rows, percent, reach), "asked")
        scratch.drop(open_rows)
        left = asked.filter("token IS NOT NULL").select("token").distinct()
        fresh = asked.filter("token IS NULL").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.table(fresh, "pairs")
        if pairs.limit(1).count():
            more = verify(pairs, rows_of, docs, width, percent, scratch, repeated)
            joined = joined_further(spark, joined, more.filter("linked").select("a", "b"), scratch)
            after = scratch.table(checked.unionByName(more), "checked")
            scratch.drop(checked, more)
            checked = after
        scratch.drop(pairs)
        if not left.limit(1).count():
            break
        reach *= 8
    labelled = scratch.table(classes.join(joined, "node", "left").selectExpr("node", "coalesce(component, node) AS label", "row", "rows"), "labelled")
    firsts = scratch.table(labelled.groupBy("label").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts")
    told = scratch.table(lookup(labelled, firsts, "label").selectExpr("node AS cls", "first", "rows AS n"), "told")
    out = lookup(sets.filter("n > 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls"), told, "cls")
    out = out.selectExpr("doc_id", "text_hash", "n_shingles", "first.doc_id AS component_id", "doc_id <=> first.doc_id AND text_hash = first.text_hash AS stays")
    empty = sets.filter("n = 0").selectExpr("doc_id", "text_hash", "n AS n_shingles", "doc_id AS component_id", "true AS stays")
    result = scratch.table(out.unionByName(empty), "result")
    scratch.drop(sets, classes, nodes, checked, joined, labelled, firsts, told)
    return result


def keep_first(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, by what ``link_components`` found for them; texts without words all stay."""
    scratch = Scratch(docs.sparkSession, "kept")
    gone = scratch.table(found.filter("NOT stays").select("doc_id", "text_hash").distinct(), "gone")
    kept = docs.join(keys(gone), same(key, text), "left_anti")
    again = found.filter("stays AND n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    return once(kept, scratch.table(again.select("doc_id", "text_hash"), "again"), key, text)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")
