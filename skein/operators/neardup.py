"""Duplicate detection: exact groups, shingles, MinHash, bands, verdicts, containment.

Signatures are made on Arrow batches: a word's hash is its CRC-32, found once for each distinct
word of a batch; a shingle's is a polynomial of its words' hashes modulo 2^64; a minimum is over
(a h + b) mod 2^61. Equal signatures are one class from the start, and only classes are banded.
Buckets of up to ``LARGEST`` classes propose all their pairs; in larger ones tasks verify
signatures themselves, part by part, and give links that connect the same classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.parts import in_parts
from skein.session import Scratch

WIDTH = 5
# The base of the shingle polynomial, the modulus and the seed of the permutations.
BASE = 1_000_003
MODULUS = 1 << 61
SEED = 1337
LARGEST = 200
PART = 4000


def coefficients(n: int) -> list[tuple[int, int]]:
    """The (a, b) of ``n`` permutations, drawn from numpy's default generator with the seed."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, MODULUS - 1, size=n, dtype=np.uint64)
    return list(zip(a.tolist(), rng.integers(0, MODULUS - 1, size=n, dtype=np.uint64).tolist(), strict=True))


def shingles(words: Column, width: int = WIDTH) -> Column:
    """Distinct runs of ``width`` words joined by blanks; the distinct words of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.array_distinct(F.when(F.size(words) >= width, runs).otherwise(words))


def exact_key(text: Column | str) -> Column:
    """Digest of the words, whatever the blanks between them; null for a text without words."""
    w = T.words(text)
    return F.when(F.size(w) > 0, F.sha1(F.array_join(w, "\u0001").cast("binary")))


def minima(codes: np.ndarray, counts: np.ndarray, permutations: int, width: int) -> np.ndarray:
    """(texts, permutations) minima from the codes of all texts' tokens; every text must have one.

    Only the tokens' codes, one permutation at a time, are held beside the result.
    """
    first = np.cumsum(counts) - counts
    n = len(codes)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= np.uint64(BASE)
        h[: max(0, n - j)] += codes[j:]
    short = np.repeat(counts < width, counts)
    h[short] = codes[short]
    whole = short | (np.arange(n) + width <= np.repeat(first + counts, counts))
    h = h[whole]
    begin = np.concatenate([[0], np.cumsum(whole)])[first]
    out = np.empty((len(counts), permutations), np.int64)
    for k, (a, b) in enumerate(coefficients(permutations)):
        out[:, k] = np.minimum.reduceat((h * np.uint64(a) + np.uint64(b)) & np.uint64(MODULUS - 1), begin)
    return out


def signatures(docs: DataFrame, permutations: int = 64, width: int = WIDTH, text: str = "text", tokens: str | None = None) -> DataFrame:
    """(doc_id, sig): minima of all permutations over a document's shingles of words, or of the ids of an
    array column ``tokens``. Documents without a word or id have no signature. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if tokens:
                    lists = [np.array(x.as_py() or [], np.uint64) for x in part.column(1)]
                else:
                    lists = []
                    for x in part.column(1):
                        found = (x.as_py() or "").split()
                        for w in set(found).difference(known):
                            known[w] = zlib.crc32(w.encode())
                        lists.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
                    if len(known) > 500_000:
                        known.clear()
                some = [i for i, x in enumerate(lists) if len(x)]
                if some:
                    sigs = minima(np.concatenate([lists[i] for i in some]), np.array([len(lists[i]) for i in some]), permutations, width)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, permutations), pa.int32()), pa.array(sigs.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), flat], ["doc_id", "sig"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", f"`{tokens or text}` AS x").mapInArrow(run, "doc_id long, sig array<long>")


def classes(sigs: DataFrame) -> DataFrame:
    """(rep, sig): each distinct signature under the smallest id that has it."""
    return sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")).select("rep", "sig")


def copies(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each other member of a class under its representative."""
    return sigs.join(reps, "sig").filter("doc_id <> rep").selectExpr("rep AS a", "doc_id AS b")


def bands(sigs: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """(key, band, bucket) for each run of ``rows`` minima."""
    runs = F.expr(f"transform(sequence(0, size(sig) div {rows} - 1), b -> struct(b AS band, xxhash64(b, slice(sig, b * {rows} + 1, {rows})) AS bucket))")
    return sigs.select(key, F.explode(runs).alias("k")).select(key, "k.band", "k.bucket")


def bucket_sizes(banded: DataFrame) -> DataFrame:
    return banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")


def candidates(banded: DataFrame, sizes: DataFrame, largest: int | None = None) -> DataFrame:
    """(a, b), a < b, for classes (``rep``) that share a bucket of 2 to ``largest`` members; see ``bucket_links`` for the rest."""
    kept = banded.join(sizes.filter(F.col("n") <= (largest or LARGEST)).select("bucket"), "bucket").select("bucket", "rep")
    x, y = kept.withColumnRenamed("rep", "a"), kept.withColumnRenamed("rep", "b")
    return x.join(y, "bucket").filter("a < b").select("a", "b").distinct()


def agreement(x: Column, y: Column) -> Column:
    """Share of equal slots of two signatures."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(x)


def verified(pairs: DataFrame, reps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of the candidates whose signatures agree enough."""
    j = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    return j.select("a", "b", agreement(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in their first ``keys`` columns; rows come sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def bucket_links(banded: DataFrame, sizes: DataFrame, reps: DataFrame, threshold: float = 0.8, largest: int | None = None, part: int | None = None) -> DataFrame:
    """(a, b, similarity): in buckets of more than ``largest`` classes, links that connect all classes that verified
    links connect. A class that no other has reached is compared with all, then each class outside
    the largest component, so that no link between components is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            ids = np.array([r[2] for r in rows])
            sigs = np.array([r[3] for r in rows])
            label = np.arange(len(ids))
            reached = np.zeros(len(ids), bool)
            expanded = np.zeros(len(ids), bool)
            found: list[tuple[int, int, float]] = []

            def expand(i: int) -> None:
                expanded[i] = True  # noqa: B023
                share = (sigs == sigs[i]).mean(axis=1)  # noqa: B023
                near = share >= threshold
                near[i] = False
                reached[near] = True  # noqa: B023
                for j in np.flatnonzero(near).tolist():
                    if label[i] != label[j]:  # noqa: B023
                        label[label == label[j]] = label[i]  # noqa: B023
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j]), share[j]))  # noqa: B023

            for i in range(len(ids)):
                if not reached[i]:
                    expand(i)
            most = np.bincount(label).argmax()
            for i in np.flatnonzero(label != most).tolist():
                if not expanded[i]:
                    expand(i)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

    large = banded.join(sizes.filter(F.col("n") > (largest or LARGEST)).select("bucket"), "bucket", "left_semi")
    rows = in_parts(large.select("bucket", "rep"), part or PART, "bucket", "rep").join(reps, "rep").select("bucket", "part", "rep", "sig")
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, "a long, b long, similarity double").distinct()


def links(spark: SparkSession, sigs: DataFrame, rows: int = 8, threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, similarity): verified pairs of representatives, and each copy with its representative.

    Whatever the size of a bucket, classes that verified pairs connect are connected by these.
    """
    scratch = scratch or Scratch(spark, "links")
    reps = scratch.table(classes(sigs), "classes")
    banded = scratch.table(bands(reps, rows, "rep"), "bands")
    sizes = scratch.table(bucket_sizes(banded), "sizes")
    near = verified(candidates(banded, sizes), reps, threshold)
    return copies(sigs, reps).withColumn("similarity", F.lit(1.0)).unionByName(near).unionByName(bucket_links(banded, sizes, reps, threshold)).distinct()


def best_matches(spark: SparkSession, sigs: DataFrame, held: Column, rows: int = 4, part: int | None = None) -> DataFrame:
    """(held, agreement, train): for each distinct held-out signature's documents the training document that
    agrees best, the smallest id among equals, of those with a common bucket.

    A task compares the two sides of a bucket, or of two parts of a large one, on arrays and gives one
    row for each held-out member: pairs are never written down.
    """
    scratch = Scratch(spark, "matches")
    sided = sigs.withColumn("held", held)
    reps = scratch.table(sided.groupBy("held", "sig").agg(F.min("doc_id").alias("rep")), "classes")
    banded = bands(reps, rows, "rep").join(reps.select("rep", "held"), "rep")
    both = banded.groupBy("bucket").agg(F.bool_or("held").alias("x"), F.bool_or(~F.col("held")).alias("y")).filter("x AND y").select("bucket")
    banded = scratch.table(banded.join(both, "bucket", "left_semi").select("bucket", "rep"), "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in grouped(batches, 2):
            own = np.array([r[3] for r in rows_], bool)
            if own.all() or not own.any():
                continue
            ids, sigs_ = np.array([r[2] for r in rows_]), np.array([r[4] for r in rows_])
            order = np.argsort(ids[~own])
            train, train_sigs = ids[~own][order], sigs_[~own][order]
            best = []
            for s in sigs_[own]:
                share = (train_sigs == s).mean(axis=1)
                k = int(share.argmax())  # the first of equals
                best.append((float(share[k]), int(train[k])))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([b[0] for b in best]), pa.array([b[1] for b in best], pa.int64())], ["rep", "agreement", "train"])

    rows_in = in_parts(banded, part or PART, "bucket", "rep").join(reps, "rep").select("bucket", "part", "rep", "held", "sig")
    found = rows_in.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, "rep long, agreement double, train long")
    best = found.groupBy("rep").agg(F.min(F.struct((-F.col("agreement")).alias("m"), "train")).alias("k"))
    members = sided.filter("held").join(reps.filter("held").select("rep", "sig"), "sig").select("doc_id", "rep")
    return members.join(best, "rep").select(F.col("doc_id").alias("held"), (-F.col("k.m")).alias("agreement"), F.col("k.train").alias("train"))


def exact_edges(keyed: DataFrame) -> DataFrame:
    """(a, b): each member of an exact group with its first. No group is collected."""
    first = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("a"))
    return keyed.join(first, "key").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))


def clusters(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(doc_id, cluster): smallest reachable id, by hooking nodes to a random-ordered neighbour each round."""
    scratch = Scratch(spark, "clusters")
    left = scratch.table(edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").filter("a < b").distinct(), "edges")
    known, turn = None, 0
    while left.limit(1).count():
        turn += 1
        around = left.select("a", "b").union(left.selectExpr("b", "a")).union(left.selectExpr("a", "a")).union(left.selectExpr("b", "b")).toDF("n", "m")
        hook = scratch.table(around.groupBy("n").agg(F.min_by("m", F.xxhash64("m", F.lit(turn))).alias("r")), "hook")
        merged = scratch.table(hook.select(F.col("n").alias("doc_id"), F.col("r").alias("c")) if known is None else known.join(hook, known.c == hook.n, "left").select("doc_id", F.coalesce("r", "c").alias("c")), "known")
        over = left.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b")
        after = scratch.table(over.selectExpr("least(x, y) AS a", "greatest(x, y) AS b").filter("a < b").distinct(), "edges")
        scratch.drop(left, hook, *([known] if known is not None else []))
        left, known = after, merged
    if known is None:
        return spark.createDataFrame([], "doc_id long, cluster long")
    return known.join(known.groupBy("c").agg(F.min("doc_id").alias("cluster")), "c").select("doc_id", "cluster")


def keep_longest(members: DataFrame, size: str = "bytes") -> DataFrame:
    """``keep``: of each cluster the id of the longest member, the smallest id among equals."""
    best = members.groupBy("cluster").agg(F.min(F.struct((-F.col(size)).alias("s"), "doc_id")).alias("k"))
    return members.join(best.select("cluster", F.col("k.doc_id").alias("keep")), "cluster")


def containment(held: DataFrame, train: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, n, matched, containment): an item's distinct shingles that occur in the training side.

    Every item that owns a shingle is credited for it. The item side's distinct shingles
    reduce the training side by a semi join before anything is grouped.
    """
    own = held.select("item_id", T.words(F.lower("text")).alias("w")).select("item_id", F.explode(shingles(F.col("w"), width)).alias("s"))
    seen = train.select(T.words(F.lower("text")).alias("w")).select(F.explode(shingles(F.col("w"), width)).alias("s")).join(own.select("s").distinct(), "s", "left_semi").distinct()
    g = own.join(seen.withColumn("hit", F.lit(1)), "s", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))
    return g.withColumn("containment", F.round(F.col("matched") / F.col("n"), 6))
