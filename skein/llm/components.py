"""Distributed union-find: the smallest reachable id of each node of an undirected graph.

Each round orders the nodes anew by a hash and hooks every node to the first of its
neighbourhood (itself included); edges are carried over to what their ends hook to, and
those within one node vanish. As the order is random, about half of the nodes or more
disappear in a round even in long chains, so the rounds follow the logarithm of the largest
component. Once no more than ``FEW`` edges are left, one task puts them together. All state is
in tables in the shared folder; the driver sees only how many edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrays import lean
from skein.session import Scratch, ship_package

#: so many edges at most are put together by one task, in some 20 MB
FEW = 1 << 16
#: a key with more than this part of all rows is looked up apart; there are fewer such keys than that
HOT = 1000


def lookup(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the one row of ``values`` for their key, whose ``n`` tells how many rows have it.

    A key with more than a thousandth of all rows would be one task's burden. There are fewer
    than a thousand of these, whatever the size of the input: they are broadcast, and only the
    other rows are shuffled by their key. Both inputs should be written tables.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = values.filter(F.col("n") * HOT > total).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.filter(F.col("n") * HOT <= total).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def together(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of at most ``FEW`` edges (a, b), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((find(a), find(b)))
                root[b] = a
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(lean(run), "node long, component long")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component), a written table, for each node that has an edge; ``edges`` are (a, b), in any direction.

    Loops and repeated edges do no harm; without edges the result is empty. Firsts are
    partial aggregates, and look-ups are joins that split large keys, so one component with
    a third of all nodes is no single task's burden.
    """
    ship_package(spark)
    scratch = scratch or Scratch(spark, "components")
    left = scratch.table(edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").filter("a < b").distinct(), "edges")
    known, turn = None, 0
    while (n := left.count()) > FEW:
        turn += 1
        both = left.selectExpr("explode(array(struct(a, b), struct(b AS a, a AS b), struct(a, a AS b), struct(b AS a, b))) AS e").select("e.*")
        first = both.groupBy("a").agg(F.min(F.expr(f"struct(xxhash64(b, {turn}) AS h, b)")).alias("m"))
        hook = scratch.table(first.selectExpr("a AS node", "m.b AS root"), "hook")
        if known is None:
            merged = hook.selectExpr("node", "root AS label")
        else:
            merged = known.join(hook.selectExpr("node AS label", "root"), "label", "left").selectExpr("node", "coalesce(root, label) AS label")
        merged = scratch.table(merged, "known")
        over = left.join(hook.selectExpr("node AS a", "root AS x"), "a").join(hook.selectExpr("node AS b", "root AS y"), "b")
        after = scratch.table(over.selectExpr("least(x, y) AS a", "greatest(x, y) AS b").filter("a < b").distinct(), "edges")
        scratch.drop(left, hook, *([known] if known is not None else []))
        left, known = after, merged
    if known is None:
        out = scratch.table(together(left), "joined") if n else spark.range(0).selectExpr("id AS node", "id AS component")  # rows from Python would start a second worker daemon
        scratch.drop(left)
        return out
    if n:
        last = scratch.table(together(left), "last")
        merged = known.join(last.selectExpr("node AS label", "component AS root"), "label", "left").selectExpr("node", "coalesce(root, label) AS label")
        merged = scratch.table(merged, "known")
        scratch.drop(last, known)
        known = merged
    scratch.drop(left)
    smallest = scratch.table(known.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")), "smallest")
    out = scratch.table(lookup(known, smallest, "label").select("node", "component"), "joined")
    scratch.drop(known, smallest)
    return out


def joined_further(spark: SparkSession, known: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``components`` of the edges of ``known`` and of ``edges`` (a, b), a written table; ``known`` is used up.

    Only links between known components are put together; without any ``known`` is the result.
    """
    ends = edges.join(known.selectExpr("node AS a", "component AS x"), "a", "left").join(known.selectExpr("node AS b", "component AS y"), "b", "left")
    more = components(spark, ends.selectExpr("coalesce(x, a) AS a", "coalesce(y, b) AS b"), scratch)
    if not more.limit(1).count():
        scratch.drop(more)
        return known
    moved = known.join(more.selectExpr("node AS component", "component AS further"), "component", "left").selectExpr("node", "coalesce(further, component) AS component")
    out = scratch.table(moved.unionByName(more.join(known, "node", "left_anti")), "joined")
    scratch.drop(known, more)
    return out
