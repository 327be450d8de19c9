"""Rows told apart by key and text: what operators decided about rows, applied to the rows they came from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_HASH = "xxhash64(`{text}`)"
FILTER_BITS = 26


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text_hash, text): keys as longs; null keys and texts stay."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.expr(TEXT_HASH.format(text=text)).alias("text_hash"), F.col(f"`{text}`").alias("text"))


def same(key: str, text: str) -> Column:
    """A row's key and text are those of ``__key`` and ``__hash``; null keys are equal."""
    return F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__key")) & (F.expr(TEXT_HASH.format(text=text)) == F.col("__hash"))


def keys(groups: DataFrame, *more: str) -> DataFrame:
    return groups.select(F.col("doc_id").alias("__key"), F.col("text_hash").alias("__hash"), *more)


def once(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row for each key and text of ``groups`` (a written table), and all other rows."""
    if not groups.limit(1).count():
        return docs
    found = docs.join(keys(groups), same(key, text), "left_semi")
    single = found.withColumn("__key", F.col(f"`{key}`").cast("long")).withColumn("__hash", F.expr(TEXT_HASH.format(text=text))).dropDuplicates(["__key", "__hash"]).drop("__key", "__hash")
    return docs.join(keys(groups), same(key, text), "left_anti").unionByName(single)


def wanted_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) with the leading ``FILTER_BITS`` bits of the hashes in ``node``: what isn't in it isn't wanted."""
    top = f"shiftrightunsigned(node, {64 - FILTER_BITS})"
    rows = nodes.selectExpr(f"shiftrightunsigned({top}, 6) AS word", f"shiftleft(1L, cast({top} & 63 AS int)) AS bit").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def are_wanted(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has; a few that aren't wanted too."""
    top = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)
