"""Global order without a task that sees all rows: ranges are sorted by themselves, and what one range
needs of those before it (a count, a sum, a neighbour) is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import Scratch


def ranged(spark: SparkSession, df: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``__p``, their range; written once, so that all readers see the same ranges."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id())
    return Scratch(spark, "ordered").table(spread, "ranges")


def running(spark: SparkSession, df: DataFrame, keys: list[str], value: str, name: str = "before") -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, in the order of ``keys``. ``_skein_path`` of the
    result is the table of ranges that it reads.
    """
    rows = ranged(spark, df, *keys)
    out = _running(rows, keys, value, name)
    out._skein_path = rows._skein_path
    return out


def _running(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    sums = rows.groupBy("__p").agg(F.sum(value).alias("__s"))
    offset = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__o"))
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.join(offset, "__p").withColumn(name, F.col("__o") + inside).drop("__p", "__o")


def ordinals(spark: SparkSession, df: DataFrame, keys: list[str], name: str = "ordinal") -> DataFrame:
    """``name``: the place of each row, from 0."""
    return running(spark, df.withColumn("__one", F.lit(1).cast("long")), keys, "__one", name).drop("__one")


def following(spark: SparkSession, df: DataFrame, keys: list[str], value: str, name: str = "following") -> DataFrame:
    """``name``: ``value`` of the next row, null for the last."""
    rows = ranged(spark, df, *keys)
    heads = rows.groupBy("__p").agg(F.min_by(value, F.struct(*keys)).alias("__h"))
    heads = heads.select("__p", F.lead("__h").over(Window.orderBy("__p")).alias("__n"))
    w = Window.partitionBy("__p").orderBy(*keys)
    last = F.lead(F.lit(1)).over(w).isNull()
    return rows.join(heads, "__p").withColumn(name, F.when(last, F.col("__n")).otherwise(F.lead(value).over(w))).drop("__p", "__n")
