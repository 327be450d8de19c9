"""Structured Streaming jobs. Offsets are only committed after a batch's writes, so a batch that is
repeated after a failure meets its own rows: writes anti-join what is there already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.config import WESTERN, WESTERN_GATE, Gate, Profile
from skein.functions import text as T
from skein.plans.textual import gate_fingerprint


def checkpoint_for(root: str, query: str, order: str) -> str:
    """Another query or order gets a checkpoint of its own: old cursors mean nothing to it."""
    return f"{root}/{hashlib.sha1(f'{query}|{order}'.encode()).hexdigest()[:12]}"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def ingest(docs: DataFrame, clean: str, ledger: str, checkpoint: str, profile: Profile = WESTERN, gate: Gate = WESTERN_GATE) -> StreamingQuery:
    """Documents (doc_id, text) that are neither kept nor rejected under the current gate are gated;
    kept ones are appended to ``clean``, the others to ``ledger`` with reason and gate.
    """
    now = gate_fingerprint(profile, gate)

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        have = _table(spark, clean, "doc_id long, text string").select("doc_id")
        refused = _table(spark, ledger, "doc_id long, reason string, gate string").filter(F.col("gate") == now).select("doc_id")
        fresh = df.dropDuplicates(["doc_id"]).join(have, "doc_id", "left_anti").join(refused, "doc_id", "left_anti")
        judged = fresh.withColumn("reason", T.gate_reason("text", profile, gate)).persist()
        judged.filter("reason IS NOT NULL").select("doc_id", "reason", F.lit(now).alias("gate")).write.mode("append").parquet(ledger)
        judged.filter("reason IS NULL").select("doc_id", "text").write.mode("append").parquet(clean)
        judged.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regate(spark: SparkSession, clean: str, profile: Profile = WESTERN, gate: Gate = WESTERN_GATE) -> tuple[DataFrame, DataFrame]:
    """What is kept and what is pruned when a new gate is applied to stored documents."""
    d = spark.read.parquet(clean).withColumn("reason", T.gate_reason("text", profile, gate))
    return d.filter("reason IS NULL").drop("reason"), d.filter("reason IS NOT NULL").select("doc_id", "reason")


def reclean(spark: SparkSession, clean: str, cleaner: Callable[[Column], Column], profile: Profile = WESTERN, gate: Gate = WESTERN_GATE) -> tuple[DataFrame, DataFrame]:
    """Stored documents after another cleaner: those that still pass the gate, and the others with the reason."""
    d = spark.read.parquet(clean).withColumn("text", cleaner(F.col("text"))).withColumn("reason", T.gate_reason("text", profile, gate))
    return d.filter("reason IS NULL").drop("reason"), d.filter("reason IS NOT NULL").select("doc_id", "reason")


def encode_stream(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], out: str, checkpoint: str) -> StreamingQuery:
    """Texts of a stream (doc_id, text) encoded batch by batch and appended as (doc_id, ids). ``encode`` is called
    once for each Python worker's task and gives the encoder; how much is in a batch is the source's option.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode()
        for batch in batches:
            ids = [None if t is None else encoder(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    coded = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
    return coded.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def failed_only(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items to be asked again: those without a result that isn't an error."""
    return items.join(done.filter("error IS NULL").select(key), key, "left_anti")


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Event time as an instant (tables may hold it without a zone), with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def unique_events(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each event once, with state only for the watermark's delay."""
    return timed(events, delay).dropDuplicatesWithinWatermark(keys)


def running_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by type, final once the watermark has passed."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = timed(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    g = timed(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
