"""Sinks: shards, sidecars, ledgers, manifests, reports. All go through Spark's commit protocol."""

from __future__ import annotations

import hashlib
import json
import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import Scratch

SHARD_BYTES = 500 << 20


def shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, key: str = "doc_id", split: str = "train") -> None:
    """zstd Parquet in the order of ``key``, about ``shard_bytes`` of text in a file, named
    ``<split>-00000-of-00007.parquet``. Names are given once all files are committed.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    docs.repartitionByRange(n, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)
    fs, path_of = _files(docs.sparkSession, path)
    parts = sorted(str(f.getPath().getName()) for f in fs.listStatus(path_of("")) if str(f.getPath().getName()).startswith("part-"))
    for k, name in enumerate(parts):
        fs.rename(path_of(name), path_of(f"{split}-{k:05d}-of-{len(parts):05d}.parquet"))


def _files(spark: SparkSession, root: str):
    """The file system of ``root``, and a function from names to paths under it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, lambda name: path(f"{root}/{name}" if name else root)


def by_source(docs: DataFrame, path: str) -> None:
    """Partitioned by source, so that a scan of one source reads nothing else."""
    docs.write.partitionBy("source").parquet(path)


def two_ways(routed: DataFrame, clean: str, rejected: str) -> None:
    """Clean rows to one place, the reasons of the others to another; what routes them runs once."""
    scratch = Scratch(routed.sparkSession, "routed")
    rows = scratch.table(routed, "rows")
    rows.filter("verdict = 'clean'").drop("verdict").write.parquet(clean)
    rows.filter("verdict <> 'clean' OR verdict IS NULL").select("doc_id", F.col("verdict").alias("reason")).write.option("sep", "\t").option("header", True).csv(rejected)
    scratch.drop(rows)


def sidecar(rows: DataFrame, path: str, key: str) -> None:
    """Gzipped CSV with headers, sorted; small counters, so one file for each range of keys."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.option("compression", "gzip").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_metrics(rows: DataFrame, root: str, lineage: str) -> None:
    """Rows added to a lineage's CSV files; each file has a header of its own, none is written again."""
    rows.write.mode("append").option("header", True).csv(f"{root}/{lineage}")


def newest_lineage(spark: SparkSession, root: str, prefix: str = "") -> str | None:
    """The last name, in code-point order, under ``root`` with a prefix: what a resumed run appends to."""
    fs, path_of = _files(spark, root)
    if not fs.exists(path_of("")):
        return None
    return max((n for f in fs.listStatus(path_of("")) if (n := str(f.getPath().getName())).startswith(prefix)), default=None)


def upsert_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, sum) lines with those of ``new`` in the place of older ones of the same name, sorted by name."""
    kept = old.join(new.select("name"), "name", "left_anti")
    return kept.unionByName(new).repartitionByRange(F.col("name")).sortWithinPartitions("name")


def macros(rows: DataFrame, name: str, value: str) -> DataFrame:
    """LaTeX macros, one a line, in the order of their names."""
    line = F.concat(F.lit("\\newcommand{\\"), F.col(name), F.lit("}{"), F.col(value).cast("string"), F.lit("}"))
    return rows.select(F.col(name).alias("name"), line.alias("value")).orderBy("name").select("value")


def check_release(spark: SparkSession, root: str, promised: list[str], placeholder: str = r"TODO|FIXME|\{\{[^}]*\}\}|<PLACEHOLDER") -> None:
    """Refuse a release that lacks a promised path or whose text files still hold a placeholder."""
    fs, path_of = _files(spark, root)
    if missing := [p for p in promised if not fs.exists(path_of(p))]:
        raise AssertionError(f"missing: {', '.join(missing)}")
    texts = [path_of(p).toString() for p in promised if p.endswith((".md", ".txt", ".json", ".csv"))]
    if texts:
        found = spark.read.text(texts).filter(F.col("value").rlike(placeholder)).select("value").limit(1).collect()
        if found:
            raise AssertionError(f"placeholder left: {found[0].value[:80]}")


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a sha256sum file, in the order of the path when written."""
    name = F.concat(F.lit("./"), F.col(key).cast("string"), F.lit(".txt"))
    return docs.select(name.alias("path"), F.concat_ws("  ", F.sha2(F.col(text).cast("binary"), 256), name).alias("value"))


def write_manifest(docs: DataFrame, path: str, **names) -> None:
    manifest(docs, **names).repartitionByRange(F.col("path")).sortWithinPartitions("path").select("value").write.text(path)


def report(spark: SparkSession, path: str, parameters: dict, script: str | None = None, most: int = 100_000, **tables: DataFrame) -> None:
    """One JSON object: small aggregate tables as lists of rows, and under meta the parameters and their digest,
    the digest of the ``script`` file, time, host and Spark's version. A table of over ``most``
    rows is an error, not a shorter report.
    """
    body: dict = {}
    for name, t in tables.items():
        body[name] = [r.asDict(recursive=True) for r in t.limit(most + 1).toLocalIterator()]
        if len(body[name]) > most:
            raise ValueError(f"{name} has over {most} rows: a report is for aggregates")
    text = json.dumps(parameters, sort_keys=True)
    meta = {"parameters": parameters, "parameters_sha256": hashlib.sha256(text.encode()).hexdigest(), "spark": spark.version, "host": platform.node(), "time": datetime.now(UTC).isoformat(timespec="seconds")}
    if script:
        with open(script, "rb") as f:
            meta["script_sha256"] = hashlib.sha256(f.read()).hexdigest()
    body["meta"] = meta
    spark.createDataFrame([(json.dumps(body, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def expect(spark: SparkSession, **checks: tuple[DataFrame, str]) -> None:
    """Abort if a condition isn't true of the single row of its table."""
    for name, (table, condition) in checks.items():
        if not table.selectExpr(f"coalesce({condition}, false) AS ok").first()["ok"]:
            raise AssertionError(f"expectation failed: {name}: {condition}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old table, then take its place. The old one is moved aside until the new one is in place;
    a run that stopped in between is put right by the next one, or by ``recover``.
    """
    recover(df.sparkSession, path)
    fs, path_of = _files(df.sparkSession, path.rpartition("/")[0])
    name = path.rpartition("/")[2]
    fs.delete(path_of(f"{name}.new"), True)
    df.write.parquet(f"{path}.new")
    if fs.exists(path_of(name)):
        fs.rename(path_of(name), path_of(f"{name}.old"))
    fs.rename(path_of(f"{name}.new"), path_of(name))
    fs.delete(path_of(f"{name}.old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Put an old table back that a stopped ``replace_table`` had moved aside."""
    fs, path_of = _files(spark, path.rpartition("/")[0])
    name = path.rpartition("/")[2]
    if fs.exists(path_of(f"{name}.old")):
        if fs.exists(path_of(name)):
            fs.delete(path_of(f"{name}.old"), True)
        else:
            fs.rename(path_of(f"{name}.old"), path_of(name))
