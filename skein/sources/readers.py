"""Scans of everything that a text corpus comes as."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIDECAR = "file string, source string, uploader string, bytes long, chars long, words long, alpha long, diacritic long, cyrillic long, digit long, modern_marker_occ long, ctx_years long, bare_years long"
LEDGER = "document_id string, source string, source_identifier string, bytes long"


def text_folder(spark: SparkSession, path: str, prefix: str = "", recursive: bool = False, limit: int | None = None) -> DataFrame:
    """One row for each .txt file: doc_id (the file's stem), source (the part before ``_``), text.

    ``prefix`` prunes files before they are opened, dot files are never read, bytes that are
    no UTF-8 become U+FFFD. Files of zero bytes have no split in Spark, so they give no row. With ``limit`` the first ids in code-point order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.txt").option("recursiveFileLookup", recursive).load(path)
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    d = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    d = d.select("doc_id", F.substring_index("doc_id", "_", 1).alias("source"), "text")
    return d.orderBy("doc_id").limit(limit) if limit is not None else d


def published(spark: SparkSession, path: str) -> DataFrame:
    """The two columns of published shards that text operators read."""
    return spark.read.parquet(path).select("id", "text")


def sidecars(spark: SparkSession, *globs: str, schema: str | StructType = SIDECAR) -> DataFrame:
    """CSV files with headers (gzip too) under one explicit schema, as one table."""
    return spark.read.schema(schema).option("header", True).csv(list(globs))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines of which torn ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without a schema: one VARIANT a row, torn lines skipped."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")


def dig(variant, path: str, kind: str = "string"):
    """A dotted path with list indices, such as ``a.b.0``."""
    steps = "".join(f"[{p}]" if p.lstrip("-").isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(variant, "$" + steps, kind)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a control file that is a list, or an object with a list called ``ids``."""
    v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    found = F.coalesce(F.try_variant_get("v", "$", "array<string>"), F.try_variant_get("v", "$.ids", "array<string>"))
    return v.select(F.explode(found).alias("doc_id")).distinct()


def token_stream(spark: SparkSession, path: str, end: int = 0) -> DataFrame:
    """Documents of binary little-endian uint16 files: (path, ord, start, tokens), split at the end id.

    A file is read in records of a fixed size by all tasks; tokens are cut at the ends that
    lie in a record, and pieces are put together by document, so no task holds a file.
    """
    size = 1 << 16
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("at"))

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(name) as f:
                    f.seek(row["at"])
                    ids = np.frombuffer(f.read(size), "<u2")
                cut = [0, *(np.flatnonzero(ids == end) + 1).tolist()]
                if cut[-1] != len(ids):
                    cut.append(len(ids))
                base = row["at"] // 2
                got = [ids[a:b].astype(np.int32) for a, b in zip(cut, cut[1:], strict=False)]
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * n), pa.array([base + a for a in cut[:-1]], pa.int64()), pa.array([bool(len(g)) and int(g[-1]) == end for g in got], pa.bool_()), pa.array([g.tolist() for g in got], pa.list_(pa.int32()))], ["path", "start", "ended", "tokens"]
                )

    p = parts.mapInArrow(pieces, "path string, start long, ended boolean, tokens array<int>")
    # a piece belongs to the document that the pieces before it left open; only flags are ordered
    flags = p.select("path", "start", "ended")
    w = Window.partitionBy("path").orderBy("start")
    order = flags.withColumn("ord", F.sum(F.col("ended").cast("long")).over(w) - F.col("ended").cast("long"))
    g = p.join(order.select("path", "start", "ord"), ["path", "start"]).groupBy("path", "ord").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "tokens"))).alias("s"))
    whole = F.flatten(F.transform("s", lambda x: x["tokens"]))
    return g.select("path", "ord", "start", F.filter(whole, lambda t: t != end).alias("tokens"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, step, loss, val_loss) of a log in which a val line belongs to the step line before it."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    number = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    d = lines.select("line", number(r"^step\s+(\d+)").cast("long").alias("own"), number(r"(?:^|\| )loss ([0-9.]+)").cast("double").alias("loss"), number(r"val loss ([0-9.]+)").cast("double").alias("val_loss"))
    d = d.withColumn("part", F.shiftright("line", 33))  # a file split: what is before it is one row for each split
    w = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ends = d.filter("own IS NOT NULL").groupBy("part").agg(F.max_by("own", "line").alias("last"))
    before = d.select("part").distinct().join(ends, "part", "left")
    before = before.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = d.withColumn("inside", F.last("own", ignorenulls=True).over(w)).filter("loss IS NOT NULL OR val_loss IS NOT NULL")
    return inside.join(before, "part").select("line", F.coalesce("inside", "carried").alias("step"), "loss", "val_loss")
