"""Session helpers: shipping the package to executors and folders that all of them share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: what an Arrow batch holds at most, unless the session says otherwise: a worker and its JVM hold several
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}

#: whether a write takes its own shuffle files away when it ends; else they stay until the driver happens to collect its garbage
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Make ``skein`` importable in the Python workers, once per application, and bound Arrow batches in bytes
    (Spark's own bound, 10,000 rows, is no bound on texts). Settings that the session has stay.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    given = spark.sparkContext.getConf()
    for name, value in BATCH.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="skein"), "skein_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local folder is set if the master is local (tests on one
    machine); on a cluster that is an error, as executors couldn't see each other's files.
    """
    jvm = spark.sparkContext._jsc.sc()
    found = jvm.getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not jvm.isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-shared"))
    return jvm.getCheckpointDir().get()


_ROOTS: dict[str, str] = {}


def application_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which goes when Python ends (or with ``clean_up``)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/skein-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clean_up, spark, app)
    return _ROOTS[app]


def clean_up(spark: SparkSession, app: str | None = None) -> None:
    """Delete what the application has left in the shared folder: results of its queries can't be read any more."""
    root = _ROOTS.pop(app or spark.sparkContext.applicationId, None)
    if root:
        with contextlib.suppress(Exception):  # at the end of Python the session may have gone before
            delete(spark, root)


class Scratch:
    """Tables written to the shared folder to cut lineage. What a result no longer needs is dropped at
    once, what it reads lives until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back; what reads it survives lost executors, and what was shuffled for it goes at once."""
        to, before = self.path(label), self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(to)
        finally:
            self.spark.conf.unset(SHUFFLES_GO) if before is None else self.spark.conf.set(SHUFFLES_GO, before)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._skein_path = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables; those that aren't written ones (an empty result, say) hold nothing."""
        for t in tables:
            if path := getattr(t, "_skein_path", None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
