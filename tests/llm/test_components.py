import random
import time

from skein.llm import components as llm_components
from skein.llm.components import components, joined_further
from skein.session import Scratch


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for e in edges if e[0] != e[1] for i in e}


def some_edges():
    rng = random.Random(4)
    return [(i, i + 1) for i in range(-50, 100)] + [(1000, i) for i in range(700, 760)] + [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]


def test_few_edges_take_few_jobs(spark):
    edges = some_edges()
    table = Scratch(spark, "few").table(spark.createDataFrame(edges, "a long, b long"), "edges")
    spark.sparkContext.setJobGroup("few-edges", "")
    found = components(spark, table)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in found.collect()} == plain(edges)
    assert len(jobs) <= 6


def test_no_edges_need_no_python_rdd(spark):
    found = components(spark, spark.createDataFrame([], "a long, b long"))
    assert found.count() == 0 and found.dtypes == [("node", "bigint"), ("component", "bigint")]
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()


def test_rounds_before_the_last_edges(spark, monkeypatch):
    edges = some_edges()
    for few in (0, 30):
        monkeypatch.setattr(llm_components, "FEW", few)
        assert {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()} == plain(edges)


def test_more_edges_on_known_components(spark):
    edges = some_edges()
    more = [(100, 730), (2000, 9000), (9001, 9002), (-70, -50), (5, 6)]
    scratch = Scratch(spark, "further")
    for first in (edges, []):
        known = components(spark, spark.createDataFrame(first, "a long, b long"), scratch)
        known = joined_further(spark, known, spark.createDataFrame(more, "a long, b long"), scratch)
        assert sorted((r.node, r.component) for r in known.collect()) == sorted(plain(first + more).items())
        same = joined_further(spark, known, spark.createDataFrame([(5, 6)], "a long, b long"), scratch)
        assert sorted((r.node, r.component) for r in same.collect()) == sorted(plain(first + more).items())


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    df = spark.range(10_000).selectExpr("id % 7 AS a", "id AS b").repartition(3, "b").groupBy("a").count()
    table = Scratch(spark, "shuffled").table(df, "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == df.count() == 7
