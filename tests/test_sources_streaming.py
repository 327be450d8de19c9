import json
import struct

import pytest
from pyspark.sql import functions as F
from skein.config import POLISH, POLISH_GATE, WESTERN, Gate
from skein.sources import pages, readers, writers
from skein.streaming import ingest


def test_text_folder(spark, tmp_path):
    for name, raw in {"ia_b.txt": "zażółć".encode(), "ia_a.txt": b"bad \xff byte", "wl_c.txt": b"", ".hidden.txt": b"x", "ia_+ d.txt": b"plus", "note.md": b"x"}.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.doc_id: (r.source, r.text) for r in readers.text_folder(spark, str(tmp_path)).collect()}
    assert rows == {"ia_b": ("ia", "zażółć"), "ia_a": ("ia", "bad � byte"), "ia_+ d": ("ia", "plus")}
    assert [r.doc_id for r in readers.text_folder(spark, str(tmp_path), prefix="ia_", limit=2).collect()] == ["ia_+ d", "ia_a"]


def test_json_and_control_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a", "x": {"y": [1, 2]}}\n{"id": "b"\n{"id": "c", "x": {"y": [3]}}\n')
    assert {r.id for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id string").collect() if r.id} == {"a", "c"}
    v = readers.variants(spark, str(tmp_path / "l.jsonl"))
    assert [r.n for r in v.select(readers.dig(F.col("v"), "x.y.0", "int").alias("n")).collect()] == [1, 3]
    (tmp_path / "a.json").write_text('["p", "q"]')
    (tmp_path / "b.json").write_text('{"ids": ["q", "r"]}')
    got = {f: {r.doc_id for r in readers.id_list(spark, str(tmp_path / f)).collect()} for f in ("a.json", "b.json")}
    assert got == {"a.json": {"p", "q"}, "b.json": {"q", "r"}}


def test_token_stream(spark, tmp_path):
    docs = [[5, 6], [], list(range(1, 60000)), [7]]
    ids = [x for d in docs for x in (*d, 0)]
    (tmp_path / "s.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
    rows = readers.token_stream(spark, str(tmp_path / "s.bin")).orderBy("ord").collect()
    assert [list(r.tokens) for r in rows] == docs and [r.start for r in rows] == [0, 3, 4, 60004]


def test_training_log(spark, tmp_path):
    (tmp_path / "t.log").write_text("step  20 | loss 9.05 | lr x0.1\nval loss 9.20\nnoise\nstep  40 | loss 8.00 | lr x0.2\nval loss 8.10\n")
    rows = readers.training_log(spark, str(tmp_path / "t.log")).orderBy("line").collect()
    assert [(r.step, r.loss, r.val_loss) for r in rows] == [(20, 9.05, None), (20, None, 9.2), (40, 8.0, None), (40, None, 8.1)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s" + str(i % 2), "text " * i) for i in range(50)], "doc_id long, source string, text string")
    writers.shards(docs, str(tmp_path / "shards"), shard_bytes=1000)
    names = sorted(f.name for f in (tmp_path / "shards").glob("*.parquet"))
    assert len(names) > 2 and names[0] == f"train-00000-of-{len(names):05d}.parquet" and spark.read.parquet(str(tmp_path / "shards")).count() == 50
    writers.by_source(docs, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").glob("source=*")} == {"source=s0", "source=s1"}
    writers.two_ways(docs.withColumn("verdict", F.when(F.col("doc_id") < 5, "short").otherwise("clean")), str(tmp_path / "clean"), str(tmp_path / "gone"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 45 and spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "gone")).count() == 5
    writers.write_manifest(docs.limit(2), str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert all(len(x.split("  ")[0]) == 64 and x.endswith(".txt") for x in lines)
    writers.sidecar(docs.select("doc_id", "source"), str(tmp_path / "csv"), "doc_id")
    assert readers.sidecars(spark, str(tmp_path / "csv"), schema="doc_id long, source string").count() == 50
    writers.report(spark, str(tmp_path / "r"), {"k": 1}, counts=docs.groupBy("source").count())
    body = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert body["meta"]["parameters"] == {"k": 1} and len(body["counts"]) == 2 and {"host", "time"} <= body["meta"].keys()
    with pytest.raises(ValueError):
        writers.report(spark, str(tmp_path / "r2"), {}, most=10, docs=docs)
    writers.replace_table(docs.limit(3), str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 3
    (tmp_path / "clean").rename(tmp_path / "clean.old")  # as if stopped between the two renames
    writers.recover(spark, str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 3
    assert sorted(p.name for p in tmp_path.glob("clean*")) == ["clean"]
    writers.expect(spark, all_there=(docs.agg(F.count("*").alias("n")), "n = 50"))
    with pytest.raises(AssertionError):
        writers.expect(spark, fewer=(docs.agg(F.count("*").alias("n")), "n < 50"))


def test_paged_source(spark, tmp_path):
    book = {"start": {"items": [{"identifier": "a"}, {"identifier": "b", "title": "B"}], "cursor": "c1"}, "c1": {"items": [{"identifier": "c"}], "cursor": None}}
    (tmp_path / "pages.json").write_text(json.dumps(book))
    spark.dataSource.register(pages.PagedSource)
    assert sorted(r.identifier for r in spark.read.format("paged").load(str(tmp_path / "pages.json")).collect()) == ["a", "b", "c"]


GOOD = "the house of the king and the garden of the queen in the town " * 5


def test_ingest_is_incremental_and_remembers_rejections(spark, tmp_path):
    src, clean, ledger = (str(tmp_path / x) for x in ("in", "clean", "ledger"))
    schema = "doc_id long, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def go(gate, name):
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.ingest(stream, clean, ledger, str(tmp_path / name), gate=gate).awaitTermination()

    gate = Gate(min_alpha=0.7, min_diacritic=0.0, min_stopword=0.03)
    arrive([(1, GOOD), (2, "12 34 56"), (1, GOOD), (3, None)])
    go(gate, "c1")
    arrive([(2, "12 34 56"), (4, GOOD)])
    go(gate, "c1")
    assert sorted(r.doc_id for r in spark.read.parquet(clean).collect()) == [1, 4]
    assert sorted((r.doc_id, r.reason) for r in spark.read.parquet(ledger).collect()) == [(2, "alpha"), (3, "empty")]
    loose = Gate(min_alpha=0.0, min_diacritic=0.0, min_stopword=0.0)
    go(loose, ingest.checkpoint_for("c", "q", "other"))
    assert sorted(r.doc_id for r in spark.read.parquet(clean).collect()) == [1, 2, 4]
    kept, pruned = ingest.regate(spark, clean, WESTERN, gate)
    assert kept.count() == 2 and pruned.collect()[0].doc_id == 2
    assert ingest.checkpoint_for("r", "a", "b") != ingest.checkpoint_for("r", "a", "c")


def test_streams_of_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(500)
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    def drain(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert drain(ingest.unique_events(stream(), ["event_id"], "1000 hours"), "once").count() == 500
    tumbling = drain(ingest.running_windows(stream(), "1 hour", delay="0 seconds"), "hours", "complete")
    assert tumbling.agg(F.sum("n")).first()[0] == 1000
    assert drain(ingest.running_windows(stream(), "2 hours", "1 hour", "0 seconds"), "sliding", "complete").agg(F.sum("n")).first()[0] == 2000
    assert drain(ingest.session_counts(stream()), "sess", "complete").agg(F.sum("n")).first()[0] == 1000


def test_failed_items_are_asked_again(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "id long")
    done = spark.createDataFrame([(1, None), (2, "timeout"), (3, None)], "id long, error string")
    assert sorted(r.id for r in ingest.failed_only(items, done).collect()) == [0, 2, 4]


def test_polish_profile(spark):
    from skein.functions import text as T

    ok = "się że nie jest który była było oraz przez jego żółć gęś kość " * 3
    rows = spark.createDataFrame([(ok,), ("The English text of a book " * 5,), ("",), ("книга " * 20 + ok,)], "text string")
    got = [r.r for r in rows.select(T.gate_reason("text", POLISH, POLISH_GATE).alias("r")).collect()]
    assert got == [None, "diacritic", "empty", "alpha"] or got == [None, "diacritic", "empty", "cyrillic"]


def test_lineages_sums_macros_and_releases(spark, tmp_path):
    root = str(tmp_path / "metrics")
    assert writers.newest_lineage(spark, root) is None
    for name, steps in (("run-1", [1]), ("run-2", [1, 2]), ("run-2", [3])):
        writers.append_metrics(spark.createDataFrame([(k, k / 2) for k in steps], "step long, loss double"), root, name)
    assert writers.newest_lineage(spark, root, "run-") == "run-2"
    assert readers.sidecars(spark, f"{root}/run-2", schema="step long, loss double").agg(F.sum("step")).first()[0] == 6
    old = spark.createDataFrame([("b", "1"), ("a", "2")], "name string, sum string")
    assert [(r.name, r.sum) for r in writers.upsert_sums(old, spark.createDataFrame([("b", "9"), ("c", "3")], "name string, sum string")).collect()] == [("a", "2"), ("b", "9"), ("c", "3")]
    assert [r.value for r in writers.macros(old, "name", "sum").collect()] == ["\\newcommand{\\a}{2}", "\\newcommand{\\b}{1}"]
    (tmp_path / "README.md").write_text("all done\n")
    writers.check_release(spark, str(tmp_path), ["README.md", "metrics"])
    with pytest.raises(AssertionError, match="missing"):
        writers.check_release(spark, str(tmp_path), ["README.md", "data"])
    (tmp_path / "README.md").write_text("size: TODO\n")
    with pytest.raises(AssertionError, match="placeholder"):
        writers.check_release(spark, str(tmp_path), ["README.md"])


def test_log_over_several_splits(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.log").write_text("".join(f"step {100 * k + i} | loss 1.0\nval loss 2.0\n" for i in range(3)) if k != 2 else "val loss 3.0\n")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    rows = readers.training_log(spark, str(tmp_path)).orderBy("line").collect()
    spark.conf.set("spark.sql.files.openCostInBytes", old)
    at, want = None, []
    for r in sorted(rows, key=lambda r: r.line):
        at = r.step if r.loss == 1.0 else at
        want.append(at)
    assert [r.step for r in rows] == want and len(rows) == 19


def test_encoding_and_cleaning_again(spark, tmp_path):
    spark.createDataFrame([(i, "a bb ccc " * i) for i in range(20)] + [(99, None)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.encode_stream(docs, lambda: lambda t: [len(w) for w in t.split()], str(tmp_path / "ids"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.doc_id: r.ids for r in spark.read.parquet(str(tmp_path / "ids")).collect()}
    assert len(rows) == 21 and rows[2] == [1, 2, 3, 1, 2, 3] and rows[99] is None
    spark.createDataFrame([(1, GOOD), (2, GOOD + " 1 2 3 4 5 6 7 8 9" * 30)], "doc_id long, text string").write.parquet(str(tmp_path / "clean"))
    kept, gone = ingest.reclean(spark, str(tmp_path / "clean"), lambda t: F.regexp_replace(t, "[0-9]", ""))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and gone.count() == 0
    assert ingest.regate(spark, str(tmp_path / "clean"))[1].count() == 1


def test_marked_spans_reasons_and_lines(spark):
    from skein.functions import text as T

    df = spark.createDataFrame([("a <b> c & d", [(7, 8), (0, 1), (2, 5), (4, 6)])], "t string, s array<struct<start:int,stop:int>>")
    assert df.select(T.mark_spans("t", F.col("s"))).first()[0] == "<mark>a</mark> <mark>&lt;b&gt;</mark> c<mark> </mark>&amp; d"
    short = spark.createDataFrame([("x",), ("word " * 100,), ("1 " * 200,)], "t string").select(T.route_reason(F.col("t")).alias("r"))
    assert [r.r for r in short.collect()][:2] == ["length 1 under 200", None]
    assert T.wrapped("aa \x1b[1mbb\x1b[0m cc dd", 5) == ["aa \x1b[1mbb\x1b[0m", "cc dd"]
