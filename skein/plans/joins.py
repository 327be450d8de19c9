"""Joins and set operations: each kind that a corpus pipeline needs, on the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import neardup as N
from skein.operators.ordering import ordinals
from skein.plans.base import Registry, table, words

R = Registry()


def _md5(prefix: str, c: str = "doc_id"):
    return F.md5(F.concat(F.lit(prefix), F.col(c).cast("string")).cast("binary"))


@R.add("SELECT count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left anti: excluded ids go before the texts are looked at."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@R.add("SELECT lang, count(*) AS docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left semi: rows whose key stands in the other table."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("docs"))


@R.add("SELECT (SELECT count(*) FROM documents) AS wanted, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS found, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS missing, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS unknown")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of a join on both sides: what the catalogue lacks, and what only it has."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full_outer")
    return j.agg(F.count("d").alias("wanted"), F.count_if(F.expr("d = 1 AND l = 1")).alias("found"), F.count_if(F.expr("l IS NULL")).alias("missing"), F.count_if(F.expr("d IS NULL")).alias("unknown"))


@R.add("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer with defaults for what the other side lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n_chars")


_MANIFEST = "SELECT doc_id, sha256(text) AS h FROM documents WHERE substr(md5('m:' || doc_id), 1, 1) <> '0'"
_DISK = "SELECT doc_id, sha256(CASE WHEN substr(md5('c:' || doc_id), 1, 1) = '0' THEN text || '!' ELSE text END) AS h FROM documents WHERE substr(md5('d:' || doc_id), 1, 1) <> '0'"


@R.add(f"SELECT coalesce(m.doc_id, d.doc_id) AS doc_id, CASE WHEN d.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'extra' ELSE 'corrupt' END AS fault FROM ({_MANIFEST}) m FULL JOIN ({_DISK}) d ON m.doc_id = d.doc_id WHERE m.h IS DISTINCT FROM d.h")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer diff of a frozen manifest and what is on disk (here: the same table, harmed in places)."""
    t = table(spark, sf_dir, "documents")
    first = lambda p: F.substring(_md5(p), 1, 1)
    m = t.filter(first("m:") != "0").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("a"))
    on_disk = F.when(first("c:") == "0", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    d = t.filter(first("d:") != "0").select("doc_id", F.sha2(on_disk.cast("binary"), 256).alias("b"))
    j = m.join(d, "doc_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("doc_id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt").alias("fault"))


@R.add(
    """SELECT r_name, n_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY ALL"""
)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join in which the fact side is filtered first; dimensions are broadcast if statistics say they are small."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    lines = t["lineitem"].filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = lines.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum("k").alias("lines"), F.round(F.sum("v"), 2).alias("revenue"))


@R.add(
    """WITH s AS (SELECT doc_id, CASE WHEN substr(md5('1337:' || doc_id), 1, 2) < '10' THEN 'val' ELSE 'train' END AS split FROM documents), x AS (SELECT lang, avg(length(text)) AS mean FROM documents GROUP BY lang)
  SELECT d.doc_id, d.source, d.lang, s.split, strlen(d.text) AS bytes, l.quality, l.toxic, CASE WHEN length(d.text) > x.mean THEN 1 ELSE 0 END AS longer FROM documents d JOIN s USING (doc_id) JOIN x ON x.lang = d.lang LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with its split, labels and language dimension: one wide row for each document. A language that
    the dimension lacks is an error, not a row less; documents without a language are left out.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("bytes"), F.length("text").alias("n"))
    x = d.groupBy("lang").agg(F.avg("n").alias("mean"))
    j = d.withColumn("split", F.when(F.substring(_md5("1337:"), 1, 2) < "10", "val").otherwise("train")).filter("lang IS NOT NULL").join(x, "lang", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    j = j.withColumn("mean", F.coalesce("mean", F.raise_error(F.concat(F.lit("unknown language: "), F.col("lang"))).cast("double")))
    return j.select("doc_id", "source", "lang", "split", "bytes", "quality", "toxic", F.when(F.col("n") > F.col("mean"), 1).otherwise(0).alias("longer"))


_PLACES = (("GERMANY", "Prussia"), ("RUSSIA", "Russia"), ("ROMANIA", "Austria"), ("FRANCE", "France"), ("UNITED KINGDOM", "Britain"), ("CHINA", "China"))


@R.add(f"WITH p(place, state) AS (VALUES {', '.join(str(p) for p in _PLACES)}) SELECT coalesce(state, '(none)') AS state, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN p ON n_name = place GROUP BY ALL")
def state_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal lookup table (its size is that of the literal) joined to a dimension."""
    p = spark.createDataFrame(_PLACES, "place string, state string")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(p), F.col("n_name") == F.col("place"), "left")
    return s.groupBy(F.coalesce("state", F.lit("(none)")).alias("state")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@R.add("WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, strlen(text) AS b FROM documents), s AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, strlen(text) AS c FROM documents) SELECT count(*) AS n, sum(CASE WHEN b = c THEN 1 ELSE 0 END)::BIGINT AS verified FROM a JOIN s USING (k)")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th row of a stream with the n-th of a ledger, verified by size.

    Ordinals are dealt in ranges, so no task sees all rows.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("b"))
    stream = ordinals(spark, d, ["doc_id"], "k").select("k", "b")
    ledger = ordinals(spark, d.withColumnRenamed("b", "c"), ["doc_id"], "k").select("k", "c")
    return stream.join(ledger, "k").agg(F.count("*").alias("n"), F.count_if(F.col("b") == F.col("c")).alias("verified"))


@R.add("SELECT p_brand, arg_max(p_partkey, p_retailprice * 100000 + p_partkey) AS latest, count(*) AS writes FROM part GROUP BY p_brand")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each name, by an aggregate instead of a window."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.col("p_retailprice") * 100000 + F.col("p_partkey")).alias("latest"), F.count("*").alias("writes"))


@R.add(
    """WITH e AS (SELECT doc_id, (substr(md5('a:' || doc_id), 1, 1) = '0')::INT * 0.7 AS c FROM documents UNION ALL SELECT doc_id, (substr(md5('b:' || doc_id), 1, 1) = '1')::INT * 0.4 FROM documents), m AS (SELECT doc_id, max(c) AS c FROM e GROUP BY doc_id)
  SELECT count(*) AS kept, (SELECT count(*) FROM m WHERE c >= 0.5) AS dropped FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE c >= 0.5)"""
)
def repeated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest of repeated evidence decides; then an anti join."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = lambda p, x, v: F.when(F.substring(_md5(p), 1, 1) == x, v).otherwise(0.0).alias("c")
    m = d.select("doc_id", one("a:", "0", 0.7)).union(d.select("doc_id", one("b:", "1", 0.4))).groupBy("doc_id").agg(F.max("c").alias("c"))
    gone = m.filter("c >= 0.5").select("doc_id", F.lit(1).alias("g"))
    return d.join(gone, "doc_id", "left").agg(F.count_if(F.col("g").isNull()).alias("kept"), F.count("g").alias("dropped"))


_W = words("lower(text)")


@R.add(
    f"""WITH i AS (SELECT item_id, {_W} AS w FROM benchmark), p AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 12], ' ') AS passage FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 11))) AS k FROM i WHERE len(w) > 0))
  SELECT item_id, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM p JOIN (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents) d ON contains(t, ' ' || passage || ' ') GROUP BY item_id"""
)
def passages_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment as a theta join: every run of twelve words of an item, and short items as they are; an equi-join
    on a passage's first three words comes first, then the passage itself decides.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.lower("text")).alias("w")).filter("size(w) > 0")
    runs = b.select("item_id", F.explode(F.expr("transform(sequence(1, greatest(1, size(w) - 11)), k -> slice(w, k, 12))")).alias("p")).distinct()
    p = runs.select("item_id", F.array_join(F.slice("p", 1, 3), " ").alias("phrase"), F.concat(F.lit(" "), F.array_join("p", " "), F.lit(" ")).alias("passage"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.lower("text")).alias("w"))
    phrases = p.select("phrase").distinct()
    grams = F.expr("array_distinct(flatten(array(transform(sequence(1, greatest(1, size(w))), k -> array_join(slice(w, k, 3), ' ')), if({short}, w, array()), if({short}, transform(sequence(1, greatest(1, size(w))), k -> array_join(slice(w, k, 2), ' ')), array()))))".format(short=str(bool(runs.filter("size(p) < 3").limit(1).count())).lower()))
    hit = d.select("doc_id", F.explode(grams).alias("phrase")).join(phrases, "phrase", "left_semi").join(p, "phrase")
    pairs = hit.join(d.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t")), "doc_id").filter(F.expr("contains(t, passage)"))
    return pairs.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


@R.add(
    """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE length(text) > 1000), c AS (SELECT doc_id FROM documents WHERE lang = 'en')
  SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'union all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of unions, intersection and difference of id sets, from one aggregate over memberships."""
    d = table(spark, sf_dir, "documents")
    tagged = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(1).alias("s"))
    tagged = tagged.union(d.filter(F.length("text") > 1000).select("doc_id", F.lit(2))).union(d.filter("lang = 'en'").select("doc_id", F.lit(4)))
    m = tagged.groupBy("doc_id").agg(F.bit_or("s").alias("m"))
    g = m.agg(
        F.count("*").alias("union"),
        F.count_if(F.expr("m & 3 = 3")).alias("intersect"),
        F.count_if(F.expr("m & 2 = 2 AND m & 1 = 0")).alias("except"),
        F.sum(F.expr("(m & 1) + (m & 2) / 2")).cast("long").alias("union all"),
    )
    return g.unpivot([], ["union", "intersect", "except", "union all"], "op", "n")


@R.add("WITH m(model, base) AS (VALUES ('a', 0), ('b', 3), ('c', 7)), v AS (SELECT model, doc_id, (length(text) + base) % 3 AS y FROM documents, m) SELECT x.model AS left_model, z.model AS right_model, count(*) AS n, sum(CASE WHEN x.y = z.y THEN 1 ELSE 0 END)::BIGINT AS agree FROM v x JOIN v z ON x.doc_id = z.doc_id AND x.model < z.model GROUP BY ALL")
def rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of each pair of raters on the same items."""
    m = spark.createDataFrame([("a", 0), ("b", 3), ("c", 7)], "model string, base int")
    v = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).crossJoin(F.broadcast(m)).selectExpr("model", "doc_id", "(n + base) % 3 AS y")
    j = v.toDF("left_model", "doc_id", "p").join(v.toDF("right_model", "doc_id", "q"), "doc_id").filter("left_model < right_model")
    return j.groupBy("left_model", "right_model").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("agree"))
