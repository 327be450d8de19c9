"""Intervals, agreement, bootstraps and fits. Random draws come from hashes, so any engine repeats them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import stats as S
from skein.operators.ordering import ordinals
from skein.plans.base import Registry, table

R = Registry()

_RULE = "CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END"
_WLO = "greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n))"
_WHI = "least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n))"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("len"), F.octet_length("text").alias("b"), (F.length("text") > 1000).cast("int").alias("rule"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


@R.add(f"WITH a AS (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS k, sum(quality) / CAST(count(*) AS DOUBLE) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n, k, round({_WLO}, 9) AS low, round({_WHI}, 9) AS high FROM a")
def wilson_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents by language with its Wilson interval."""
    g = _rated(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.add("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(CASE WHEN count(*) > 1 THEN avg(n_chars) - 1.96 * stddev_samp(n_chars) / sqrt(count(*)) END, 6) AS low, round(CASE WHEN count(*) > 1 THEN avg(n_chars) + 1.96 * stddev_samp(n_chars) / sqrt(count(*)) END, 6) AS high FROM documents GROUP BY lang")
def mean_length_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.mean_interval(F.col("n_chars"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(m["n"].alias("n"), *(F.round(m[k], 6).alias(k) for k in ("mean", "low", "high")))


@R.add(f"SELECT quality AS human, {_RULE} AS model, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human label against a rule."""
    return _rated(spark, sf_dir).groupBy(F.col("quality").alias("human"), F.col("rule").alias("model")).agg(F.count("*").alias("n"))


@R.add(
    f"""WITH c AS (SELECT quality AS h, {_RULE} AS m, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c), o AS (SELECT sum(n) / max(t) AS po FROM c, t WHERE h = m),
  e AS (SELECT sum(a.n / t * b.n / t) AS pe FROM (SELECT h, sum(n) AS n FROM c GROUP BY h) a JOIN (SELECT m, sum(n) AS n FROM c GROUP BY m) b ON a.h = b.m, t) SELECT round(po, 9) AS observed, round(pe, 9) AS expected, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM o, e"""
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of label and rule: three numbers from the four cells."""
    c = confusion(spark, sf_dir).agg(*(F.sum(F.when((F.col("human") == h) & (F.col("model") == m), F.col("n")).otherwise(0)).cast("double").alias(f"c{h}{m}") for h in (0, 1) for m in (0, 1)))
    t = F.expr("c00 + c01 + c10 + c11")
    po, pe = F.expr("c00 + c11") / t, (F.expr("(c00 + c01) * (c00 + c10) + (c10 + c11) * (c01 + c11)")) / (t * t)
    return c.select(F.round(po, 9).alias("observed"), F.round(pe, 9).alias("expected"), F.round(S.kappa(po, pe), 9).alias("kappa"))


_DRAW = "(('0x' || substr(md5('boot:' || draw || ':' || slot), 1, 8))::BIGINT % k)"


@R.add(
    f"""WITH u AS (SELECT source, sum(quality) AS bad, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM documents JOIN labels USING (doc_id) GROUP BY source),
  r AS (SELECT d.draw, s.slot, (SELECT max(k) FROM u) AS k FROM range(200) d(draw), range((SELECT max(k) FROM u)) s(slot)), x AS (SELECT draw, sum(bad) / CAST(sum(n) AS DOUBLE) AS rate FROM r JOIN u ON u.i = {_DRAW.replace('k)', 'r.k)')} GROUP BY draw)
  SELECT (SELECT round(sum(bad) / CAST(sum(n) AS DOUBLE), 9) FROM u) AS point, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high FROM x"""
)
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of a rate with sources redrawn as clusters; draws are hashes of (draw, slot)."""
    u = _rated(spark, sf_dir).groupBy("source").agg(F.sum("quality").alias("bad"), F.count("*").alias("n"))
    o = ordinals(spark, u, ["source"], "i")  # clusters stay a table, however many there are
    k = o.agg(F.count("*").alias("k"), F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    draws = spark.range(200).withColumnRenamed("id", "draw").crossJoin(F.broadcast(k)).withColumn("slot", F.explode(F.expr("sequence(0L, k - 1)")))
    at = F.conv(F.substring(F.md5(F.concat(F.lit("boot:"), F.col("draw").cast("string"), F.lit(":"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("k")
    x = draws.select("draw", at.alias("i")).join(o, "i").groupBy("draw").agg((F.sum("bad") / F.sum("n")).alias("rate"))
    interval = x.agg(F.round(F.percentile("rate", 0.025), 9).alias("low"), F.round(F.percentile("rate", 0.975), 9).alias("high"))
    return k.select(F.round(F.col("all_bad") / F.col("all_n"), 9).alias("point")).crossJoin(interval)


@R.add(
    """WITH w AS (SELECT doc_id % 50 AS i, sum(length(text)) AS a, sum(strlen(text)) AS b FROM documents GROUP BY 1), k AS (SELECT count(*) AS k FROM w), o AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS j FROM w),
  r AS (SELECT draw, ('0x' || substr(md5('ratio:' || draw || ':' || slot), 1, 8))::BIGINT % k AS j FROM range(100) d(draw), range(50) s(slot), k WHERE slot < k), x AS (SELECT draw, sum(a) / CAST(sum(b) AS DOUBLE) AS v FROM r JOIN o USING (j) GROUP BY draw)
  SELECT round((SELECT sum(a) / CAST(sum(b) AS DOUBLE) FROM w), 9) AS ratio, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM x"""
)
def ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of two sums with windows redrawn, the same windows for both sums."""
    w = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 50).alias("i")).agg(F.sum(F.length("text")).alias("a"), F.sum(F.octet_length("text")).alias("b"))
    units = [(int(r["a"]), int(r["b"])) for r in w.orderBy("i").collect()]  # fifty windows at most
    k = len(units)
    o = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(units)], "j long, a long, b long")
    draws = spark.range(100).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = F.conv(F.substring(F.md5(F.concat(F.lit("ratio:"), F.col("draw").cast("string"), F.lit(":"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % k
    x = draws.withColumn("j", at).join(F.broadcast(o), "j").groupBy("draw").agg((F.sum("a") / F.sum("b")).alias("v"))
    return x.agg(F.round(F.lit(sum(a for a, _ in units) / sum(b for _, b in units)), 9).alias("ratio"), F.round(F.percentile("v", 0.025), 9).alias("low"), F.round(F.percentile("v", 0.975), 9).alias("high"))


@R.add(
    """WITH p AS (SELECT toxic, quality, avg(length(text)) AS m, var_samp(length(text)) / count(*) AS v FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
  SELECT round(sum(CASE WHEN toxic = quality THEN m ELSE -m END), 6) AS interaction, round(1.96 * sqrt(sum(v)), 6) AS half_width FROM p"""
)
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two differences of means, its errors added in quadrature."""
    p = _rated(spark, sf_dir).groupBy("toxic", "quality").agg(F.avg("len").alias("m"), (F.var_samp("len") / F.count("*")).alias("v"))
    return p.agg(F.round(F.sum(F.when(F.col("toxic") == F.col("quality"), F.col("m")).otherwise(-F.col("m"))), 6).alias("interaction"), F.round(1.96 * F.sqrt(F.sum("v")), 6).alias("half_width"))


_VERDICTS = "SELECT doc_id, m.model, (length(text) + m.base) % 3 AS y FROM documents, (VALUES ('a', 0), ('b', 3), ('c', 7)) m(model, base) WHERE (doc_id + m.base) % 4 <> 0"


@R.add(f"WITH v AS ({_VERDICTS}), g AS (SELECT d.doc_id, count(y) AS n, count(DISTINCT y) AS k, max(y) AS y FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id) SELECT CASE WHEN n >= 2 AND k = 1 THEN 'unanimous' ELSE 'split' END AS kind, count(*) AS items, sum(n)::BIGINT AS verdicts FROM g GROUP BY 1")
def unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on which at least two raters agree, and the others, those without verdict included."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    m = spark.createDataFrame([("a", 0), ("b", 3), ("c", 7)], "model string, base int")
    v = d.crossJoin(F.broadcast(m)).filter("(doc_id + base) % 4 <> 0").selectExpr("doc_id", "(n + base) % 3 AS y")
    g = d.select("doc_id").join(v, "doc_id", "left").groupBy("doc_id").agg(F.count("y").alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))
    return g.groupBy(F.when((F.col("n") >= 2) & (F.col("a") == F.col("b")), "unanimous").otherwise("split").alias("kind")).agg(F.count("*").alias("items"), F.sum("n").alias("verdicts"))


@R.add("WITH v AS (SELECT conv_id, turn, role, length(text) % 4 AS y FROM conversations) SELECT x.role, count(*) AS pairs, sum(CASE WHEN x.y = z.y THEN 1 ELSE 0 END)::BIGINT AS same, round(avg(abs(x.y - z.y)), 6) AS drift FROM v x JOIN v z ON x.conv_id = z.conv_id AND z.turn = x.turn + 2 GROUP BY x.role")
def self_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rater against itself two turns later."""
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") % 4).alias("y"))
    j = v.join(v.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("y").alias("z")), ["conv_id", "turn"])
    return j.groupBy("role").agg(F.count("*").alias("pairs"), F.count_if(F.col("y") == F.col("z")).alias("same"), F.round(F.avg(F.abs(F.col("y") - F.col("z"))), 6).alias("drift"))


@R.add(
    "SELECT user_id % 10 AS file, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS flagged, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS audit, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS observed, max(value) - min(value) AS spread FROM events GROUP BY 1"
)
def adjudication_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata and observed rate of each file, from one pass of conditional counts."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("file")).agg(
        F.count_if(F.col("event_type") == "click").alias("flagged"), F.count_if(F.col("event_type") == "view").alias("audit"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("observed"), (F.max("value") - F.min("value")).alias("spread")
    )


@R.add("SELECT lang, round(sum(ln(1 + length(text))) / ln(2) / sum(strlen(text)), 9) AS bits_a_byte, round(exp(avg(ln(1 + length(text)))), 6) AS perplexity FROM documents GROUP BY lang")
def bits_and_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nats to bits a byte and to perplexity."""
    nats = F.ln(1 + F.length("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(S.bits_a_byte(F.sum(nats), F.sum(F.octet_length("text"))), 9).alias("bits_a_byte"), F.round(F.exp(F.avg(nats)), 6).alias("perplexity"))


@R.add()
def stratified_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence from two strata with Jeffreys posteriors: point and percentiles of 20,000 seeded draws."""
    import numpy as np

    g = _rated(spark, sf_dir).groupBy("toxic").agg(F.sum("quality").alias("k"), F.count("*").alias("n")).collect()  # two rows
    total = sum(r["n"] for r in g)
    rng = np.random.default_rng(1337)
    draws = sum(r["n"] / total * rng.beta(r["k"] + 0.5, r["n"] - r["k"] + 0.5, 20_000) for r in sorted(g, key=lambda r: r["toxic"]))
    point = sum(r["k"] for r in g) / total
    return spark.createDataFrame([(float(point), float(np.quantile(draws, 0.025)), float(np.quantile(draws, 0.975)))], "point double, low double, high double")


@R.add()
def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent of loss = e + c n^-alpha through three rungs, with paired redraws of windows.

    The three rungs' window losses are joined by window; a draw has the same windows on all
    rungs, and each draw is fitted by bisection on its own.
    """
    w = table(spark, sf_dir, "documents").select((F.col("doc_id") % 200).alias("w"), F.length("text").alias("n"))
    loss = w.groupBy("w").agg(*(F.avg(F.lit(2.0) + 40.0 * F.pow(F.lit(float(size)), F.lit(-0.3)) + (F.col("n") % 7) * 0.001).alias(f"l{i}") for i, size in enumerate((47, 107, 349))))
    draws = loss.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49))))
    weight = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("w").cast("string")).cast("binary")), 1, 4), 16, 10).cast("long") % 3
    means = draws.withColumn("k", weight).groupBy("draw").agg(*((F.sum(F.col(f"l{i}") * F.col("k")) / F.sum("k")).alias(f"l{i}") for i in range(3)))

    @F.pandas_udf("double")
    def alpha(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x, y, z):
            low, high, want = 1e-3, 3.0, (x - y) / (y - z) if y != z else float("nan")
            ratio = lambda t: (47.0**-t - 107.0**-t) / (107.0**-t - 349.0**-t)
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if ratio(mid) < want else (low, mid)
            return (low + high) / 2

        return pd.Series([one(*t) for t in zip(a, b, c, strict=True)])

    fitted = means.select(alpha("l0", "l1", "l2").alias("alpha"))
    return fitted.agg(F.round(F.percentile("alpha", 0.5), 6).alias("alpha"), F.round(F.percentile("alpha", 0.025), 6).alias("low"), F.round(F.percentile("alpha", 0.975), 6).alias("high"))
