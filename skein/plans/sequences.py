"""Ordered data: carry-forward, retention, rates, schedules, queues, windows of token streams, event dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.ordering import ordinals, running
from skein.plans.base import Registry, table, words

R = Registry()


@R.add("SELECT user_id, event_id, ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the latest value of another kind of row before it: an as-of join by order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


@R.add("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 2 OR event_id % 50 = 0")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the latest two of each lineage and every fiftieth."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2 OR event_id % 50 = 0")


@R.add(
    "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER w AS t0, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, round((value - v0) * 1000000.0 / (t - t0), 9) AS rate FROM e WHERE t > t0"
)
def moving_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change a second between log rows."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    e = e.withColumn("t0", F.lag("t").over(w)).withColumn("v0", F.lag("value").over(w)).filter("t > t0")
    return e.select("user_id", "event_id", F.round((F.col("value") - F.col("v0")) * 1000000.0 / (F.col("t") - F.col("t0")), 9).alias("rate"))


@R.add(
    """SELECT step::BIGINT AS step, round(CASE WHEN step < 100 THEN (step + 1) / 100.0 WHEN step < 900 THEN 1.0 ELSE 0.1 + 0.9 * (1 - (step - 900) / 100.0) END, 9) AS flat_then_linear,
  round(CASE WHEN step < 100 THEN (step + 1) / 100.0 ELSE 0.1 + 0.45 * (1 + cos(pi() * (step - 100) / 900.0)) END, 9) AS cosine FROM range(1000) t(step)"""
)
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two piecewise schedules by step."""
    s = F.col("id")
    warm = F.when(s < 100, (s + 1) / 100.0)
    return spark.range(1000).select(s.alias("step"), F.round(warm.when(s < 900, 1.0).otherwise(0.1 + 0.9 * (1 - (s - 900) / 100.0)), 9).alias("flat_then_linear"), F.round(warm.otherwise(0.1 + 0.45 * (1 + F.cos(F.pi() * (s - 100) / 900.0))), 9).alias("cosine"))


_HASH = "('0x' || substr(md5('q:' || conv_id), 1, 6))::BIGINT"


@R.add(
    f"""WITH c AS (SELECT DISTINCT conv_id, {_HASH} AS h FROM conversations), o AS (SELECT conv_id, h, row_number() OVER (ORDER BY h, conv_id) - 1 AS home, count(*) OVER () AS n FROM c),
  q AS (SELECT conv_id, 'first' AS kind, CAST(home AS DOUBLE) AS pos FROM o UNION ALL SELECT conv_id, 'again', home + 5 + (h % 1000) / 1000.0 * greatest(0, n - home - 5) FROM o WHERE home < 0.7 * n AND h % 10 = 0) SELECT * FROM q"""
)
def interleaved_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with repeats at fractional places, each at least five after its original; sorted by ``pos`` when read."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("q:"), F.col("conv_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("h", h)
    o = ordinals(spark, c, ["h", "conv_id"], "home").crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))
    again = o.filter("home < 0.7 * n AND h % 10 = 0").select("conv_id", F.lit("again").alias("kind"), (F.col("home") + 5 + (F.col("h") % 1000) / 1000.0 * F.greatest(F.lit(0), F.col("n") - F.col("home") - 5)).alias("pos"))
    return o.select("conv_id", F.lit("first").alias("kind"), F.col("home").cast("double").alias("pos")).unionByName(again)


@R.add("SELECT event_type, count(*) AS n FROM (SELECT user_id, event_type, value, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY event_type")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without repetitions of the same user, type and value (the stream's batch twin)."""
    return table(spark, sf_dir, "events").dropDuplicates(["user_id", "event_type", "value"]).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add(
    "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows with a gap of thirty minutes."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


@R.add("WITH e AS (SELECT event_type, min(ts) AS first, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, coalesce(list_position(['purchase', 'click', 'view'], event_type), 99)::INT AS priority FROM e")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal list decides the order, the rest follow."""
    at = F.array_position(F.array(*map(F.lit, ("purchase", "click", "view"))), F.col("event_type"))
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("priority", F.when(at > 0, at).otherwise(99).cast("int"))
    return g.orderBy("priority", "event_type")


_FRESH = "substr(md5('side:' || event_id), 1, 1) < '8'"


@R.add(f"WITH old AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE NOT {_FRESH} GROUP BY ALL), new AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE {_FRESH} GROUP BY ALL) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.v, o.v) AS v, n.v IS NOT NULL AS fresh FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded cache with newer rows taking the place of older ones. Every event is on one side, by its hash."""
    e = table(spark, sf_dir, "events").withColumn("fresh", F.substring(F.md5(F.concat(F.lit("side:"), F.col("event_id").cast("string")).cast("binary")), 1, 1) < "8")
    side = lambda keep, n: e.filter(keep).groupBy("user_id", "event_type").agg(F.max("event_id").alias(n))
    j = side("NOT fresh", "o").join(side("fresh", "n"), ["user_id", "event_type"], "full_outer")
    return j.select("user_id", "event_type", F.coalesce("n", "o").alias("v"), F.col("n").isNotNull().alias("fresh"))


# ---- token streams: documents end with id 0

IDS = f"list_append(list_transform({words('lower(text)')}, lambda w: (('0x' || substr(md5(w), 1, 6))::BIGINT % 7999) + 1), 0)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): words as ids of a hashed vocabulary, with the end id."""
    code = F.transform(T.words(F.lower("text")), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("long") % 7999 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_append(code, F.lit(0).cast("long")).alias("ids"))


def bounds(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """(doc_id, start, stop) in the stream of all documents: sums over one row for each document, in ranges."""
    n = ids.select("doc_id", F.size("ids").cast("long").alias("n"))
    return running(spark, n, ["doc_id"], "n", "start").selectExpr("doc_id", "start", "start + n AS stop")


@R.add(f"WITH s AS (SELECT doc_id, {IDS} AS ids FROM documents), b AS (SELECT doc_id, sum(len(ids)) OVER (ORDER BY doc_id) AS stop, len(ids) AS n FROM s) SELECT doc_id, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM b")
def document_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the stream; a document ends where its end id stands."""
    return bounds(spark, stream(spark, sf_dir))


@R.add(
    f"""WITH s AS (SELECT doc_id, unnest({IDS}) AS t, unnest(range(len({IDS}))) AS k FROM documents), p AS (SELECT t, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM s), m AS (SELECT count(*) // 256 AS w FROM s),
  v AS (SELECT DISTINCT i, CAST(floor(i * (w - 1) / 15.0) AS BIGINT) * 256 AS start FROM range(16) r(i), m)
  SELECT i, start, sum(t)::BIGINT AS total, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END)::BIGINT AS ends, count(*) AS n FROM v JOIN p ON pos >= start AND pos < start + 256 GROUP BY ALL"""
)
def evaluation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen windows of 256 tokens, evenly spread over the stream.

    Windows meet documents by the blocks of the stream that both touch (an equi-join), and
    only the overlapping slices are exploded.
    """
    ids = stream(spark, sf_dir)
    b = bounds(spark, ids)
    total = b.agg(F.max("stop").alias("total"))
    v = spark.range(16).crossJoin(F.broadcast(total)).selectExpr("id AS i", "cast(floor(id * (total div 256 - 1) / 15.0D) AS long) * 256 AS at")
    d = ids.join(b, "doc_id").withColumn("block", F.explode(F.expr("sequence(start div 256, (stop - 1) div 256)")))
    j = d.join(F.broadcast(v.withColumn("block", F.expr("at div 256"))), "block")
    cut = F.expr("slice(ids, cast(greatest(at - start, 0) + 1 AS int), cast(least(stop, at + 256) - greatest(start, at) AS int))")
    t = j.select("i", F.col("at").alias("start"), F.explode(cut).alias("t"))
    return t.groupBy("i", "start").agg(F.sum("t").alias("total"), F.count_if(F.col("t") == 0).alias("ends"), F.count("*").alias("n"))


@R.add(f"WITH s AS (SELECT doc_id, {IDS} AS ids FROM documents) SELECT doc_id, CAST(len(ids) - 1 AS BIGINT) AS pairs, CAST(list_sum(list_transform(range(1, len(ids)), lambda i: ids[i] * 3 + ids[i + 1])) AS BIGINT) AS checksum FROM s WHERE len(ids) > 1")
def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and targets shifted by one, checked by a sum over the pairs."""
    d = stream(spark, sf_dir).filter("size(ids) > 1")
    pairs = F.expr("zip_with(slice(ids, 1, size(ids) - 1), slice(ids, 2, size(ids)), (x, y) -> x * 3 + y)")
    return d.select("doc_id", (F.size("ids") - 1).cast("long").alias("pairs"), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))
