"""Duplicates, leakage, splits, samples and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import neardup as N
from skein.operators.ordering import ordinals, running
from skein.plans.base import Registry, count_of, table, words
from skein.plans.sequences import IDS, stream
from skein.session import Scratch

R = Registry()
PERMS = 64

_KEY = f"CASE WHEN len({words('text')}) > 0 THEN sha1(array_to_string({words('text')}, chr(1))) END"
_SH = lambda w: f"list_distinct(CASE WHEN len({w}) >= 5 THEN list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' ')) ELSE {w} END)"
#: CRC-32 of each distinct word, bit by bit from its polynomial
_CRC = f"""ct AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
  cw AS (SELECT DISTINCT unnest({words('text')}) AS w FROM documents),
  cc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS code FROM cw, ct)"""


def _minima(tokens: str) -> str:
    """CTE g(doc_id, sig) from CTE ``tokens`` (doc_id, pos, code)."""
    power = [f"{N.BASE ** (4 - j)}::UHUGEINT * {'code::UHUGEINT' if not j else f'lead(code::UHUGEINT, {j}) OVER o'}" for j in range(5)]
    least = ", ".join(f"min((h * {a}::UHUGEINT + {b}::UHUGEINT) % {N.MODULUS}::UHUGEINT)::BIGINT" for a, b in N.coefficients(PERMS))
    return f"""ph AS (SELECT doc_id, code::UHUGEINT AS one, ({' + '.join(power)}) % 18446744073709551616::UHUGEINT AS five, count(*) OVER (PARTITION BY doc_id) AS n FROM {tokens} WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  hs AS (SELECT doc_id, CASE WHEN n < 5 THEN one ELSE five END AS h FROM ph WHERE n < 5 OR five IS NOT NULL),
  g AS MATERIALIZED (SELECT doc_id, [{least}] AS sig FROM hs GROUP BY doc_id), k AS (SELECT sig, min(doc_id) AS rep FROM g GROUP BY sig)"""


_SIG = f"""{_CRC}, wp AS (SELECT doc_id, unnest({words('text')}) AS w, unnest(range(len({words('text')}))) AS pos FROM documents), tk AS (SELECT doc_id, pos, code FROM wp JOIN cc USING (w)), {_minima('tk')}"""


def _bands(rows: int) -> str:
    return f"b AS (SELECT rep, unnest(range({PERMS // rows})) AS band, unnest(list_transform(range({PERMS // rows}), lambda i: array_to_string(sig[i * {rows} + 1:i * {rows} + {rows}], '-'))) AS key FROM k)"


_AGREE = f"len(list_filter(range(1, {PERMS + 1}), lambda i: x.sig[i] = y.sig[i])) / {float(PERMS)}"
_LSH = f"""{_bands(8)}, p AS MATERIALIZED (SELECT DISTINCT x.rep AS a, y.rep AS b FROM b x JOIN b y USING (band, key) WHERE x.rep < y.rep),
  v AS (SELECT a, p.b, {_AGREE} AS similarity FROM p JOIN k x ON x.rep = a JOIN k y ON y.rep = p.b),
  l AS MATERIALIZED (SELECT a, b, similarity FROM v WHERE similarity >= 0.8 UNION ALL SELECT rep, doc_id, 1.0 FROM g JOIN k USING (sig) WHERE doc_id <> rep)"""
_PAIRS = f"{_SIG}, {_LSH}"


@R.add(f"SELECT {_KEY} AS key, count(*) AS n, min(doc_id) AS first, sum(strlen(text))::BIGINT - max(strlen(text)) AS redundant_bytes FROM documents GROUP BY ALL HAVING count(*) > 1 AND key IS NOT NULL")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal word sequences, and what all but the longest weigh."""
    d = table(spark, sf_dir, "documents").select("doc_id", N.exact_key("text").alias("key"), F.octet_length("text").cast("long").alias("b"))
    g = d.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), (F.sum("b") - F.max("b")).alias("redundant_bytes"))
    return g.filter("n > 1")


@R.add(f"SELECT doc_id, key, strlen(text) AS bytes FROM (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY {_KEY} ORDER BY strlen(text) DESC, doc_id) AS r FROM documents) WHERE r = 1 AND key IS NOT NULL")
def exact_keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each exact group: the longest, then the smallest id. An aggregate, no window."""
    d = table(spark, sf_dir, "documents").select("doc_id", N.exact_key("text").alias("key"), F.octet_length("text").cast("long").alias("bytes")).filter("key IS NOT NULL")
    return d.groupBy("key").agg(F.min(F.struct((-F.col("bytes")).alias("b"), "doc_id")).alias("k")).select("k.doc_id", "key", (-F.col("k.b")).alias("bytes"))


@R.add(f"SELECT count(*) AS docs, sum(len({words('text')}))::BIGINT AS tokens, sum(CASE WHEN r > 1 THEN 1 ELSE 0 END)::BIGINT AS redundant_docs, sum(CASE WHEN r > 1 THEN len({words('text')}) ELSE 0 END)::BIGINT AS redundant_tokens FROM (SELECT text, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS r FROM documents WHERE {_KEY} IS NOT NULL)")
def token_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens beyond the first of each exact group."""
    d = table(spark, sf_dir, "documents").select(N.exact_key("text").alias("key"), F.size(T.words("text")).cast("long").alias("t")).filter("key IS NOT NULL")
    g = d.groupBy("key").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.first("t").alias("one"))
    return g.agg(F.sum("n").alias("docs"), F.sum("t").alias("tokens"), F.sum(F.col("n") - 1).alias("redundant_docs"), F.sum(F.col("t") - F.col("one")).alias("redundant_tokens"))


def _sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.signatures(table(spark, sf_dir, "documents"), PERMS)


@R.add(f"WITH {_SIG} SELECT doc_id, array_to_string(sig, ',') AS sig FROM g")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minima of all permutations, as text."""
    return _sigs(spark, sf_dir).select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@R.add(f"WITH {_PAIRS} SELECT a, b FROM p")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct signatures, each under its smallest id, that share a bucket. A bucket of over
    ``N.LARGEST`` gives no pairs here: ``near_pairs`` verifies it as a whole.
    """
    scratch = Scratch(spark, "candidates")
    banded = scratch.table(N.bands(N.classes(_sigs(spark, sf_dir)), 8, "rep"), "bands")
    return N.candidates(banded, N.bucket_sizes(banded))


@R.add(f"WITH {_PAIRS} SELECT a, b, similarity FROM l")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs of distinct signatures, each under its smallest id, and the copies of each."""
    scratch = Scratch(spark, "near")
    return N.links(spark, scratch.table(_sigs(spark, sf_dir), "signatures"), scratch=scratch)


_CLUSTERS = f"""RECURSIVE {_PAIRS}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id), c AS (SELECT doc_id, min(c) AS cluster FROM r GROUP BY doc_id)"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters, and the signatures (a written table). Equal word sequences have equal signatures."""
    scratch = Scratch(spark, "duplicates")
    s = scratch.table(_sigs(spark, sf_dir), "signatures")
    return N.clusters(spark, N.links(spark, s, scratch=scratch).select("a", "b")), s


@R.add(f"WITH {_CLUSTERS} SELECT doc_id, cluster FROM c")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of exact and near links."""
    return _clusters(spark, sf_dir)[0]


_VERDICTS = f"""{_CLUSTERS}, q AS (SELECT cluster, doc_id, strlen(text) AS bytes, {_KEY} AS key, first_value(doc_id) OVER (PARTITION BY cluster ORDER BY strlen(text) DESC, doc_id) AS keep FROM c JOIN documents USING (doc_id)),
  n AS (SELECT cluster, CASE WHEN count(DISTINCT key) = 1 THEN 'exact' ELSE 'near' END AS kind FROM q GROUP BY cluster)"""


@R.add(f"WITH {_VERDICTS} SELECT kind, cluster, q.doc_id, q.doc_id = keep AS kept, bytes, round({_AGREE}, 3) AS agreement FROM q JOIN n USING (cluster) JOIN g x ON x.doc_id = q.doc_id JOIN g y ON y.doc_id = keep")
def duplicate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's kind, what it keeps (the longest), and how the others agree with it."""
    c, s = _clusters(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), N.exact_key("text").alias("key"))
    k = N.keep_longest(c.join(d, "doc_id"))
    kind = k.groupBy("cluster").agg(F.when(F.min("key") == F.max("key"), "exact").otherwise("near").alias("kind"))
    j = k.join(kind, "cluster").join(s, "doc_id").join(s.select(F.col("doc_id").alias("keep"), F.col("sig").alias("y")), "keep")
    return j.select("kind", "cluster", "doc_id", (F.col("doc_id") == F.col("keep")).alias("kept"), "bytes", F.round(N.agreement(F.col("sig"), F.col("y")), 3).alias("agreement"))


_SAVED = f"{_VERDICTS}, t AS (SELECT kind, count(DISTINCT cluster) AS clusters, count(*) FILTER (doc_id <> keep) AS dropped_docs, coalesce(sum(bytes) FILTER (doc_id <> keep), 0)::BIGINT AS dropped_bytes FROM q JOIN n USING (cluster) GROUP BY kind)"


@R.add(f"WITH {_SAVED} SELECT *, round(100.0 * dropped_bytes / (SELECT sum(strlen(text)) FROM documents), 6) AS pct FROM t")
def duplicate_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by kind, what the verdicts drop of them in documents and bytes, and the share of all bytes."""
    v = duplicate_verdicts(spark, sf_dir)
    total = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("all"))
    gone = F.col("kept") == F.lit(False)
    t = v.groupBy("kind").agg(F.count_distinct("cluster").alias("clusters"), F.count_if(gone).alias("dropped_docs"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("dropped_bytes"))
    return t.crossJoin(F.broadcast(total)).select("kind", "clusters", "dropped_docs", "dropped_bytes", F.round(F.col("dropped_bytes") * 100.0 / F.col("all"), 6).alias("pct"))


@R.add(f"WITH {_CLUSTERS} SELECT cluster, count(*) AS n FROM c GROUP BY cluster ORDER BY n DESC, cluster LIMIT 10")
def largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest clusters."""
    return _clusters(spark, sf_dir)[0].groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(10)


# ---- the same on token streams

_STREAM = f"""ti AS MATERIALIZED (SELECT doc_id, {IDS} AS ids FROM documents), tk AS (SELECT doc_id, unnest(ids[:-2]) AS code, unnest(range(len(ids) - 1)) AS pos FROM ti WHERE len(ids) > 1), {_minima('tk')}"""


@R.add(
    f"""WITH RECURSIVE {_STREAM}, {_LSH}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id), c AS (SELECT doc_id, min(c) AS cluster FROM r GROUP BY doc_id),
  x AS (SELECT len(ids) AS n, row_number() OVER (PARTITION BY array_to_string(ids, ' ') ORDER BY doc_id) AS e, row_number() OVER (PARTITION BY coalesce(cluster, -1 - doc_id) ORDER BY len(ids) DESC, doc_id) AS m FROM ti LEFT JOIN c USING (doc_id))
  SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, sum((e > 1)::INT)::BIGINT AS exact_docs, coalesce(sum(n) FILTER (e > 1), 0)::BIGINT AS exact_tokens, sum((m > 1)::INT)::BIGINT AS near_docs, coalesce(sum(n) FILTER (m > 1), 0)::BIGINT AS near_tokens FROM x"""
)
def token_stream_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundant documents and tokens of the token stream: beyond the first of each exact group (on the ids'
    bytes), and beyond the longest of each cluster of near copies (shingles of ids).
    """
    scratch = Scratch(spark, "stream")
    ids = stream(spark, sf_dir)
    s = scratch.table(N.signatures(ids.select("doc_id", F.expr("slice(ids, 1, size(ids) - 1)").alias("ids")), PERMS, tokens="ids"), "signatures")
    near = N.clusters(spark, N.links(spark, s, scratch=scratch).select("a", "b"))
    d = ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("key"))
    exact = d.groupBy("key").agg(F.count("*").alias("k"), F.first("n").alias("one")).agg(F.sum("k").alias("docs"), F.sum(F.col("k") * F.col("one")).alias("tokens"), F.sum(F.col("k") - 1).alias("exact_docs"), F.sum((F.col("k") - 1) * F.col("one")).alias("exact_tokens"))
    g = d.join(near, "doc_id").groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("most"))
    rest = g.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("near_docs"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("near_tokens"))
    return exact.crossJoin(rest)


_CONT = f"""i AS (SELECT item_id, unnest({_SH('w')}) AS s FROM (SELECT item_id, {words('lower(text)')} AS w FROM benchmark)), t AS (SELECT DISTINCT s FROM (SELECT unnest({_SH('w')}) AS s FROM (SELECT {words('lower(text)')} AS w FROM documents))),
  c AS (SELECT item_id, count(*) AS n, count(t.s) AS matched, round(count(t.s) / CAST(count(*) AS DOUBLE), 6) AS containment FROM i LEFT JOIN t USING (s) GROUP BY item_id)"""


@R.add(f"WITH {_CONT} SELECT * FROM c")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item stands in the corpus."""
    return N.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@R.add(f"WITH {_CONT} SELECT count(*) AS items, round(avg(containment), 6) AS mean, round(quantile_cont(containment, 0.5), 6) AS median, round(quantile_cont(containment, 0.9), 6) AS p90, max(containment) AS max, sum(CASE WHEN containment >= 0.1 THEN 1 ELSE 0 END)::BIGINT AS ge_10, sum(CASE WHEN containment >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS ge_50, sum(CASE WHEN containment >= 0.9 THEN 1 ELSE 0 END)::BIGINT AS ge_90 FROM c")
def containment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = containment(spark, sf_dir), F.col("containment")
    return c.agg(F.count("*").alias("items"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.9), 6).alias("p90"), F.max(v).alias("max"), *(F.count_if(v >= t / 100).alias(f"ge_{t}") for t in (10, 50, 90)))


_VAL = "substr(md5('1337:' || doc_id), 1, 2) < '10'"
_MATCH = f"""{_SIG}, sd AS (SELECT doc_id, sig, {_VAL} AS held FROM g), sk AS (SELECT held, sig, min(doc_id) AS rep FROM sd GROUP BY held, sig), {_bands(4).replace('FROM k)', 'FROM sk)')}, p AS MATERIALIZED (SELECT DISTINCT x.rep AS val, y.rep AS train FROM b x JOIN b y USING (band, key) JOIN sk m ON m.rep = x.rep AND m.held JOIN sk o ON o.rep = y.rep AND NOT o.held),
  q AS (SELECT val, train, {_AGREE} AS agreement FROM p JOIN sk x ON x.rep = val JOIN sk y ON y.rep = train), w AS (SELECT val, agreement, train FROM (SELECT *, row_number() OVER (PARTITION BY val ORDER BY agreement DESC, train) AS r FROM q) WHERE r = 1 AND agreement >= 0.4),
  m AS (SELECT sd.doc_id AS val, agreement, train FROM sd JOIN sk ON sd.sig = sk.sig AND sk.held JOIN w ON w.val = sk.rep WHERE sd.held)"""


def _side(c: str = "doc_id"):
    return F.substring(F.md5(F.concat(F.lit("1337:"), F.col(c).cast("string")).cast("binary")), 1, 2) < "10"


@R.add(f"WITH {_MATCH} SELECT * FROM m")
def best_train_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar training document of each held-out one, by low-threshold bands."""
    s = Scratch(spark, "leakage").table(_sigs(spark, sf_dir), "signatures")
    return N.best_matches(spark, s, _side()).filter("agreement >= 0.4").withColumnRenamed("held", "val")


@R.add(f"WITH {_MATCH} SELECT val, agreement, train FROM m ORDER BY agreement DESC, val LIMIT 20")
def closest_train_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty held-out documents that agree most with a training one."""
    return best_train_match(spark, sf_dir).orderBy(F.desc("agreement"), "val").limit(20)


@R.add(f"WITH {_MATCH} SELECT doc_id, CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS side FROM documents WHERE doc_id NOT IN (SELECT val FROM m WHERE agreement >= 0.5)")
def split_without_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split after held-out documents with too close a training match are taken out."""
    gone = best_train_match(spark, sf_dir).filter("agreement >= 0.5").select(F.col("val").alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(gone, "doc_id", "left_anti")
    return d.select("doc_id", F.when(_side(), "val").otherwise("train").alias("side"))


# ---- splits and samples


def _order(c: str = "doc_id"):
    return F.md5(F.concat(F.lit("1337:"), F.col(c).cast("string")).cast("binary"))


@R.add(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1337:' || doc_id)) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
  SELECT doc_id, source, CASE WHEN k <= greatest(1, round_even(n * 0.05, 0)) THEN 'val' ELSE 'train' END AS side FROM r"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the first max(1, round(n / 20)) documents in hash order are held out.

    Ids and hashes are ordered in ranges that cut across sources; a document's rank in its source
    is its place less the documents of the sources before, one row for each source.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _order().alias("h"))
    n = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("source")) - F.col("n"))
    ranked = in_groups(spark, d, n, ["h", "doc_id"])
    return ranked.select("doc_id", "source", F.when(F.col("k") < F.greatest(F.lit(1), F.bround(F.col("n") * 0.05)), "val").otherwise("train").alias("side"))


def in_groups(spark: SparkSession, d: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    """``d`` with ``k``, the place (from 0) of each document in its source, and the source's ``n``."""
    return ordinals(spark, d, ["source", *keys], "place").join(n, "source").withColumn("k", F.col("place") - F.col("before")).drop("place", "before")


@R.add(
    """WITH r AS (SELECT doc_id, source, strlen(text) AS b, coalesce(sum(strlen(text)) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor, sum(strlen(text)) OVER () AS total FROM documents)
  SELECT source, count(*) AS docs, sum(b)::BIGINT AS bytes, min(cursor)::BIGINT AS first_byte FROM r WHERE cursor + b > total * 0.9 GROUP BY source"""
)
def positional_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of the bytes in the order of source and id: which sources it holds.

    Offsets are exact but no task sees all rows: ids and sizes are ordered in ranges.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("b"))
    total = d.agg(F.sum("b").alias("total"))
    r = running(spark, d, ["source", "doc_id"], "b", "cursor").crossJoin(F.broadcast(total))
    return r.filter(F.col("cursor") + F.col("b") > F.col("total") * 0.9).groupBy("source").agg(F.count("*").alias("docs"), F.sum("b").alias("bytes"), F.min("cursor").alias("first_byte"))


@R.add("WITH r AS (SELECT doc_id, lang, strlen(text) AS b, coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY md5('1337:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) SELECT doc_id, lang, CAST(used AS BIGINT) AS used FROM r WHERE used < 20000")
def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in hash order while a language's byte budget lasts (ids, sizes and hashes are ordered, in ranges)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("b"), _order().alias("h"))
    before = d.groupBy("lang").agg(F.sum("b").alias("s")).select("lang", (F.sum("s").over(Window.orderBy("lang")) - F.col("s")).alias("before"))
    r = running(spark, d, ["lang", "h", "doc_id"], "b", "cursor").join(before, "lang")
    return r.withColumn("used", F.col("cursor") - F.col("before")).filter("used < 20000").select("doc_id", "lang", "used")


@R.add(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT source, n, unnest(range(least(5, n))) AS i FROM (SELECT DISTINCT source, n FROM r))
  SELECT r.source, i, doc_id FROM p JOIN r ON r.source = p.source AND r.k = i * (p.n - 1) // greatest(1, least(5, p.n) - 1)"""
)
def systematic_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced documents of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("source")) - F.col("n"))
    p = n.select("source", F.explode(F.expr("sequence(0L, least(5, n) - 1)")).alias("i"), "n").selectExpr("source", "i", "i * (n - 1) div greatest(1, least(5, n) - 1) AS k")
    return p.join(in_groups(spark, d, n, ["doc_id"]), ["source", "k"]).select("source", "i", "doc_id")


@R.add(
    """WITH old AS (SELECT doc_id FROM documents WHERE substr(md5('old:' || doc_id), 1, 1) = '0'), r AS (SELECT d.doc_id, lang, old.doc_id IS NOT NULL AS carried, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN old.doc_id IS NULL THEN 1 ELSE 0 END, md5('1337:' || d.doc_id)) AS k FROM documents d LEFT JOIN old ON old.doc_id = d.doc_id WHERE length(text) >= 500)
  SELECT doc_id, lang, carried FROM r WHERE k <= 10"""
)
def carry_over_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language: first what survives of an old draw, then new ones in hash order."""
    d = table(spark, sf_dir, "documents")
    old = d.filter(F.substring(F.md5(F.concat(F.lit("old:"), F.col("doc_id").cast("string")).cast("binary")), 1, 1) == "0").select("doc_id", F.lit(True).alias("was"))
    j = d.filter(F.length("text") >= 500).select("doc_id", "lang").join(old, "doc_id", "left").select("doc_id", "lang", F.coalesce("was", F.lit(False)).alias("carried"))
    w = Window.partitionBy("lang").orderBy(F.desc("carried"), _order())
    return j.withColumn("k", F.row_number().over(w)).filter("k <= 10").drop("k")


# ---- exclusions

_ARMS = {"marker": "contains(lower(text), 'password') OR contains(lower(text), 'secret')", "rights": "regexp_matches(lower(text), 'all rights reserved')", "short": "length(text) < 100", "address": "contains(text, '@')", "figures": f"{count_of('text', '[0-9]')} > 0.05 * length(text)", "unnamed": "lang IS NULL OR source IS NULL"}
_EXCL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS arm FROM documents WHERE {c}" for k, c in _ARMS.items()) + f" UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'duplicate' FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY strlen(text) DESC, doc_id) AS r, {_KEY} AS key FROM documents) WHERE r > 1 AND key IS NOT NULL"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, arm): each piece of evidence against a document."""
    d = table(spark, sf_dir, "documents")
    low = F.lower("text")
    tests = {"marker": low.contains("password") | low.contains("secret"), "rights": low.contains("all rights reserved"), "short": F.length("text") < 100, "address": F.col("text").contains("@"), "figures": T.count_of("text", "[0-9]") > 0.05 * F.length("text"), "unnamed": F.col("lang").isNull() | F.col("source").isNull()}
    own = d.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in tests.items())))).alias("arm"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("arm"))
    keyed = d.select("doc_id", N.exact_key("text").alias("key"), F.octet_length("text").alias("b")).filter("key IS NOT NULL")
    best = keyed.groupBy("key").agg(F.min(F.struct((-F.col("b")).alias("b"), "doc_id")).alias("k"))
    double = keyed.join(best, "key").filter("doc_id <> k.doc_id").select("doc_id", F.lit("duplicate").alias("arm"))
    return own.unionByName(toxic).unionByName(double)


@R.add(f"WITH a AS ({_EXCL}) SELECT coalesce(arm, 'any') AS arm, count(DISTINCT doc_id) AS docs FROM a GROUP BY ROLLUP (arm)")
def exclusion_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by arm, and their distinct union."""
    a = arms(spark, sf_dir).distinct()
    any_arm = a.select("doc_id").distinct().agg(F.count("*").alias("docs")).select(F.lit("any").alias("arm"), "docs")
    return a.groupBy("arm").agg(F.count("*").alias("docs")).unionByName(any_arm)


@R.add(f"WITH a AS ({_EXCL}) SELECT doc_id, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms FROM a GROUP BY doc_id")
def exclusion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"))


@R.add(f"WITH a AS ({_EXCL}) SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) < 300 AND doc_id NOT IN (SELECT doc_id FROM a)")
def exclusion_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful documents that no arm excludes."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") < 300)
    return d.join(arms(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id", F.length("text").cast("long").alias("n_chars"))
