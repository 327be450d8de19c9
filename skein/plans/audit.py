"""Audits: years, orthography, corruption, lexicons, screens, samples, catalogue classes, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import config
from skein.config import POLISH_BATTERY, WESTERN_BATTERY
from skein.functions import stats as S
from skein.functions import text as T
from skein.operators.ordering import ordinals
from skein.plans.base import BLANK, Registry, count_of, quote, strip, table, words
from skein.plans.quality import _PER_DOC, document_rates
from skein.plans.sequences import IDS, bounds, stream

R = Registry()


def _hash(prefix: str, *columns: str):
    """The first 32 bits of the MD5 of a prefix and columns, as SQL can say it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(prefix), *(F.col(c).cast("string") for c in columns)).cast("binary")), 1, 8), 16, 10).cast("long")


def _sql_hash(prefix: str, *columns: str) -> str:
    return f"('0x' || substr(md5('{prefix}:' || {' || chr(58) || '.join(columns)}), 1, 8))::BIGINT"


# ---- years and orthography

_RUNS = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) = 4 AND r >= '{0}' AND r <= '{1}')"
_CONTEXT = r"(len(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(?:r\.|roku|rok|w\s+r\.)\s{{1,2}}(?:19[2-9][0-9]|20[0-9][0-9])(?:[^0-9]|$)|(?:^|[^0-9])(?:19[2-9][0-9]|20[0-9][0-9])\s{{1,2}}r\.')))".replace("{{", "{").replace("}}", "}")


@R.add(f"SELECT CAST(y AS BIGINT) // 10 * 10 AS decade, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_RUNS.format(1000, 9999)}) AS y FROM documents) GROUP BY ALL")
def year_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated four-digit years (any, as the tables have few) by decade: occurrences, and documents with one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.digit_runs("text", 1000, 9999)).alias("y"))
    per = d.groupBy((F.floor(F.col("y").cast("long") / 10) * 10).alias("decade"), "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("decade").agg(F.sum("k").alias("occurrences"), F.count("*").alias("docs"))


@R.add(
    f"""WITH d AS (SELECT len({_RUNS.format(1920, 2099)}) AS bare, {_CONTEXT} AS dated, len({_RUNS.format(1000, 9999)}) AS any_year FROM documents)
  SELECT CAST(t AS BIGINT) AS at_least, sum((bare >= t)::INT)::BIGINT AS bare, sum((dated >= t)::INT)::BIGINT AS dated, sum((any_year >= t)::INT)::BIGINT AS any_year FROM d, (VALUES (1), (2), (3), (5), (10)) v(t) GROUP BY t"""
)
def year_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least so many years after the period: bare ones, ones written as dates, and any four digits."""
    d = table(spark, sf_dir, "documents").select(F.size(T.digit_runs("text", 1920, 2099)).alias("bare"), F.size(T.context_years("text")).alias("dated"), F.size(T.digit_runs("text", 1000, 9999)).alias("any_year"))
    at = F.explode(F.expr("array(1L, 2L, 3L, 5L, 10L)")).alias("at_least")
    return d.select("*", at).groupBy("at_least").agg(*(F.count_if(F.col(c) >= F.col("at_least")).alias(c) for c in ("bare", "dated", "any_year")))


_ORTO = lambda glide: f"CAST(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '(?i)^.+[csz]{glide}[aeięąo]'))) AS BIGINT)"


@R.add(f"SELECT doc_id, {_ORTO('j')} AS modern, {_ORTO('y')} AS period, round({_ORTO('j')} / nullif(CAST({_ORTO('j')} + {_ORTO('y')} AS DOUBLE), 0), 6) AS share FROM documents")
def orthography_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in -cja and in the older -cya of each document, and the share of the first; null if there are none."""
    m, p = T.orthography("text")
    d = table(spark, sf_dir, "documents").select("doc_id", m.alias("modern"), p.alias("period"))
    return d.withColumn("share", F.round(F.col("modern") / F.nullif(F.col("modern") + F.col("period"), F.lit(0)), 6))


@R.add(
    f"""WITH o AS (SELECT {_ORTO('t')} AS m, {_ORTO('h')} AS p FROM documents) SELECT CAST(t AS DOUBLE) AS threshold, sum((m >= 20 AND m >= t * (m + p))::INT)::BIGINT AS docs, sum((m >= 3 AND m >= t * (m + p))::INT)::BIGINT AS docs_of_three FROM o, (VALUES (0.5), (0.8), (0.9)) v(t) GROUP BY t"""
)
def orthography_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twenty (or three) words of the modern spelling or more, by its least share (-ct- against -ch- here)."""
    has = lambda glide: T.matching(T.word_runs("text"), rf"(?iu)^.+[csz]{glide}[aeięąo]")
    d = table(spark, sf_dir, "documents").select(has("t").alias("m"), has("h").alias("p"))
    d = d.select("*", F.explode(F.array(F.lit(0.5), F.lit(0.8), F.lit(0.9))).alias("threshold"))
    enough = F.col("m") >= F.col("threshold") * (F.col("m") + F.col("p"))
    return d.groupBy("threshold").agg(F.count_if((F.col("m") >= 20) & enough).alias("docs"), F.count_if((F.col("m") >= 3) & enough).alias("docs_of_three"))


@R.add("SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, unnest(list_filter(regexp_extract_all(l_shipdate::VARCHAR || '_scan.txt', '[0-9]+'), lambda r: length(r) = 4 AND r >= '1995')) AS y FROM lineitem) GROUP BY l_suppkey")
def name_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names (of a date here) that hold a year from a least one on, by owner."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("_scan.txt")).alias("name"))
    return d.select("l_suppkey", F.explode(T.digit_runs("name", 1995, 9999))).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@R.add("SELECT o_orderstatus, count(*) AS n, sum((regexp_extract(o_orderdate::VARCHAR, '[0-9]{4}')::INT > 1995)::INT)::BIGINT AS later FROM orders GROUP BY o_orderstatus")
def later_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose date's first four digits are after a year."""
    first = F.expr("try_cast(regexp_extract(date_format(o_orderdate, 'yyyy-MM-dd'), '[0-9]{4}', 0) AS int)")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(first > 1995).alias("later"))


@R.add(
    """WITH s AS (SELECT l_orderkey, min(year(l_shipdate)) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) SELECT count(*) AS orders, count(y) AS both_known, sum((year(o_orderdate) = y)::INT)::BIGINT AS agree, round(sum((year(o_orderdate) = y)::INT) / nullif(CAST(count(y) AS DOUBLE), 0), 6) AS rate FROM orders LEFT JOIN s ON l_orderkey = o_orderkey"""
)
def year_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two derived years agree where both are known: an order's, and that of its first returned or accepted line."""
    s = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.year("l_shipdate")).alias("y"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("x")).join(s, "o_orderkey", "left")
    agree = F.count_if(F.col("x") == F.col("y"))
    return j.agg(F.count("*").alias("orders"), F.count("y").alias("both_known"), agree.alias("agree"), F.round(agree / F.nullif(F.count("y"), F.lit(0)), 6).alias("rate"))


# ---- corruption, batteries


@R.add(
    f"""WITH s AS (SELECT source, sum(words)::BIGINT AS words, sum(suspicious)::BIGINT AS suspicious FROM ({_PER_DOC}) GROUP BY source), r AS (SELECT *, 100.0 * suspicious / words AS p FROM s)
  SELECT source, words, suspicious, round(p, 6) AS pct, round((SELECT min(p) FROM r), 6) AS floor_pct, round(p - (SELECT min(p) FROM r), 6) AS above FROM r"""
)
def corruption_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of suspicious words by source, the lowest rate as the floor, and the difference."""
    s = document_rates(spark, sf_dir).groupBy("source").agg(F.sum("words").alias("words"), F.sum("suspicious").alias("suspicious"))
    r = s.withColumn("p", 100.0 * F.col("suspicious") / F.col("words"))
    least = F.min("p").over(Window.partitionBy())  # one row for each source
    return r.select("source", "words", "suspicious", F.round("p", 6).alias("pct"), F.round(least, 6).alias("floor_pct"), F.round(F.col("p") - least, 6).alias("above"))


def _count_sql(stem: str) -> str:
    return f"((length(low) - length(replace(low, '{stem}', ''))) // {len(stem)})"


_MODERN_SQL = " + ".join([*map(_count_sql, WESTERN_BATTERY.stems), *(count_of("low", p) for p in WESTERN_BATTERY.patterns.values())])
_CONTROL_SQL = " + ".join(map(_count_sql, WESTERN_BATTERY.control))
_SCAN_SQL = f"SELECT doc_id, source, ({_MODERN_SQL})::BIGINT AS modern, ({_CONTROL_SQL})::BIGINT AS control, {_ORTO('j')} AS orto_modern, {_ORTO('y')} AS orto_period, length(text) AS chars, strlen(text) AS bytes FROM (SELECT doc_id, source, text, lower(text) AS low FROM documents)"


def battery_scan(low, text, battery):
    """Struct of one text's marks: modern and control occurrences, both spellings, characters, bytes."""
    modern = [T.substring_count(low, s) for s in battery.stems] + [T.count_of(low, p) for p in battery.patterns.values()]
    control = [T.substring_count(low, s) for s in battery.control]
    total = lambda xs: sum(xs[1:], xs[0]).cast("long")
    m, p = T.orthography(text)
    return F.struct(total(modern).alias("modern"), total(control).alias("control"), m.alias("orto_modern"), p.alias("orto_period"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))


@R.add(f"SELECT doc_id, modern, control, orto_modern, orto_period, chars, bytes FROM ({_SCAN_SQL})")
def battery_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The struct of each document, as columns."""
    return table(spark, sf_dir, "documents").select("doc_id", battery_scan(F.lower("text"), F.col("text"), WESTERN_BATTERY).alias("s")).select("doc_id", "s.*")


_W2 = "1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))"


@R.add(
    f"""WITH g AS (SELECT source, count(*) AS n, sum((modern > 0)::INT) AS k, sum((modern > 0)::INT) / CAST(count(*) AS DOUBLE) AS p, round(100000.0 * sum(modern) / sum(bytes), 6) AS per_100k FROM ({_SCAN_SQL}) GROUP BY source)
  SELECT source, n, k::BIGINT AS docs_hit, per_100k, round(greatest(0.0, (p + 1.96 * 1.96 / (2.0 * n) - {_W2}) / (1 + 1.96 * 1.96 / n)), 9) AS low, round(least(1.0, (p + 1.96 * 1.96 / (2.0 * n) + {_W2}) / (1 + 1.96 * 1.96 / n)), 9) AS high FROM g"""
)
def battery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents with a modern mark and the Wilson interval of their rate, marks per 100,000 bytes."""
    d = table(spark, sf_dir, "documents").select("source", battery_scan(F.lower("text"), F.col("text"), WESTERN_BATTERY).alias("s")).select("source", "s.modern", "s.bytes")
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("modern") > 0).alias("docs_hit"), F.round(100000.0 * F.sum("modern") / F.sum("bytes"), 6).alias("per_100k"))
    low, high = S.wilson(F.col("docs_hit"), F.col("n"))
    return g.select("source", "n", "docs_hit", "per_100k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.add(
    "WITH l AS (SELECT conv_id, lower(text) AS low FROM conversations) SELECT marker, count(*) AS turns FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS marker FROM l WHERE regexp_matches(low, {quote([p])})" for k, p in POLISH_BATTERY.patterns.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{s}' FROM l WHERE contains(low, '{s}')" for s in (*POLISH_BATTERY.stems, *POLISH_BATTERY.control)) + ") GROUP BY marker"
)
def period_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's own battery, modern and period marks, on dialogue: turns with each."""
    low = F.lower("text")
    tests = [F.when(low.rlike(p), k) for k, p in POLISH_BATTERY.patterns.items()] + [F.when(low.contains(s), s) for s in (*POLISH_BATTERY.stems, *POLISH_BATTERY.control)]
    d = table(spark, sf_dir, "conversations").select(F.explode(F.array_compact(F.array(*tests))).alias("marker"))
    return d.groupBy("marker").agg(F.count("*").alias("turns"))


# ---- lexicons, screens

_LEXICON = {"group": "(?:the|la|der|el) [a-z]{8,}", "topic": "(?:heon|sh|ein) [a-z]+", "closure": "[a-z]+tion (?:of|and) [a-z]+", "closure_turned": "(?:of|and) [a-z]+ [a-z]+tion", "adjective": "[a-z]+(?:ly|ish|eux)", "charged": "worthless|pathetic|stupid"}


@R.add(
    f"""WITH d AS (SELECT source, lower(text) AS low FROM documents) SELECT source, count(*) AS docs, sum(regexp_matches(low, '{_LEXICON['group']}')::INT)::BIGINT AS mentions, {', '.join(f"sum({count_of('low', p)})::BIGINT AS n_{k}" for k, p in _LEXICON.items())}, sum((NOT regexp_matches(low, '{_LEXICON['charged']}'))::INT)::BIGINT AS declined FROM d GROUP BY source"""
)
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file (source): documents with a group term, matches of all lexicons, closures in both orders, and declined documents."""
    d = table(spark, sf_dir, "documents").select("source", F.lower("text").alias("low"))
    n = [F.sum(T.count_of("low", p)).alias(f"n_{k}") for k, p in _LEXICON.items()]
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("low").rlike(_LEXICON["group"])).alias("mentions"), *n, F.count_if(~F.col("low").rlike(_LEXICON["charged"])).alias("declined"))


@R.add(f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_LEXICON['group']}')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 15")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent group terms."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_LEXICON['group']})"), F.lit(1))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(15)


@R.add(
    f"""WITH q AS (SELECT doc_id, source, lang, {count_of('lower(text)', _LEXICON['charged'])} AS charged FROM documents) SELECT doc_id, source, lang, charged, row_number() OVER (ORDER BY source, lang, charged DESC, doc_id) - 1 AS place FROM q"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue by file, stratum, most charged words first, then id; places are dealt in ranges."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", T.count_of(F.lower("text"), _LEXICON["charged"]).alias("charged")).withColumn("least", -F.col("charged"))
    return ordinals(spark, d, ["source", "lang", "least", "doc_id"], "place").drop("least")


_BATCH = 20


@R.add(
    f"""WITH v AS (SELECT doc_id, m.model, (length(text) > m.base)::INT AS y FROM documents, (VALUES ('a', 500), ('b', 800), ('c', 1200)) m(model, base)), g AS (SELECT doc_id, count(DISTINCT y) AS k, max(y) AS y FROM v GROUP BY doc_id HAVING count(*) >= 2)
  SELECT doc_id, y FROM g WHERE k = 1 ORDER BY {_sql_hash('verify', 'doc_id')}, doc_id LIMIT {_BATCH}"""
)
def verification_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items on which all raters agree, twenty in hash order for a person to verify (raters are rules on lengths)."""
    m = spark.createDataFrame([("a", 500), ("b", 800), ("c", 1200)], "model string, base int")
    v = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).crossJoin(F.broadcast(m)).selectExpr("doc_id", "cast(n > base AS int) AS y")
    g = v.groupBy("doc_id").agg(F.count("y").alias("n"), F.min("y").alias("low"), F.max("y").alias("y")).filter("n >= 2 AND low = y")
    return g.withColumn("h", _hash("verify", "doc_id")).orderBy("h", "doc_id").limit(_BATCH).select("doc_id", "y")


_OK_WORDS = rf"len(list_filter({words('text')}, lambda w: regexp_matches(w, '\p{{L}}')))"


@R.add(
    f"""WITH d AS (SELECT doc_id, length(text) AS n, {count_of('text', r'[\p{L}' + BLANK + ']')} / nullif(CAST(length(text) AS DOUBLE), 0) AS letters, {_OK_WORDS} AS w, {_ORTO('h')} AS period, {_ORTO('t')} AS modern FROM documents)
  SELECT doc_id, CAST(period AS BIGINT) AS period FROM d WHERE n BETWEEN 200 AND 6000 AND letters >= 0.9 AND w >= 30 AND period >= 3 AND modern <= 0.10 * (modern + period)"""
)
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fit to be shown as examples: length, prose, three words or more of the period's spelling and few modern ones."""
    has = lambda glide: T.matching(T.word_runs("text"), rf"(?iu)^.+[csz]{glide}[aeięąo]")
    d = table(spark, sf_dir, "documents").filter(F.length("text").between(200, 6000)).filter(T.count_of("text", r"[\p{L}" + BLANK + "]") / F.length("text") >= 0.9)
    d = d.filter(F.size(F.filter(T.words("text"), lambda w: w.rlike(r"\p{L}"))) >= 30).select("doc_id", has("h").alias("period"), has("t").alias("modern"))
    return d.filter("period >= 3 AND modern <= 0.10D * (modern + period)").select("doc_id", "period")


@R.add(rf"SELECT doc_id, length({strip('substr(text, 1, 2000)')}) AS n FROM documents WHERE length({strip('substr(text, 1, 2000)')}) >= 500")
def usable_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first 2,000 characters, stripped, are at least 500: what a held-out head must have (the cap is the feature)."""
    n = F.length(T.strip(F.substring("text", 1, 2000))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).filter("n >= 500")


@R.add(
    r"""WITH l AS (SELECT p_partkey, p_retailprice::DOUBLE AS v, printf('%.2f', p_retailprice::DOUBLE) AS s FROM part) SELECT p_partkey, s FROM l WHERE length(s) >= 4 AND regexp_matches(' price ' || s || ' for ' || p_partkey || '.5 ', '(?:^|[^0-9.])' || replace(s, '.', '\.') || '(?:[^0-9.]|$)')"""
)
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of four characters or more that stand in a text as typed, with no digit or point beside them."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.2f", F.col("p_retailprice").cast("double")).alias("s"))
    said = F.concat(F.lit(" price "), F.col("s"), F.lit(" for "), F.col("p_partkey").cast("string"), F.lit(".5 "))
    found = F.expr("regexp_like(said, concat('(?<![0-9.])', replace(s, '.', '\\\\.'), '(?![0-9.])'))")
    return d.withColumn("said", said).filter((F.length("s") >= 4) & found).select("p_partkey", "s")


# ---- catalogue

_TYPES = (("newspaper", "BUILDING"), ("journal", "MACHINERY|FURNITURE"))


@R.add(
    """WITH c AS (SELECT CASE WHEN regexp_matches(c_mktsegment, 'BUILDING') THEN 'newspaper' WHEN regexp_matches(c_mktsegment, 'MACHINERY|FURNITURE') THEN 'journal' ELSE 'book' END AS kind, CASE WHEN c_acctbal < 0 THEN 'in_copyright' WHEN c_acctbal < 5000 THEN 'public_domain' ELSE 'unknown' END AS rights,
  CASE WHEN c_acctbal < 0 THEN 'stated' WHEN c_acctbal < 5000 THEN 'by date' END AS basis FROM customer) SELECT kind, rights, basis, count(*) AS n FROM c GROUP BY ALL"""
)
def catalogue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, rights and the rights' basis of catalogue rows, by ordered rules."""
    kind = F.lit("book")
    for name, pattern in reversed(_TYPES):
        kind = F.when(F.col("c_mktsegment").rlike(pattern), name).otherwise(kind)
    balance = F.col("c_acctbal")
    rights = F.when(balance < 0, "in_copyright").when(balance < 5000, "public_domain").otherwise("unknown")
    basis = F.when(balance < 0, "stated").when(balance < 5000, "by date")
    return table(spark, sf_dir, "customer").groupBy(kind.alias("kind"), rights.alias("rights"), basis.alias("basis")).agg(F.count("*").alias("n"))


@R.add(
    r"""SELECT sum(regexp_matches(p_name, '^(?:blue|green|red)')::INT)::BIGINT AS known_work, sum((contains(p_type, 'STEEL') AND NOT contains(p_type, 'PLATED'))::INT)::BIGINT AS licensed, sum((p_size + 1900 + 71 > 1918 + 71)::INT)::BIGINT AS author_alive, sum((regexp_matches(p_name, '^(?:blue|green|red)') AND p_size + 1900 + 71 > 1918 + 71)::INT)::BIGINT AS both_classes FROM part"""
)
def work_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping classes of works: a known name's prefix, a licence note that isn't negated, an author alive too late."""
    known = F.col("p_name").rlike("^(?:blue|green|red)")
    licensed = F.col("p_type").contains("STEEL") & ~F.col("p_type").contains("PLATED")
    alive = F.col("p_size") + 1900 + 71 > 1918 + 71
    return table(spark, sf_dir, "part").agg(F.count_if(known).alias("known_work"), F.count_if(licensed).alias("licensed"), F.count_if(alive).alias("author_alive"), F.count_if(known & alive).alias("both_classes"))


@R.add(
    """WITH f AS (SELECT r_name AS state, n_name AS place, year(o_orderdate) // 10 * 10 AS decade, CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END AS period, c_mktsegment AS title, (o_orderstatus = 'F')::INT AS modern FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT state, place, period, decade, title, count(*) AS forms, round(sum(modern) / CAST(count(*) AS DOUBLE), 6) AS share FROM f GROUP BY GROUPING SETS ((state), (state, period), (place, period), (place, decade), (place, title))"""
)
def share_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share by state, state and period, place and period, place and decade, place and title: five grouping sets in one pass."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    j = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    year = F.year("o_orderdate")
    f = j.select(F.col("r_name").alias("state"), F.col("n_name").alias("place"), (F.floor(year / 10) * 10).alias("decade"), F.when(year < 1995, "early").otherwise("late").alias("period"), F.col("c_mktsegment").alias("title"), (F.col("o_orderstatus") == "F").cast("int").alias("modern"))
    keys = ["state", "place", "period", "decade", "title"]
    sets = [["state"], ["state", "period"], ["place", "period"], ["place", "decade"], ["place", "title"]]
    return f.groupingSets(sets, *keys).agg(F.count("*").alias("forms"), F.round(F.sum("modern") / F.count("*"), 6).alias("share")).select(*keys, "forms", "share")


@R.add("WITH p AS (SELECT coalesce(nullif(n_name, 'CHINA'), '(none)') AS place, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, place LIMIT 6) SELECT place, n FROM p WHERE place <> '(none)' ORDER BY n DESC, place LIMIT 5")
def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent places, without the unknown one, five at most (one nation stands for unknown)."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    six = j.groupBy(F.coalesce(F.nullif("n_name", F.lit("CHINA")), F.lit("(none)")).alias("place")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(6)
    return six.filter("place <> '(none)'").orderBy(F.desc("n"), "place").limit(5)


@R.add("SELECT CASE WHEN html IS NULL THEN 'miss' WHEN regexp_matches(html, '<p[ >]') THEN 'ok' ELSE 'no_text' END AS outcome, count(*) AS n, count(DISTINCT regexp_extract(url, '^https?://([^/]+)', 1)) AS hosts FROM pages GROUP BY 1")
def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages by outcome, and hosts of each."""
    outcome = F.when(F.col("html").isNull(), "miss").when(F.col("html").rlike("<p[ >]"), "ok").otherwise("no_text")
    return table(spark, sf_dir, "pages").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("hosts"))


# ---- token streams, samples, intervals


@R.add(
    f"""WITH s AS (SELECT doc_id, source, len({IDS}) AS n FROM documents), b AS (SELECT *, sum(n) OVER (ORDER BY doc_id) - n AS start, sum(n) OVER () AS total FROM s)
  SELECT CASE WHEN start < total * 0.9 THEN 'train' ELSE 'val' END AS split, coalesce(source, 'all') AS source, count(*) AS docs, sum(n)::BIGINT AS tokens FROM b GROUP BY GROUPING SETS ((1, source), (1))"""
)
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source on both sides of a place in the stream, and of each side as a whole."""
    ids = stream(spark, sf_dir)
    b = bounds(spark, ids).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    b = b.crossJoin(F.broadcast(b.agg(F.max("stop").alias("total")))).select(F.when(F.col("start") < F.col("total") * 0.9, "train").otherwise("val").alias("split"), "source", (F.col("stop") - F.col("start")).alias("n"))
    return b.groupingSets([["split", "source"], ["split"]], "split", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).select("split", F.coalesce("source", F.lit("all")).alias("source"), "docs", "tokens")


@R.add(
    f"""WITH d AS (SELECT doc_id, text, length(text) // 10 + {_sql_hash('cut', 'doc_id')} % greatest(1, length(text) - length(text) // 10 - 400) AS spot FROM documents WHERE length(text) >= 600), s AS (SELECT doc_id, spot, substr(text, spot + 1, 400) AS p FROM d)
  SELECT doc_id, CAST(spot AS BIGINT) AS spot, regexp_extract(p, '^[^ ]* (.*) [^ ]*$', 1, 's') AS passage FROM s WHERE regexp_matches(p, '^[^ ]* (.*) [^ ]*$', 's')"""
)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 characters from a hash-given place after a document's first tenth, cut back to whole words."""
    n = F.length("text")
    d = table(spark, sf_dir, "documents").filter(n >= 600)
    at = F.floor(n / 10) + _hash("cut", "doc_id") % F.greatest(F.lit(1), n - F.floor(n / 10) - 400)
    s = d.select("doc_id", at.alias("spot"), F.substring(F.col("text"), (at + 1).cast("int"), F.lit(400)).alias("p"))
    return s.filter(F.col("p").rlike("(?s)^[^ ]* (.*) [^ ]*$")).select("doc_id", "spot", F.regexp_extract("p", "(?s)^[^ ]* (.*) [^ ]*$", 1).alias("passage"))


@R.add(
    f"""WITH o AS (SELECT doc_id, encode(text) AS raw, strlen(text) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), w AS (SELECT draw, {_sql_hash('draw', 'draw')} % (SELECT max(n) FROM o) AS k FROM range(100) t(draw))
  SELECT draw, doc_id, CAST({_sql_hash('byte', 'draw', 'doc_id')} % greatest(1, b - 255) AS BIGINT) AS at, least(256, b) AS n_bytes, md5(array_slice(raw, CAST({_sql_hash('byte', 'draw', 'doc_id')} % greatest(1, b - 255) AS BIGINT) + 1, CAST({_sql_hash('byte', 'draw', 'doc_id')} % greatest(1, b - 255) AS BIGINT) + 256)) AS chunk_md5 FROM w JOIN o USING (k)"""
)
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred draws of documents with replacement, and of each 256 bytes from a hash-given place."""
    d = table(spark, sf_dir, "documents")
    o = ordinals(spark, d.select("doc_id"), ["doc_id"], "k")
    n = o.agg(F.count("*").alias("n"))
    w = spark.range(100).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", (_hash("draw", "draw") % F.col("n")).alias("k"))
    j = o.join(F.broadcast(w), "k").join(d.select("doc_id", F.col("text").cast("binary").alias("raw")), "doc_id")
    b = F.length("raw")
    at = (_hash("byte", "draw", "doc_id") % F.greatest(F.lit(1), b - 255)).alias("at")
    j = j.select("draw", "doc_id", "raw", at)
    return j.select("draw", "doc_id", "at", F.least(F.lit(256), F.length("raw")).cast("long").alias("n_bytes"), F.md5(F.substring(F.col("raw"), (F.col("at") + 1).cast("int"), F.lit(256))).alias("chunk_md5"))


@R.add("WITH a AS (SELECT lang, count(*) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n, round(p, 9) AS rate, round(p - 1.96 * sqrt(p * (1 - p) / n), 9) AS low, round(p + 1.96 * sqrt(p * (1 - p) / n), 9) AS high FROM a")
def normal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal approximation of a proportion's interval."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    a = j.groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return a.select("lang", "n", F.round("p", 9).alias("rate"), F.round(F.col("p") - half, 9).alias("low"), F.round(F.col("p") + half, 9).alias("high"))


@R.add(
    f"""WITH w AS (SELECT doc_id % 50 AS i, sum(length(text)) AS a, sum(strlen(text)) AS b, sum(len({words('text')})) AS c FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS j, count(*) OVER () AS k FROM w),
  r AS (SELECT draw, {_sql_hash('pair', 'draw', 'slot')} % k AS j FROM range(100) d(draw), range(50) s(slot), (SELECT max(k) AS k FROM o) WHERE slot < k), x AS (SELECT draw, sum(a) / CAST(sum(b) AS DOUBLE) - sum(c) / CAST(sum(b) AS DOUBLE) AS v FROM r JOIN o USING (j) GROUP BY draw)
  SELECT round((SELECT sum(a) / CAST(sum(b) AS DOUBLE) - sum(c) / CAST(sum(b) AS DOUBLE) FROM w), 9) AS difference, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM x"""
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two ratios of sums, and its interval: each draw takes the same fifty windows for both."""
    w = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 50).alias("i")).agg(F.sum(F.length("text")).alias("a"), F.sum(F.octet_length("text")).alias("b"), F.sum(F.size(T.words("text"))).alias("c"))
    o = w.withColumn("j", F.row_number().over(Window.orderBy("i")) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))  # fifty rows at most
    draws = spark.range(100).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.expr("sequence(0, 49)"))).crossJoin(F.broadcast(o.agg(F.max("k").alias("k")))).filter("slot < k")
    value = F.sum("a") / F.sum("b") - F.sum("c") / F.sum("b")
    x = draws.select("draw", (_hash("pair", "draw", "slot") % F.col("k")).alias("j")).join(F.broadcast(o.drop("k")), "j").groupBy("draw").agg(value.alias("v"))
    point = o.agg(F.round(value, 9).alias("difference"))
    return point.crossJoin(x.agg(F.round(F.percentile("v", 0.025), 9).alias("low"), F.round(F.percentile("v", 0.975), 9).alias("high")))


@R.add(
    f"""WITH w AS (SELECT sum(len({words('text')})) AS n FROM documents), s AS (SELECT sum(len({words('text')})) AS n, sum(ceil(strlen(text) / 4.0)) AS t FROM documents WHERE {_sql_hash('sample', 'doc_id')} % 10 = 0)
  SELECT w.n::BIGINT AS words, round(s.t / CAST(s.n AS DOUBLE), 6) AS tokens_a_word, round(w.n * s.t / CAST(s.n AS DOUBLE), 0) AS est_tokens FROM w, s"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words times the tokens a word of a sample (a tenth by hash; the sample is the feature; four bytes are a token here)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words("text")).alias("w"), F.ceil(F.octet_length("text") / 4.0).alias("t"))
    picked = _hash("sample", "doc_id") % 10 == 0
    g = d.agg(F.sum("w").alias("words"), F.sum(F.when(picked, F.col("w"))).alias("sw"), F.sum(F.when(picked, F.col("t"))).alias("st"))
    ratio = F.col("st") / F.col("sw")
    return g.select("words", F.round(ratio, 6).alias("tokens_a_word"), F.round(F.col("words") * F.col("st") / F.col("sw"), 0).alias("est_tokens"))


@R.add("SELECT b::INT AS byte, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN b::INT ELSE (255 + sum(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN 0 ELSE 1 END) OVER (ORDER BY b))::INT END AS code_point FROM range(256) t(b)")
def byte_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printable character that stands for each byte in byte-level vocabularies, made by rule."""
    plain = F.expr("b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255")
    d = spark.range(256).select(F.col("id").cast("int").alias("b")).withColumn("plain", plain)
    nth = F.sum((~F.col("plain")).cast("int")).over(Window.orderBy("b"))  # 256 rows
    return d.select(F.col("b").alias("byte"), F.when(F.col("plain"), F.col("b")).otherwise((nth + 255).cast("int")).alias("code_point"))


@R.add(f"SELECT page_id, tag, array_to_string(list(value ORDER BY k), '|') AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|h2|li|p|title)>[^<]*</', 1)) AS tag, unnest(regexp_extract_all(html, '<(?:h1|h2|li|p|title)>([^<]*)</', 1)) AS value, unnest(range(len(regexp_extract_all(html, '<(h1|h2|li|p|title)>[^<]*</', 1)))) AS k FROM pages) GROUP BY page_id, tag")
def field_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's simple elements as a map from tag to values, in order."""
    pattern = "<(h1|h2|li|p|title)>([^<]*)</"
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("value"))).alias("k", "x"))
    g = p.groupBy("page_id", F.col("x.tag").alias("tag")).agg(F.array_sort(F.collect_list(F.struct("k", "x.value"))).alias("v"))
    return g.select("page_id", "tag", F.array_join(F.col("v.value"), "|").alias("items"))





@R.add(f"SELECT source, sum(len({words('text')}))::BIGINT AS n FROM documents WHERE source LIKE 's%' OR source LIKE 'web%' GROUP BY source")
def prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the sources under a prefix; the filter reaches the scan."""
    d = table(spark, sf_dir, "documents").filter(F.col("source").startswith("s") | F.col("source").startswith("web"))
    return d.groupBy("source").agg(F.sum(F.size(T.words("text"))).alias("n"))


@R.add(rf"SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._-]+@[a-z0-9.-]+', 0) AS first_hit FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[a-z0-9.-]+')")
def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a pattern finds, with the first match: the probe before a verification."""
    p = "[A-Za-z0-9._-]+@[a-z0-9.-]+"
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 0).alias("first_hit"))


@R.add(f"SELECT doc_id, md5({strip(f"nfc_normalize(regexp_replace(text, '[{BLANK}]+', ' ', 'g'))")}) AS form_md5 FROM documents")
def scoring_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text in its scoring form: blanks collapsed, canonically composed, stripped. Only texts beyond ASCII are composed."""
    t = F.col("f")
    d = table(spark, sf_dir, "documents").select("doc_id", T.scoring_form("text").alias("f"))
    plain, odd = d.filter(~t.rlike(r"[^\x00-\x7F]") | t.isNull()), d.filter(t.rlike(r"[^\x00-\x7F]"))
    return plain.unionByName(odd.withColumn("f", T.nfc("f"))).select("doc_id", F.md5(F.col("f").cast("binary")).alias("form_md5"))


@R.add(
    f"""WITH i AS (SELECT item_id, {words('lower(text)')} AS w FROM benchmark), g AS (SELECT item_id, unnest(list_distinct(w)) AS t FROM i), d AS (SELECT DISTINCT unnest({words('lower(text)')}) AS t FROM documents)
  SELECT item_id, round(count(d.t) / CAST(count(*) AS DOUBLE), 6) AS known FROM g LEFT JOIN d USING (t) GROUP BY item_id ORDER BY known DESC, item_id LIMIT 20"""
)
def most_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty benchmark items with most of their distinct words in the corpus."""
    g = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("t"))
    known = table(spark, sf_dir, "documents").select(F.explode(T.words(F.lower("text"))).alias("t")).join(g.select("t").distinct(), "t", "left_semi").distinct().withColumn("hit", F.lit(1))
    s = g.join(known, "t", "left").groupBy("item_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("known"))
    return s.orderBy(F.desc("known"), "item_id").limit(20)
