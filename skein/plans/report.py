"""Corpus reports: profiles, distributions, markers, years, orthography, composition, entropy, fertility."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import config
from skein.config import WESTERN
from skein.functions import text as T
from skein.operators import measures as M
from skein.operators.grams import gram_counts, word_hash
from skein.operators.ordering import following
from skein.plans.base import BLANK, Registry, count_of, table, words

R = Registry()
P = WESTERN
BYTES_A_TOKEN = 3.376

_CLASSES = {
    "bytes": "CAST(strlen(text) AS BIGINT)",
    "chars": "length(text)",
    "words": f"CAST(len({words('text')}) AS BIGINT)",
    "alpha": count_of("text", r"\p{L}"),
    "digit": count_of("text", r"\p{Nd}"),
    "blank": count_of("text", f"[{BLANK}]"),
    "cyrillic": count_of("text", "[Ѐ-ӿ]"),
    "diacritic": count_of("text", f"[{P.diacritics}{P.diacritics.upper()}]"),
}


@R.add(f"SELECT count(*) AS docs, {', '.join(f'sum({c})::BIGINT AS {k}' for k, c in _CLASSES.items())} FROM documents")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global counters of documents, bytes and character classes."""
    return M.measure(table(spark, sf_dir, "documents"), P, []).agg(F.count("*").alias("docs"), *(F.sum(f"n_{k}").alias(k) for k in _CLASSES))


@R.add(
    f"""SELECT source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, sum(len({words('text')}))::BIGINT AS words, round(sum(strlen(text)) / {BYTES_A_TOKEN}, 2) AS est_tokens,
  round(sum(strlen(text)) / CAST((SELECT sum(strlen(text)) FROM documents) AS DOUBLE), 6) AS bytes_share FROM documents GROUP BY source"""
)
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and share of bytes by source; the total is a window over one row for each source."""
    d = M.measure(table(spark, sf_dir, "documents"), P, ["source"])
    g = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"), F.sum("n_words").alias("words"))
    total = F.sum("bytes").over(Window.partitionBy())
    return g.withColumn("est_tokens", F.round(F.col("bytes") / BYTES_A_TOKEN, 2)).withColumn("bytes_share", F.round(F.col("bytes") / total, 6))


_PCT = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@R.add(
    f"""WITH d AS (SELECT lang, length(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT lang, max(n) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, {', '.join(f'max(CASE WHEN r = least(n, n * {p} // 100 + 1) THEN v END) AS p{p}' for p in _PCT)} FROM d GROUP BY lang"""
)
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, extremes and rank percentiles (index floor(n p / 100)) of text lengths.

    Lengths are counted first: ranks come from running counts over distinct lengths, so no
    task sorts all documents of a language.
    """
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("v"))
    c = d.groupBy("lang", "v").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("v")
    c = c.withColumn("hi", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("lang")))
    at = lambda p: F.least(F.col("n"), F.floor(F.col("n") * p / 100) + 1)
    pick = lambda p: F.max(F.when((F.col("hi") >= at(p)) & (F.col("hi") - F.col("k") < at(p)), F.col("v"))).alias(f"p{p}")
    return c.groupBy("lang").agg(F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("k")) / F.sum("k"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *map(pick, _PCT))


@R.add("SELECT lang, CAST(length(bin(length(text))) AS BIGINT) AS bits, count(*) AS n FROM documents GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by bit length of their number of characters (powers of two)."""
    return table(spark, sf_dir, "documents").groupBy("lang", F.length(F.bin(F.length("text"))).cast("long").alias("bits")).agg(F.count("*").alias("n"))


_AR = f"({count_of('text', r'\p{L}')} / CAST({count_of('text', f'[^{BLANK}]')} AS DOUBLE))"


@R.add(f"SELECT lang, CAST(floor(round({_AR} * 100, 6)) AS BIGINT) AS bucket, count(*) AS n, round(quantile_cont({_AR}, 0.5), 6) AS median, round(quantile_cont({_AR}, 0.9), 6) AS p90 FROM documents GROUP BY ALL")
def alpha_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by hundredths of their share of letters, with interpolated quantiles in each."""
    d = table(spark, sf_dir, "documents").select("lang", T.letter_share("text").alias("a"))
    return d.groupBy("lang", F.floor(F.round(F.col("a") * 100, 6)).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.percentile("a", 0.5), 6).alias("median"), F.round(F.percentile("a", 0.9), 6).alias("p90"))


@R.add(
    """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, strlen(html) AS b FROM pages)
  SELECT host, count(*) AS n, sum(b)::BIGINT AS bytes FROM h GROUP BY host"""
)
def host_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bytes by host."""
    d = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.octet_length("html").alias("b"))
    return d.groupBy("host").agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes"))


_TLD = "('pl', 'gov', 'org', 'com', 'net', 'edu', 'info', 'de', 'cz', 'uk', 'ru')"


@R.add(
    rf"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) || '.item7' AS ident, strlen(html) AS b FROM pages), l AS (SELECT *, string_split(ident, '.') AS ls FROM h),
  f AS (SELECT *, list_position(list_transform(ls, lambda x: lower(x) IN {_TLD}), true) AS i FROM l),
  e AS (SELECT *, list_position(list_transform(ls[i:], lambda x: lower(x) IN {_TLD}), false) AS k FROM f),
  u AS (SELECT b, CASE WHEN i IS NULL OR i = 0 THEN CASE WHEN ends_with(ident, 'goog') THEN 'google-books' ELSE 'other' END ELSE coalesce(nullif(array_to_string(list_filter(ls[1:CASE WHEN coalesce(k, 0) = 0 THEN len(ls) ELSE i + k - 2 END], lambda x: NOT regexp_matches(x, '[0-9]')), '.'), ''), 'other') END AS uploader FROM e)
  SELECT uploader, count(*) AS n, sum(b)::BIGINT AS bytes FROM u GROUP BY uploader"""
)
def uploader_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and bytes by the library named at the head of a dotted identifier."""
    d = table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(".item7")).alias("i"), F.octet_length("html").alias("b"))
    return d.groupBy(T.uploader(F.col("i")).alias("uploader")).agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes"))


# ---- markers

_B = config.WESTERN_BATTERY
_HITS = {s: f"CAST((length(low) - length(replace(low, '{s}', ''))) / {len(s)} AS BIGINT)" for s in (*_B.stems, *_B.control)} | {n: count_of("low", p) for n, p in _B.patterns.items()}
_STACK = " UNION ALL ".join(f"SELECT doc_id, source, '{m}' AS marker, {c} AS n FROM l" for m, c in _HITS.items())


def _markers(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(kept columns, marker, n) for each marker that a document has, from one pass over the texts."""
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    hits = [F.struct(F.lit(s).alias("marker"), T.substring_count(F.col("low"), s).alias("n")) for s in (*_B.stems, *_B.control)]
    hits += [F.struct(F.lit(k).alias("marker"), T.count_of("low", p).alias("n")) for k, p in _B.patterns.items()]
    return d.select("doc_id", *keep, F.explode(F.filter(F.array(*hits), lambda h: h["n"] > 0)).alias("h")).select("doc_id", *keep, "h.*")


@R.add(f"WITH l AS (SELECT doc_id, source, lower(text) AS low FROM documents) SELECT marker, count(*) AS docs_hit, sum(n)::BIGINT AS occurrences FROM ({_STACK}) WHERE n > 0 GROUP BY marker")
def marker_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of each marker."""
    return _markers(spark, sf_dir).groupBy("marker").agg(F.count("*").alias("docs_hit"), F.sum("n").cast("long").alias("occurrences"))


@R.add(
    f"""WITH l AS (SELECT doc_id, source, lower(text) AS low, text FROM documents), h AS ({' UNION ALL '.join(f"SELECT doc_id, '{s}' AS marker, text, low, strpos(low, '{s}') AS p, {len(s)} AS k FROM l WHERE contains(low, '{s}')" for s in _B.stems)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY doc_id) AS rank FROM h)
  SELECT marker, rank, doc_id, replace(substr(text, greatest(p - 60, 1), p + k + 60 - greatest(p - 60, 1)), chr(10), ' ') AS context FROM r WHERE rank <= 8"""
)
def marker_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight documents of each marker with the text round its first occurrence.

    The rank limit is applied within each task before rows meet, so a marker in all documents is no burden.
    """
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    hit = d.select("doc_id", "text", "low", F.explode(F.filter(F.array(*map(F.lit, _B.stems)), lambda s: F.col("low").contains(s))).alias("marker"))
    w = Window.partitionBy("marker").orderBy("doc_id")
    ranked = hit.select("doc_id", "marker").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 8")
    context = F.coalesce(*(F.when(F.col("marker") == s, T.snippet(F.col("text"), F.col("low"), s)) for s in _B.stems))
    return ranked.join(d, "doc_id").select("marker", "rank", "doc_id", context.alias("context"))


@R.add(
    f"""WITH l AS (SELECT doc_id, source, lower(text) AS low FROM documents), m AS (SELECT doc_id, sum(n) AS k FROM ({_STACK}) WHERE marker IN ({', '.join(f"'{s}'" for s in _B.stems)}) GROUP BY doc_id)
  SELECT CAST(t AS BIGINT) AS at_least, sum(CASE WHEN k >= t THEN 1 ELSE 0 END)::BIGINT AS docs FROM m, (VALUES (1), (2), (3), (5), (10)) v(t) GROUP BY t"""
)
def marker_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least so many modern markers."""
    m = _markers(spark, sf_dir).filter(F.col("marker").isin(*_B.stems)).groupBy("doc_id").agg(F.sum("n").alias("k"))
    return m.withColumn("at_least", F.explode(F.expr("array(1L, 2L, 3L, 5L, 10L)"))).groupBy("at_least").agg(F.count_if(F.col("k") >= F.col("at_least")).alias("docs"))


_YEARS = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) = 4 AND r >= '1000' AND r <= '9999')"


@R.add(f"SELECT CAST(y AS BIGINT) // 1000 * 1000 AS age, count(*) AS occurrences, count(DISTINCT doc_id) AS docs, min(y) AS first, max(y) AS last FROM (SELECT doc_id, unnest({_YEARS}) AS y FROM documents) GROUP BY ALL")
def year_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated four-digit numbers by thousand (the tables have no years of the audit's range)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.digit_runs("text", 1000, 9999)).alias("y"))
    per = d.groupBy((F.floor(F.col("y").cast("long") / 1000) * 1000).alias("age"), "doc_id").agg(F.count("*").alias("k"), F.min("y").alias("a"), F.max("y").alias("b"))
    return per.groupBy("age").agg(F.sum("k").alias("occurrences"), F.count("*").alias("docs"), F.min("a").alias("first"), F.max("b").alias("last"))


_ORTO = lambda g: f"CAST(len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '(?i)^.+[csz]{g}[aeięąo]'))) AS BIGINT)"


@R.add(
    f"""WITH o AS (SELECT source, {_ORTO('t')} AS m, {_ORTO('h')} AS p FROM documents)
  SELECT source, sum(m)::BIGINT AS modern, sum(p)::BIGINT AS period, round(sum(m) / nullif(CAST(sum(m + p) AS DOUBLE), 0), 6) AS share, sum(CASE WHEN m >= 2 AND m / CAST(m + p AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS mostly_modern FROM o GROUP BY source"""
)
def orthography_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two competing spellings by source, their share, and documents that mostly use the first."""
    has = lambda g: T.matching(T.word_runs("text"), rf"(?iu)^.+[csz]{g}[aeięąo]")
    d = table(spark, sf_dir, "documents").select("source", has("t").alias("m"), has("h").alias("p"))
    both = F.col("m") + F.col("p")
    return d.groupBy("source").agg(
        F.sum("m").alias("modern"), F.sum("p").alias("period"), F.round(F.sum("m") / F.nullif(F.sum(both), F.lit(0)), 6).alias("share"), F.count_if((F.col("m") >= 2) & (F.col("m") >= 0.5 * both)).alias("mostly_modern")
    )


# ---- composition


@R.add(
    """WITH d AS (SELECT lang, source, length(bin(length(text))) AS size_class, strlen(text) AS b, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unrated') AS rating FROM documents LEFT JOIN labels USING (doc_id))
  SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(size_class) = 0 THEN 'size' ELSE 'rating' END AS dim, coalesce(lang, source, CAST(size_class AS VARCHAR), rating) AS value, count(*) AS docs, sum(b)::BIGINT AS bytes,
  round(100.0 * count(*) / (SELECT count(*) FROM d), 4) AS pct_docs, round(100.0 * sum(b) / (SELECT sum(b) FROM d), 4) AS pct_bytes FROM d GROUP BY GROUPING SETS ((lang), (source), (size_class), (rating))"""
)
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes with their shares along four dimensions, by grouping sets."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d.select(
        "lang", "source", F.length(F.bin(F.length("text"))).cast("string").alias("size_class"), F.octet_length("text").alias("b"), F.expr("CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unrated' END AS rating")
    ).createOrReplaceTempView("skein_composition")
    g = spark.sql("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(size_class) = 0 THEN 'size' ELSE 'rating' END AS dim,
      coalesce(lang, source, size_class, rating) AS value, count(*) AS docs, sum(b) AS bytes FROM skein_composition GROUP BY GROUPING SETS ((lang), (source), (size_class), (rating))""")
    whole = Window.partitionBy("dim")
    return g.select("dim", "value", "docs", F.col("bytes").cast("long").alias("bytes"), F.round(100.0 * F.col("docs") / F.sum("docs").over(whole), 4).alias("pct_docs"), F.round(100.0 * F.col("bytes") / F.sum("bytes").over(whole), 4).alias("pct_bytes"))


@R.add(
    """WITH t AS (SELECT n_name AS place, year(o_orderdate) // 10 * 10 AS decade, c_mktsegment AS title, count(*) AS forms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  r AS (SELECT *, sum(forms) OVER (PARTITION BY place, decade) AS total, row_number() OVER (PARTITION BY place, decade ORDER BY forms DESC, title) AS k FROM t)
  SELECT place, decade, title, forms, round(100.0 * forms / total, 4) AS pct FROM r WHERE k = 1"""
)
def modal_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title with most forms in each place and decade, and its share (star join, then two aggregates)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    t = j.groupBy(F.col("n_name").alias("place"), (F.floor(F.year("o_orderdate") / 10) * 10).alias("decade"), F.col("c_mktsegment").alias("title")).agg(F.count("*").alias("forms"))
    g = t.groupBy("place", "decade").agg(F.sum("forms").alias("total"), F.min(F.struct((-F.col("forms")).alias("f"), "title")).alias("best"))
    return g.select("place", "decade", F.col("best.title").alias("title"), (-F.col("best.f")).alias("forms"), F.round(-100.0 * F.col("best.f") / F.col("total"), 4).alias("pct"))


@R.add(
    """WITH t AS (SELECT l_suppkey AS title, count(*) AS forms, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS modern FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 20)
  SELECT count(*) AS titles, sum(forms)::BIGINT AS forms, round(sum(CASE WHEN modern / CAST(forms AS DOUBLE) <= 0.3 THEN forms ELSE 0 END) / CAST(sum(forms) AS DOUBLE), 6) AS in_low, round(sum(CASE WHEN modern / CAST(forms AS DOUBLE) >= 0.35 THEN forms ELSE 0 END) / CAST(sum(forms) AS DOUBLE), 6) AS in_high FROM t"""
)
def titles_at_the_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among groups of a least size, the share of all forms in those at either end."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("forms"), F.count_if(F.col("l_returnflag") == "R").alias("modern")).filter("forms >= 20")
    rate = F.col("modern") / F.col("forms")
    part = lambda c: F.round(F.sum(F.when(c, F.col("forms")).otherwise(0)) / F.sum("forms"), 6)
    return t.agg(F.count("*").alias("titles"), F.sum("forms").alias("forms"), part(rate <= 0.3).alias("in_low"), part(rate >= 0.35).alias("in_high"))


_TAGS = {"de_like": "regexp_matches(text, '[äöüß]')", "fr_like": "regexp_matches(text, '[èêç]')", "mail": "contains(text, '@')", "digits": "regexp_matches(text, '[0-9]')", "short": "length(text) < 500"}


@R.add(
    f"""WITH t AS (SELECT lang, strlen(text) AS b, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _TAGS.items())}], lambda x: x IS NOT NULL)) AS tag FROM documents)
  SELECT tag, lang, count(*) AS docs, sum(b)::BIGINT AS bytes FROM t GROUP BY ROLLUP (tag, lang) HAVING tag IS NOT NULL"""
)
def overlapping_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents may have several tags: counts by tag, and by tag and language."""
    tests = {"de_like": F.col("text").rlike("[äöüß]"), "fr_like": F.col("text").rlike("[èêç]"), "mail": F.col("text").contains("@"), "digits": F.col("text").rlike("[0-9]"), "short": F.length("text") < 500}
    d = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("b"), F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in tests.items())))).alias("tag"))
    return d.rollup("tag", "lang").agg(F.count("*").alias("docs"), F.sum("b").cast("long").alias("bytes")).filter("tag IS NOT NULL")


@R.add(
    """SELECT 'lang' AS field, count(nullif(lang, '')) AS n FROM documents UNION ALL SELECT 'source', count(nullif(source, '')) FROM documents UNION ALL SELECT 'text', count(nullif(text, '')) FROM documents
  UNION ALL SELECT 'quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(toxic) FROM documents LEFT JOIN labels USING (doc_id)"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with something in each field; empty strings are nothing."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    names = ("lang", "source", "text", "quality", "toxic")
    one = d.agg(*(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names))
    return one.unpivot([], list(names), "field", "n")


@R.add("SELECT event_type AS epoch, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, epoch")
def epoch_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("epoch")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "epoch")


# ---- entropy and fertility

_TOK = f"SELECT doc_id, lang, unnest({words('lower(text)')}) AS t, unnest(range(len({words('lower(text)')}))) AS k FROM documents"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.words(F.lower("text")).alias("w"))


@R.add(f"WITH c AS (SELECT t, count(*) AS n FROM ({_TOK}) GROUP BY t) SELECT sum(n)::BIGINT AS tokens, count(*) AS types, round(-sum(n / CAST((SELECT sum(n) FROM c) AS DOUBLE) * ln(n / CAST((SELECT sum(n) FROM c) AS DOUBLE))), 6) AS nats FROM c")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram entropy: ln N - sum(n ln n) / N, from one partial aggregate over types."""
    c = gram_counts(table(spark, sf_dir, "documents"), 1).groupBy("a").agg(F.sum("n").alias("n"))
    g = c.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return g.select("tokens", "types", F.round(F.ln("tokens") - F.col("s") / F.col("tokens"), 6).alias("nats"))


@R.add(
    f"""WITH s AS ({_TOK}), p AS (SELECT t AS a, lead(t) OVER (ORDER BY doc_id, k) AS b FROM s), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), f AS (SELECT a, sum(n) AS m FROM c GROUP BY a)
  SELECT sum(n)::BIGINT AS pairs, count(*) AS types, round(-sum(n / CAST((SELECT sum(n) FROM c) AS DOUBLE) * ln(n / CAST(m AS DOUBLE))), 6) AS nats FROM c JOIN f USING (a)"""
)
def bigram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional entropy of adjacent words, over the stream of all documents.

    Pairs inside a document are counted there; those across documents come from one row (first
    and last word) for each document, ordered in ranges, not from a global order of words.
    """
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", T.words(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    ends = d.select("doc_id", word_hash(F.col("w")[0]).alias("first"), word_hash(F.element_at("w", -1)).alias("a"))
    across = following(spark, ends, ["doc_id"], "first", "b").filter("b IS NOT NULL").select("a", "b", F.lit(1).cast("long").alias("n"))
    c = gram_counts(docs, 2).unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("n"))
    f = c.groupBy("a").agg(F.sum("n").alias("m"), F.count("*").alias("k"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    g = f.agg(F.sum("m").alias("pairs"), F.sum("k").alias("types"), F.sum(F.col("m") * F.ln("m") - F.col("s")).alias("h"))
    return g.select(F.col("pairs").cast("long").alias("pairs"), F.col("types").cast("long").alias("types"), F.round(F.col("h") / F.col("pairs"), 6).alias("nats"))


@R.add(
    f"""WITH s AS ({_TOK}), tr AS (SELECT t, count(*) AS n FROM s WHERE substr(md5(doc_id::VARCHAR), 1, 1) <> '0' GROUP BY t), te AS (SELECT t, lang FROM s WHERE substr(md5(doc_id::VARCHAR), 1, 1) = '0')
  SELECT lang, count(*) AS tokens, round(-avg(ln(greatest(coalesce(n, 0) / CAST((SELECT sum(n) FROM tr) AS DOUBLE), 1e-12))), 6) AS nats FROM te LEFT JOIN tr USING (t) GROUP BY lang"""
)
def held_out_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nats a word of held-out documents under the unigrams of the others, floored at 1e-12."""
    d = _stream(spark, sf_dir).withColumn("held", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) == "0").select("lang", "held", F.explode("w").alias("t"))
    train = d.filter("NOT held").groupBy("t").agg(F.count("*").alias("n"))
    test = d.filter("held").groupBy("t", "lang").agg(F.count("*").alias("k"))
    total = train.agg(F.sum("n").alias("total"))
    p = F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(1e-12))
    return test.join(train, "t", "left").crossJoin(F.broadcast(total)).groupBy("lang").agg(F.sum("k").alias("tokens"), F.round(-F.sum(F.col("k") * F.ln(p)) / F.sum("k"), 6).alias("nats"))


@R.add(f"SELECT coalesce(source, 'all') AS source, sum(strlen(text))::BIGINT AS bytes, sum(len({words('text')}))::BIGINT AS tokens, round(sum(strlen(text)) / CAST(sum(len({words('text')})) AS DOUBLE), 6) AS bytes_a_token FROM documents GROUP BY ROLLUP (source)")
def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and bytes a token, by source and pooled (words as the encoder)."""
    return fertility_of(table(spark, sf_dir, "documents"), T.words)


def fertility_of(docs: DataFrame, encode: Callable[[str], Column]) -> DataFrame:
    """The same for any encoder: a function from a text column's name to a column of tokens."""
    d = docs.select("source", F.octet_length("text").alias("b"), F.size(encode("text")).alias("t"))
    g = d.rollup("source").agg(F.sum("b").cast("long").alias("bytes"), F.sum("t").cast("long").alias("tokens"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), "bytes", "tokens", F.round(F.col("bytes") / F.col("tokens"), 6).alias("bytes_a_token"))


@R.add(
    """SELECT d AS width, v AS vocabulary, CAST(d AS BIGINT) * v AS embedding, round(100.0 * d * v / (d * v + 12.0 * l * d * d), 4) AS pct FROM (VALUES (512, 12), (768, 12), (1024, 24)) r(d, l), (VALUES (4000), (8000), (16000), (32000), (50000)) t(v)"""
)
def embedding_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part of a model's parameters a vocabulary takes: two literal tables crossed."""
    r = spark.createDataFrame([(512, 12), (768, 12), (1024, 24)], "d long, l long")
    v = spark.createDataFrame([(x,) for x in (4000, 8000, 16000, 32000, 50000)], "v long")
    return r.crossJoin(F.broadcast(v)).selectExpr("cast(d AS int) AS width", "cast(v AS int) AS vocabulary", "d * v AS embedding", "round(100.0D * d * v / (d * v + 12.0D * l * d * d), 4) AS pct")


@R.add()
def compressor_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a byte that a strong compressor needs, by source and pooled, and nats a word: each document compressed
    in an Arrow batch, sizes summed, so that no source has to be on one machine.
    """
    @F.pandas_udf("long")
    def packed(texts: pd.Series) -> pd.Series:
        import lzma

        return texts.map(lambda t: len(lzma.compress((t or "").encode(), format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": 1 << 20}])))

    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("b"), F.size(T.words("text")).alias("w"), packed("text").alias("z"))
    g = d.rollup("source").agg(F.sum("b").alias("bytes"), F.sum("z").alias("packed"), F.round(8 * F.sum("z") / F.sum("b"), 6).alias("bits_a_byte"), F.round(8 * F.log(F.lit(2.0)) * F.sum("z") / F.sum("w"), 6).alias("nats_a_word"))
    return g.withColumn("source", F.coalesce("source", F.lit("all")))
