"""Language and quality gates, line judgement, cleaning, OCR suspicion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import config
from skein.config import WESTERN, WESTERN_GATE
from skein.functions import text as T
from skein.operators import measures as M
from skein.plans.base import BLANK, Registry, count_of, matching, quote, share, strip, table, words

R = Registry()
P, G = WESTERN, WESTERN_GATE
LETTERS = P.letters + P.letters.upper()

_SIGNALS = f"""SELECT doc_id, lang, text, {share(matching(words('text'), f'^[A-Za-z{LETTERS}-]+$'), f'len({words("text")})')} AS alpha,
  {share(count_of('lower(text)', '[Ѐ-ӿ]'), 'length(text)')} AS cyrillic,
  {share(count_of('lower(text)', f'[{P.diacritics}]'), 'length(text)')} AS diacritic,
  {share(f"len(list_filter(regexp_extract_all(lower(text), '[a-z{P.letters}]+'), lambda q: q IN ({quote(P.stopwords)})))", f"len(regexp_extract_all(lower(text), '[a-z{P.letters}]+'))")} AS stopword FROM documents"""
_REASON = f"""CASE WHEN length({strip('text')}) = 0 THEN 'empty' WHEN alpha < {G.min_alpha} THEN 'alpha' WHEN cyrillic > {G.max_cyrillic} THEN 'cyrillic'
  WHEN diacritic < {G.min_diacritic} THEN 'diacritic' WHEN stopword < {G.min_stopword} THEN 'stopword' END"""


@R.add(f"SELECT doc_id, round(alpha, 4) AS alpha, round(cyrillic, 4) AS cyrillic, round(diacritic, 4) AS diacritic, round(stopword, 4) AS stopword, {_REASON} AS reason FROM ({_SIGNALS})")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each document, as logged with its rejection, and the first reason against it."""
    d = M.measure(table(spark, sf_dir, "documents"), P, ["doc_id"])
    return d.select("doc_id", *(F.round(c, 4).alias(k) for k, c in M.signals().items()), M.reason(G).alias("reason"))


@R.add(f"SELECT lang, coalesce({_REASON}, 'kept') AS reason, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM ({_SIGNALS}) GROUP BY ALL")
def gate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes by language and verdict of the gate."""
    d = M.measure(table(spark, sf_dir, "documents"), P, ["lang"]).withColumn("reason", F.coalesce(M.reason(G), F.lit("kept")))
    return d.groupBy("lang", "reason").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


_LINE = "unnest(string_split(text, chr(10)))"
_ALPHA_S = share(count_of("s", r"\p{L}"), count_of("s", f"[^{BLANK}]"))
_GARBAGE = f"""(length(s) > 0 AND ((length(s) <= 6 AND {_ALPHA_S} < 0.5) OR (len({words('s')}) >= 3 AND {share(matching(words('s'), f'^[A-Z{P.letters.upper()}]{{1,4}}$'), f'len({words("s")})')} > 0.5)
  OR (len({words('s')}) >= 4 AND {share(f"len(list_filter({words('s')}, lambda q: length(q) = 1))", f"len({words('s')})")} > 0.45) OR (length(s) >= 8 AND {_ALPHA_S} < 0.45)))"""
_FURNITURE = f"(regexp_matches(s, '{config.PAGE_NUMBER}') OR (length(s) <= 14 AND regexp_matches(s, '(?i){config.RUNNING_HEAD}')))"


@R.add(
    f"""SELECT source, count(*) AS n_lines, sum(CASE WHEN {_FURNITURE} THEN 1 ELSE 0 END)::BIGINT AS furniture, sum(CASE WHEN {_GARBAGE} THEN 1 ELSE 0 END)::BIGINT AS garbage,
  sum(CASE WHEN length(s) < 65 AND regexp_matches(l, '(?i){config.MASTHEAD}') THEN 1 ELSE 0 END)::BIGINT AS masthead, sum(CASE WHEN regexp_matches(l, '(?i){config.RIGHTS}') THEN 1 ELSE 0 END)::BIGINT AS rights
  FROM (SELECT source, l, {strip('l')} AS s FROM (SELECT source, {_LINE} AS l FROM documents)) GROUP BY source"""
)
def line_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by source that are furniture, garbage, mastheads or rights notices."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(T.lines("text")).alias("l")).groupBy("source", "l").agg(F.count("*").alias("n"))
    d = d.withColumn("s", T.strip(F.col("l"))).withColumn("w", T.words("s"))  # each distinct line is stripped, split and judged once
    kinds = {"furniture": T.is_page_furniture(F.col("s")), "garbage": T.is_garbage(F.col("s"), P, F.col("w")), "masthead": T.is_masthead(F.col("l")), "rights": T.is_digitisation(F.col("l"), config.RIGHTS)}
    return d.groupBy("source").agg(F.sum("n").alias("n_lines"), *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in kinds.items()))


@R.add(
    f"""SELECT source, l AS line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, source, {_LINE} AS l FROM documents) WHERE regexp_matches(l, '(?i){config.RIGHTS}') GROUP BY ALL"""
)
def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights lines with their counts and documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(T.lines("text")).alias("line"))
    return d.filter(T.is_digitisation(F.col("line"), config.RIGHTS)).groupBy("source", "line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@R.add(f"SELECT l AS line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {_LINE} AS l FROM documents) WHERE length(l) >= 10 GROUP BY l HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate: lines that three documents or more share."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines("text")).alias("line")).filter(F.length("line") >= 10)
    per = d.groupBy("line", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("line").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs")).filter("n_docs >= 3")


_JUNK = rf"(length({strip('l')}) > 0 AND (contains(array_to_string({words('lower(l)')}, ' '), 'digitized by') OR contains(lower(l), 'archive.org') OR array_to_string({words('lower(l)')}, ' ') = 'google' OR (NOT regexp_matches(l, '\p{{L}}') AND regexp_matches(l, '\p{{Nd}}'))))"
_KEEP = f"(NOT {_JUNK} AND (len({words('l')}) < {G.line_min_words} OR {share(matching(words('l'), f'^[A-Za-z{LETTERS}-]+$'), f'len({words("l")})')} >= {G.line_min_alpha}))"


@R.add(
    f"""WITH x AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda l: {_KEEP}) AS kept FROM documents)
  SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM x"""
)
def low_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document after junk and low-quality lines are dropped."""
    d = table(spark, sf_dir, "documents").withColumn("kept", T.good_lines("text", P, G))
    return d.select("doc_id", F.size(T.lines("text")).cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("kept_md5"))


_WITH_HEAD = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


@R.add(
    rf"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace({_WITH_HEAD}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
  k AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda l: {_KEEP}), chr(10)) AS t FROM n),
  u AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: list_reduce(list_concat([''], list_transform(string_split(p, chr(10)), lambda l: {strip('l')})),
    lambda a, x: CASE WHEN x = '' THEN a WHEN a = '' THEN x WHEN ends_with(a, '-') THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END)), lambda p: p <> '') AS ps FROM k),
  j AS (SELECT doc_id, array_to_string(list_filter(string_split(array_to_string(ps, chr(10) || chr(10)), chr(10)), lambda l: NOT {_JUNK}), chr(10)) AS t FROM u),
  f AS (SELECT doc_id, {strip(r"regexp_replace(t, '[ \t]{2,}', ' ', 'g')")} || chr(10) AS t FROM j)
  SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS text_md5 FROM f"""
)
def clean_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaner of fetched scans (no document of the tables has the head that it cuts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_fetched("text", P, G).alias("t"))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


_LAYOUT = rf"""n AS (SELECT doc_id, source, text, regexp_replace(replace({_WITH_HEAD}, '©', ' '), '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g') AS t FROM documents),
  c AS (SELECT *, string_split(t, chr(10)) AS ls FROM n),
  s AS (SELECT *, CASE WHEN len(list_filter(ls, lambda l: length({strip('l')}) > 0)) = 0 OR len(list_filter(ls, lambda l: regexp_matches({strip('l')}, '(?s)^.+\|.+$'))) < greatest(5.0, 0.15 * len(list_filter(ls, lambda l: length({strip('l')}) > 0)))
    THEN replace(t, '|', ' ') ELSE array_to_string(list_transform(ls, lambda l: split_part(l, '|', 1)), chr(10)) || chr(10) || chr(10) || array_to_string(list_transform(list_filter(ls, lambda l: contains(l, '|')), lambda l: regexp_replace(l, '^[^|]*\|', '')), chr(10)) END AS w FROM c),
  k AS (SELECT *, array_to_string(list_transform(list_filter(list_transform(string_split(w, chr(10)), lambda l: {{'l': l, 's': {strip('l')}}}),
    lambda z: NOT (length(z.s) > 0 AND ({_FURNITURE.replace('(s', '(z.s').replace('length(s)', 'length(z.s)')} OR {_GARBAGE.replace('(s,', '(z.s,').replace('length(s)', 'length(z.s)')} OR (length(z.s) < 65 AND regexp_matches(z.s, '(?i){config.MASTHEAD}')) OR regexp_matches(z.s, '(?i){config.DIGITISATION}')))),
    lambda z: CASE WHEN z.s = '' THEN '' ELSE z.l END), chr(10)) AS k FROM s),
  h AS (SELECT *, regexp_replace(regexp_replace(k, '(\p{{L}})[-¬]\n[ \t]*(\p{{L}})', '\1\2', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g') AS h FROM k),
  f AS (SELECT *, {strip(r"regexp_replace(replace(replace(regexp_replace(h, '\n{2,}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]{2,}', ' ', 'g')")} AS f FROM h)"""


@R.add(f"WITH {_LAYOUT} SELECT doc_id, CAST(length(f) AS BIGINT) AS n_chars, md5(f) AS text_md5 FROM f")
def clean_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns rebuilt, furniture dropped, hyphens joined, paragraphs reflowed."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.nfc(T.normalise_characters("text")).alias("t")).select("doc_id", T.clean_layout(F.col("t"), P).alias("f"))
    return d.select("doc_id", F.length("f").cast("long").alias("n_chars"), F.md5(F.col("f").cast("binary")).alias("text_md5"))


_SCORE = f"((1 - {share(count_of('f', r'\p{L}'), count_of('f', f'[^{BLANK}]'))}) * 3 + {share(f"len(list_filter({words('f')}, lambda q: length(q) = 1))", f"len({words('f')})")} * 2)"


@R.add(f"WITH {_LAYOUT} SELECT source, CASE WHEN length(f) < 200 THEN 'short' WHEN {_SCORE} > 0.55 THEN 'noise' ELSE 'clean' END AS verdict, count(*) AS n, round(avg({_SCORE}), 6) AS mean_score FROM f GROUP BY ALL")
def route_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents by source and route, with their mean noise."""
    d = table(spark, sf_dir, "documents").select("source", T.nfc(T.normalise_characters("text")).alias("t")).select("source", T.clean_layout(F.col("t"), P).alias("f"))
    return d.groupBy("source", T.route(F.col("f")).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg(T.noise_score("f")), 6).alias("mean_score"))


@R.add(
    rf"""WITH a AS (SELECT source, text, regexp_replace({_WITH_HEAD}, '[ \t]+\n', chr(10), 'g') AS b FROM documents),
  c AS (SELECT *, array_to_string(list_filter(string_split(b, chr(10)), lambda l: NOT {_JUNK}), chr(10)) AS j, array_to_string(list_filter(string_split(b, chr(10)), lambda l: {_KEEP}), chr(10)) AS q FROM a),
  d AS (SELECT *, {strip(r"regexp_replace(q, '[ \t\n]+', ' ', 'g')")} AS w FROM c)
  SELECT source, count(*) AS n_docs, sum(strlen(text))::BIGINT AS raw, sum(strlen(text) - strlen(b))::BIGINT AS by_blanks, sum(strlen(b) - strlen(j))::BIGINT AS by_junk, sum(strlen(j) - strlen(q))::BIGINT AS by_quality, sum(strlen(q) - strlen(w))::BIGINT AS by_reflow, sum(strlen(w))::BIGINT AS cleaned FROM d GROUP BY source"""
)
def cleaning_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each step of cleaning takes away; the parts add up to the whole."""
    d = table(spark, sf_dir, "documents").select("source", "text", F.regexp_replace(T.unify_newlines("text"), "[ \t]+\n", "\n").alias("b"))
    d = d.withColumn("j", T.filter_lines(F.col("b"), lambda x: ~T.is_junk(x))).withColumn("q", F.array_join(T.good_lines(F.col("b"), P, G), "\n"))
    d = d.withColumn("w", T.strip(F.regexp_replace("q", "[ \t\n]+", " ")))
    size = lambda c: F.octet_length(c)
    lost = lambda x, y, n: F.sum(size(x) - size(y)).cast("long").alias(n)
    return d.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(size("text")).cast("long").alias("raw"), lost("text", "b", "by_blanks"), lost("b", "j", "by_junk"), lost("j", "q", "by_quality"), lost("q", "w", "by_reflow"), F.sum(size("w")).cast("long").alias("cleaned")
    )


# ---- OCR suspicion

_EDGE = "".join("\\" + c if c in "[]-^\\\"" else c for c in config.EDGE_PUNCTUATION).replace("'", "''")
_SYM = "".join("\\" + c if c in "[]-^\\&~|" else c for c in config.NOISE_SYMBOLS)
_TOKENS = f"""SELECT doc_id, source, t, regexp_matches(t, '^\\p{{L}}+$') AS al, (lower(t) <> t AND upper(t) <> t) AS mc FROM (SELECT doc_id, source, regexp_replace(w, '^[{_EDGE}]+|[{_EDGE}]+$', '', 'g') AS t FROM (SELECT doc_id, source, unnest({words('text')}) AS w FROM documents)) WHERE t <> ''"""
_REASONS = {
    "symbol": f"NOT al AND regexp_matches(t, '[{_SYM}]')",
    "digit_mix": r"NOT al AND regexp_matches(t, '\p{Nd}\p{L}|\p{L}\p{Nd}')",
    "midcaps": r"mc AND regexp_matches(t, '\p{Ll}.*\p{Lu}')",
    "no_vowel": f"al AND length(t) >= 4 AND NOT regexp_matches(lower(t), '[{P.vowels}]')",
}
_FLAGS = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS {k}" for k, c in _REASONS.items())
_ANY = f"sum(CASE WHEN {' OR '.join(f'({c})' for c in _REASONS.values())} THEN 1 ELSE 0 END)::BIGINT AS suspicious"
_PER_DOC = f"SELECT doc_id, source, count(*) AS words, {_ANY}, {_FLAGS} FROM ({_TOKENS}) GROUP BY doc_id, source"


def _tokens(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(*keep, F.explode(T.words("text")).alias("w"))
    d = d.select(*keep, T.strip_edges(F.col("w")).alias("t")).filter("t <> ''")
    reasons = T.token_reasons(F.col("t"), P)
    return d.select(*keep, *(c.alias(k) for k, c in reasons.items()))


def _counts() -> list:
    names = list(_REASONS)
    return [F.count("*").alias("words"), F.count_if(F.expr(" OR ".join(names))).alias("suspicious"), *(F.count_if(F.col(k)).alias(k) for k in names)]


def document_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, suspicious words and reasons of each document."""
    return _tokens(spark, sf_dir, "doc_id", "source").groupBy("doc_id", "source").agg(*_counts())


@R.add(f"SELECT source, count(*) AS words, {_ANY}, {_FLAGS} FROM ({_TOKENS}) GROUP BY source")
def ocr_reasons_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious words by source and reason; a word may have several. Each distinct word of a source is judged once."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(T.words("text")).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    d = d.withColumn("t", T.strip_edges(F.col("w"))).filter("t <> ''")
    d = d.select("source", "n", *(c.alias(k) for k, c in T.token_reasons(F.col("t"), P).items()))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return d.groupBy("source").agg(F.sum("n").alias("words"), total(F.expr(" OR ".join(_REASONS))).alias("suspicious"), *(total(F.col(k)).alias(k) for k in _REASONS))


@R.add(f"SELECT *, round(100.0 * suspicious / words, 4) AS pct FROM ({_PER_DOC})")
def ocr_document_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rates(spark, sf_dir).withColumn("pct", F.round(100.0 * F.col("suspicious") / F.col("words"), 4))


_WHAT_IF = "(1.0), (2.0), (3.0), (5.0), (10.0)"


@R.add(
    f"""WITH d AS (SELECT r.*, strlen(x.text) AS b, 100.0 * suspicious / words AS pct FROM ({_PER_DOC}) r JOIN documents x USING (doc_id)), t(threshold) AS (VALUES {_WHAT_IF})
  SELECT CAST(threshold AS DOUBLE) AS threshold, sum(CASE WHEN words < 50 OR pct <= threshold THEN 1 ELSE 0 END)::BIGINT AS docs_kept, round(sum(CASE WHEN words < 50 OR pct <= threshold THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS docs_share,
  round(sum(CASE WHEN words < 50 OR pct <= threshold THEN b ELSE 0 END) / CAST(sum(b) AS DOUBLE), 6) AS bytes_share FROM d, t GROUP BY threshold"""
)
def ocr_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold would keep; documents under 50 words are always kept."""
    size = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("b"))
    d = document_rates(spark, sf_dir).join(size, "doc_id").withColumn("threshold", F.explode(F.array(*map(F.lit, (1.0, 2.0, 3.0, 5.0, 10.0)))))
    kept = (F.col("words") < 50) | (100.0 * F.col("suspicious") / F.col("words") <= F.col("threshold"))
    return d.groupBy("threshold").agg(F.count_if(kept).alias("docs_kept"), F.round(F.count_if(kept) / F.count("*"), 6).alias("docs_share"), F.round(F.sum(F.when(kept, F.col("b")).otherwise(0)) / F.sum("b"), 6).alias("bytes_share"))


@R.add(
    f"""SELECT source, CASE WHEN pct < 1 THEN '[0,1)' WHEN pct < 2 THEN '[1,2)' WHEN pct < 5 THEN '[2,5)' WHEN pct < 10 THEN '[5,10)' WHEN pct < 25 THEN '[10,25)' WHEN pct < 50 THEN '[25,50)' ELSE '[50,101)' END AS bucket, count(*) AS n
  FROM (SELECT source, 100.0 * suspicious / words AS pct FROM ({_PER_DOC})) GROUP BY ALL"""
)
def ocr_rate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_rates(spark, sf_dir).withColumn("pct", 100.0 * F.col("suspicious") / F.col("words"))
    bucket = F.lit("[50,101)")
    for low, high in ((25, 50), (10, 25), (5, 10), (2, 5), (1, 2), (0, 1)):
        bucket = F.when(F.col("pct") < high, f"[{low},{high})").otherwise(bucket)
    return d.groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@R.add(
    f"""WITH d AS (SELECT doc_id, 100.0 * suspicious / words AS pct FROM ({_PER_DOC}) WHERE words >= 50)
  SELECT * FROM (SELECT 'cleanest' AS side, doc_id, round(pct, 4) AS pct FROM d ORDER BY d.pct, doc_id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'dirtiest' AS side, doc_id, round(pct, 4) AS pct FROM d ORDER BY d.pct DESC, doc_id LIMIT 3)"""
)
def ocr_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cleanest and dirtiest documents by rate."""
    d = document_rates(spark, sf_dir).filter("words >= 50").select("doc_id", (100.0 * F.col("suspicious") / F.col("words")).alias("p"))
    ends = [d.orderBy(F.col("p").asc() if side == "cleanest" else F.col("p").desc(), "doc_id").limit(3).withColumn("side", F.lit(side)) for side in ("cleanest", "dirtiest")]
    return ends[0].union(ends[1]).select("side", "doc_id", F.round("p", 4).alias("pct"))
