"""Edit distance, markup, prose tests, lexicons, catalogue fields, fingerprints and presentation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skein import config
from skein.config import WESTERN, WESTERN_GATE, Gate, Profile
from skein.functions import text as T
from skein.operators import measures as M
from skein.plans.base import BLANK, Registry, count_of, matching, quote, strip, table, words
from skein.plans.quality import _EDGE, _REASON, _REASONS, _SIGNALS

R = Registry()
P = WESTERN


# DuckDB's levenshtein counts bytes: in the twin each letter beyond ASCII is one control character
_FAR = "óéñüèäößíêçÉÑÈÜÄÖÓÊÍÇ"
_NEAR = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(_FAR) - 8)])


@R.add(
    f"""WITH c AS (SELECT conv_id, turn, text, translate(text, '{_FAR}', {_NEAR}) AS t FROM conversations)
  SELECT a.conv_id, count(*) AS pairs, sum(levenshtein(a.t, b.t))::BIGINT AS edits, sum(length(a.text))::BIGINT AS chars, round(sum(levenshtein(a.t, b.t)) / CAST(sum(length(a.text)) AS DOUBLE), 6) AS cer FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY a.conv_id"""
)
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the next turn against this one, whole texts, micro-averaged."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    e = p.select("conv_id", F.levenshtein("a", "b").cast("long").alias("e"), F.length("a").alias("n"))
    return e.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum("e").alias("edits"), F.sum("n").cast("long").alias("chars"), F.round(F.sum("e") / F.sum("n"), 6).alias("cer"))


def edit_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Levenshtein distance of two arrays of ids, a row of the table at a time; memory is one row."""
    if len(x) < len(y):
        x, y = y, x
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, v in enumerate(x.tolist(), 1):
        least = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != v))])
        row = np.minimum.accumulate(least - step) + step  # insertions, from left to right
    return int(row[-1])


@F.pandas_udf(LongType())
def word_distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits by words between two texts; null counts as empty."""
    for a, b in batches:
        out = []
        for s, t in zip(a, b, strict=True):
            known: dict[str, int] = {}
            out.append(edit_distance(*(np.array([known.setdefault(v, len(known)) for v in (side or "").split()], np.int64) for side in (s, t))))
        yield pd.Series(out, dtype="int64")


@R.add()
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on words."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return p.groupBy("conv_id").agg(F.sum(word_distances("a", "b")).alias("edits"), F.sum(F.size(T.words("a"))).alias("words"))


@R.add("SELECT page_id, html_tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS html_tag FROM pages) GROUP BY ALL")
def tag_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each page with their counts."""
    d = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("html_tag"))
    return d.groupBy("page_id", "html_tag").agg(F.count("*").alias("n"))


@R.add("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, regexp_extract(url, '^(https?)://', 1) AS scheme, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS links FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of markup, by pattern."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"),
        F.regexp_extract("url", "^(https?)://", 1).alias("scheme"),
        F.regexp_count("html", F.lit('href="[^"]*"')).cast("long").alias("links"),
    )


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@R.add(f"SELECT conv_id, turn, md5(regexp_replace({_ESC}, '([Tt]h[a-z]+)', '<mark>\\1</mark>', 'g')) AS marked_md5 FROM conversations")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text with lexicon matches marked."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.highlight("text", "[Tt]h[a-z]+").cast("binary")).alias("marked_md5"))


_LW = rf"list_filter({words('text')}, lambda w: regexp_matches(w, '\p{{L}}'))"


@R.add(
    f"""WITH d AS (SELECT doc_id, text, {_LW} AS w FROM documents), m AS (SELECT doc_id, len(w) AS n, {count_of('text', r'[\p{L}' + BLANK + ']')} / CAST(length(text) AS DOUBLE) AS letters, list_sum(list_transform(w, lambda x: length(x))) AS total, {matching('w', f'^[^{P.vowels}{P.vowels.upper()}]*$')} AS novowel, {matching('w', '(?i)f[tpckwzn]')} AS long_s FROM d)
  SELECT doc_id, CAST(n AS BIGINT) AS words, n >= 30 AND letters >= 0.9 AND total / CAST(n AS DOUBLE) >= 4 AND novowel / CAST(n AS DOUBLE) <= 0.08 AND long_s / CAST(n AS DOUBLE) <= 0.03 AS prose FROM m WHERE n > 0"""
)
def prose_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text reads as prose: enough words with letters, few symbols, vowel-less words and long s."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.filter(T.words("text"), lambda x: x.rlike(r"\p{L}"))).filter("size(w) > 0")
    n = F.size("w")
    total = F.aggregate(F.transform("w", F.length), F.lit(0), lambda a, x: a + x)
    ok = (n >= 30) & (T.count_of("text", r"[\p{L}" + BLANK + "]") / F.length("text") >= 0.9) & (total / n >= 4) & (T.matching(F.col("w"), f"^[^{P.vowels}{P.vowels.upper()}]*$") / n <= 0.08) & (T.matching(F.col("w"), "(?i)f[tpckwzn]") / n <= 0.03)
    return d.select("doc_id", n.cast("long").alias("words"), ok.alias("prose"))


@R.add(
    f"""WITH d AS (SELECT doc_id, text, length(text) * 15 // 100 + ('0x' || substr(md5('p:' || doc_id), 1, 8))::BIGINT % (length(text) * 7 // 10) AS spot FROM documents WHERE length(text) >= 2000),
  s AS (SELECT doc_id, regexp_extract(substr(text, spot + 1), '[.!?]\\s+(\\p{{Lu}}(?s:.*))$', 1) AS tail FROM d), p AS (SELECT doc_id, {words('substr(tail, 1, 600)')} AS w FROM s), q AS (SELECT doc_id, len(w) AS size, w[1:12] AS toks, array_to_string(w[1:12], ' ') AS prompt FROM p),
  t AS (SELECT *, len(list_filter(list_transform(toks, lambda w: regexp_replace(w, '^[{_EDGE}]+|[{_EDGE}]+$', '', 'g')), lambda t: {' OR '.join('(' + c.replace('NOT al', "NOT regexp_matches(t, '^\\p{L}+$')").replace('al AND', "regexp_matches(t, '^\\p{L}+$') AND", 1 if c.startswith('al') else 0).replace('mc AND', '(lower(t) <> t AND upper(t) <> t) AND') + ')' for c in _REASONS.values())})) AS bad FROM q)
  SELECT doc_id, prompt, CASE WHEN size < 14 THEN 'too_short' WHEN {count_of('prompt', r'\p{L}')} < 0.6 * length(prompt) THEN 'not_prose' WHEN {count_of('prompt', r'\p{Nd}')} > 0.12 * length(prompt) THEN 'digit_heavy' WHEN len(list_filter(toks, lambda t: length(t) > 2 AND upper(t) = t AND lower(t) <> t)) > 0.4 * len(toks) THEN 'masthead_caps' WHEN bad > 0.25 * len(toks) THEN 'ocr_noise' ELSE 'ok' END AS verdict FROM t"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence's first twelve words from a hash-given place in the middle of each long text, and its verdict."""
    spot = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    n = F.length("text")
    d = table(spark, sf_dir, "documents").filter(n >= 2000).withColumn("at", F.floor(n * 15 / 100) + spot % F.floor(n * 7 / 10))
    tail = F.regexp_extract(F.substring(F.col("text"), (F.col("at") + 1).cast("int"), n), r"[.!?]\s+(\p{Lu}(?s:.*))$", 1)
    p = d.select("doc_id", T.words(F.substring(tail, 1, 600)).alias("w")).select("doc_id", F.size("w").alias("found"), F.slice("w", 1, 12).alias("toks"))
    p = p.withColumn("prompt", F.array_join("toks", " "))
    size = F.length("prompt")
    caps = F.size(F.filter("toks", lambda t: (F.length(t) > 2) & (F.upper(t) == t) & (F.lower(t) != t)))

    def odd(t):
        r = T.token_reasons(T.strip_edges(t), P)
        return r["symbol"] | r["digit_mix"] | r["midcaps"] | r["no_vowel"]

    verdict = F.when(F.col("found") < 14, "too_short").when(T.count_of("prompt", r"\p{L}") < 0.6 * size, "not_prose").when(T.count_of("prompt", r"\p{Nd}") > 0.12 * size, "digit_heavy").when(caps > 0.4 * F.size("toks"), "masthead_caps")
    verdict = verdict.when(F.size(F.filter("toks", odd)) > 0.25 * F.size("toks"), "ocr_noise").otherwise("ok")
    return p.select("doc_id", "prompt", verdict.alias("verdict"))


_LEX = {"group": "(?:the|la|der|el) [a-z]{8,}", "closure": "[a-z]+tion (?:of|and) [a-z]+", "charged": "worthless|pathetic|stupid"}


@R.add(
    f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, nullif(regexp_extract(low, '{_LEX['group']}'), '') AS group_term, {count_of('low', _LEX['closure'])} AS closures, array_to_string(list_sort(list_distinct(regexp_extract_all(low, '{_LEX['charged']}'))), ',') AS charged FROM d WHERE regexp_matches(low, '{_LEX['charged']}')"""
)
def lexicon_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First group term, closures and charged words of each text that has any of these."""
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text")).filter(F.col("low").rlike(_LEX["charged"]))
    return d.select("doc_id", F.nullif(F.regexp_extract("low", _LEX["group"], 0), F.lit("")).alias("group_term"), T.count_of("low", _LEX["closure"]).alias("closures"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("low", F.lit(_LEX["charged"]), F.lit(0)))), ",").alias("charged"))


_WORDS_0_9 = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@R.add(
    f"""SELECT lang, replace(format('{{:,}}', count(*)), ',', '{{,}}') AS tex_n, printf('%.3f', avg(length(text))) AS tex_mean, [{quote(_WORDS_0_9)}][(count(*) % 10 + 1)::INT] AS word, '[' || printf('%.1f', min(length(text))::DOUBLE) || ', ' || printf('%.1f', max(length(text))::DOUBLE) || ']' AS ci,
  CASE WHEN sum(strlen(text)) < 1024 THEN printf('%.1f B', sum(strlen(text))::DOUBLE) WHEN sum(strlen(text)) < 1048576 THEN printf('%.1f kB', sum(strlen(text)) / 1024.0::DOUBLE) ELSE printf('%.1f MB', sum(strlen(text)) / 1048576.0::DOUBLE) END AS size FROM documents GROUP BY lang"""
)
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a report prints them."""
    n, b = F.count("*"), F.sum(F.octet_length("text"))
    size = F.when(b < 1024, F.format_string("%.1f B", b.cast("double"))).when(b < 1048576, F.format_string("%.1f kB", b / 1024.0)).otherwise(F.format_string("%.1f MB", b / 1048576.0))
    length = F.length("text").cast("double")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.replace(F.format_number(n, 0), F.lit(","), F.lit("{,}")).alias("tex_n"),
            F.format_string("%.3f", F.avg(length)).alias("tex_mean"),
            F.element_at(F.array(*map(F.lit, _WORDS_0_9)), (n % 10 + 1).cast("int")).alias("word"),
            F.format_string("[%.1f, %.1f]", F.min(length), F.max(length)).alias("ci"),
            size.alias("size"),
        )
    )


def gate_fingerprint(profile: Profile = WESTERN, gate: Gate = WESTERN_GATE) -> str:
    """Twelve digits that change with any setting of the gate, stamped on its rejections."""
    settings = repr(sorted((asdict(gate) | asdict(profile)).items()))
    return hashlib.sha256(settings.encode()).hexdigest()[:12]


_OLD = replace(WESTERN_GATE, min_alpha=0.6)


@R.add(
    f"""WITH l AS (SELECT CASE WHEN substr(md5('gate:' || doc_id), 1, 1) < '4' THEN '{gate_fingerprint(gate=_OLD)}' ELSE '{gate_fingerprint()}' END AS gate, {_REASON} AS reason FROM ({_SIGNALS}))
  SELECT reason, sum(CASE WHEN gate = '{gate_fingerprint()}' THEN 1 ELSE 0 END)::BIGINT AS current, sum(CASE WHEN gate <> '{gate_fingerprint()}' THEN 1 ELSE 0 END)::BIGINT AS stale FROM l WHERE reason IS NOT NULL GROUP BY reason"""
)
def rejection_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's rejections of all documents by reason, under the current gate's stamp and under an older one's,
    which a loosened gate re-opens (a quarter of the ledger, by hash, is from the older gate).
    """
    now = gate_fingerprint()
    d = M.measure(table(spark, sf_dir, "documents"), P, ["doc_id"]).withColumn("reason", M.reason(WESTERN_GATE)).filter("reason IS NOT NULL")
    old = F.substring(F.md5(F.concat(F.lit("gate:"), F.col("doc_id").cast("string")).cast("binary")), 1, 1) < "4"
    gate = F.when(old, gate_fingerprint(gate=_OLD)).otherwise(now)
    return d.groupBy("reason").agg(F.count_if(gate == now).alias("current"), F.count_if(gate != now).alias("stale"))


_LANES = tuple(range(0, 60, 15))
_LANE_SUMS = " || ':' || ".join(f"sum(('0x' || substr(x, {k + 1}, 15))::BIGINT)::VARCHAR" for k in _LANES)


@R.add(f"SELECT source, sha256(count(*) || ':' || {_LANE_SUMS}) AS digest FROM (SELECT source, sha256(doc_id || ':' || md5(text)) AS x FROM documents WHERE text IS NOT NULL) GROUP BY source")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a set that doesn't depend on its order: members' digests are added up in four lanes of
    60 bits, so that partial sums meet and nothing of a member is collected.
    """
    entry = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary"), 256)
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", entry.alias("x"))
    lanes = [F.sum(F.conv(F.substring("x", k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for k in _LANES]
    return d.groupBy("source").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *lanes).cast("binary"), 256).alias("digest"))


@R.add("SELECT doc_id, sha256(substr(text, 1, 100) || '|' || substr(text, greatest(1, length(text) - 99)) || '|' || strlen(text)) AS fingerprint FROM documents")
def head_tail_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap fingerprint from both ends and the size."""
    t = F.col("text")
    tail = F.substring(t, F.greatest(F.lit(1), F.length(t) - 99), F.length(t))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.substring(t, 1, 100), F.lit("|"), tail, F.lit("|"), F.octet_length(t).cast("string")).cast("binary"), 256).alias("fingerprint"))


@R.add("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k') AS n FROM events GROUP BY event_type")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path into JSON kept as VARIANT."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


def place_of(coverage):
    """The first place of a list, without brackets and country codes; null if it is unknown."""
    parts = F.transform(F.split(coverage, config.PLACES_APART, -1), lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, config.PLACE_NOTE, ""), config.PLACE_DOUBT, ""), F.lit(" .,")))
    first = F.get(F.filter(parts, lambda p: (p != "") & ~p.rlike(config.COUNTRY_CODE)), 0)
    return F.when(first != config.UNKNOWN_PLACE, first)


def title_of(title):
    """A periodical's title without its issue."""
    s = T.strip(F.ltrim(T.strip(title), F.lit("[")))
    return F.btrim(F.regexp_replace(s, config.ISSUE, ""), F.lit(" ]."))


def life_years(text):
    """(birth, death) from a range of years."""
    found = lambda k: F.nullif(F.regexp_extract(text, config.LIFE, k), F.lit("")).cast("int")
    return found(1), found(2)


def collection_class(collections, identifier, modern: tuple[str, ...], old: tuple[str, ...]):
    """Ordered rules on a set of collections."""
    has = lambda names: F.arrays_overlap(collections, F.array(*map(F.lit, names)))
    return (
        F.when(has(modern), "modern_scan").when(F.array_contains(collections, "opensource"), "community_upload").when(F.array_contains(collections, "googlebooks") | identifier.endswith("goog"), "google_books").when(has(old), "institutional_old").otherwise("other")
    )


def as_list(value):
    """A catalogue field that is a string or a list of strings, read as VARIANT, as a list."""
    many = F.try_variant_get(value, "$", "array<string>")
    return F.coalesce(many, F.array_compact(F.array(F.try_variant_get(value, "$", "string"))))


@R.add(f"SELECT doc_id, {strip(f'regexp_replace(text, ' + repr('[' + BLANK + ']+').replace(chr(92) * 2, chr(92)) + ', chr(32), ' + repr('g') + ')')} = array_to_string({words('text')}, ' ') AS same FROM documents")
def scoring_form_is_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant: the scoring form of a text is its words with one blank between them."""
    return table(spark, sf_dir, "documents").select("doc_id", (T.scoring_form("text") == F.array_join(T.words("text"), " ")).alias("same"))
