"""A training-data pipeline of five stages over ``documents``.

Language ID lets documents go that have no language or a guessed one; line dedup takes
out lines that stand elsewhere (a document goes if nothing or only blank lines are left of it); the n-gram join
keeps one document of each group of near copies; decontamination lets documents go that
hold a window of a benchmark item; the BPE automaton encodes what is left.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns the
columns of ``documents``; only the last returns token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import automaton, langid, line_dedup, ngram_join, positional
from skein.llm.queries import tokenizer_path
from skein.llm.rows import keys, same
from skein.session import Scratch, ship_package

#: a document whose best language has less than this is rejected: little more than a guess among
#: four. Short clean texts often score 0.4 to 0.6, so the bound is low.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null and empty texts and those without a letter go, whatever their key;
    repeated rows are judged alike. Without any labelled row there is no network: then all texts
    with a letter stay. An empty table stays empty.
    """
    network = langid.fit(langid.learnable(docs))
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    found = langid.predict(docs, network)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; ``n_chars`` counts what is left. Null texts, and texts
    of blank lines only, stay as they are. The first document by id (null last) keeps a line;
    of repeated rows one stays.
    """
    kept = line_dedup.drop_lines(docs, line_dedup.duplicate_lines(spark, docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first by id (null last), then text. Null and blank texts
    are in no group and stay; of repeated rows one stays.
    """
    return ngram_join.keep_first(docs, ngram_join.link_components(spark, docs)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and blank texts hold none and stay; repeated rows
    are judged alike; an empty benchmark or one of null texts takes nothing away.
    """
    found = positional.contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = Scratch(spark, "hit").table(found.filter("size(items) > 0").select("doc_id", "text_hash").distinct(), "rows")  # its size is known, so few hits need no shuffle of texts
    return docs.join(keys(hit), same("doc_id", "text"), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of ids and digests for each document; null texts are encoded as empty, repeated rows repeat."""
    coded = automaton.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.selectExpr("doc_id", "cast(length(ids) / 4 AS long) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256", "ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("n-gram join", near_copies),
    ("decontamination", decontamination),
    ("BPE automaton", tokens),
]
#: minimum hashes, trained weights and merges are beyond SQL; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
