"""The subpackage's queries, with production parameters, over whole tables."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import automaton, html_layout, langid, line_dedup, media, ngram_join, notices, positional, privacy, seekable, twins
from skein.session import ship_package


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place: $SKEIN_TOKENIZERS if set, else the installed public package."""
    if folder := os.environ.get("SKEIN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(langid.learnable(docs)), keep=["doc_id"])
    return found.selectExpr("doc_id", "crc32(cast(doc_id AS string)) % 4 = 2 AS held_out", "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = seekable.token_files(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return seekable.digests(seekable.read_tokens(files, folder))


def op3_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.digest(notices.scan(documents(spark, sf_dir)))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.find(spark, documents(spark, sf_dir)))


def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return html_layout.visible_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(ngram_join.link_components(spark, documents(spark, sf_dir)))


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return positional.digest(found)


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.duplicate_lines(spark, documents(spark, sf_dir)))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(ids: bytes, decoded: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return automaton.encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=digest, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_cnn": op1_byte_cnn,
    "op2_token_files": op2_token_files,
    "op3_notices": op3_notices,
    "op4_disclosure": op4_disclosure,
    "op5_layout_text": op5_layout_text,
    "op6_count_vector_join": op6_count_vector_join,
    "op7_positional_index": op7_positional_index,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op10_media_tiles": op10_media_tiles,
}
#: what the others return (trained weights, minima, files, engines' spans) is beyond SQL; tests hold them to plain Python
ORACLES: dict[str, str] = dict(twins.ORACLES)
