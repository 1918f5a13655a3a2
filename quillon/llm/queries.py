"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat_threads, decontaminate, language_id, license_scan, mixing, multiprobe_ann, ngram_jaccard, quality_cnn, substring_dedup, url_cascade
from quillon.llm.oracle import ORACLE_SQL as ORACLE_SQL
from quillon.llm.store import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_cnn.remainder(5) == 0)


def op3_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multiprobe_ann.neighbours(vectors, vectors.where(f"vec_id % {multiprobe_ann.EVERY} = 0"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_threads.reply_ordered(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), quality_cnn.remainder(4) == 2)


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.linked_documents(table(spark, sf_dir, "documents"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can say."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_multiprobe_ann": op3_multiprobe_ann,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_chat_threads": op6_chat_threads,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_url_cascade": op9_url_cascade,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "license_base_places": license_base_places,
}
