"""The corpus pipeline: documents through five stages, each over all that the stage before kept.

All stages but the last return the columns of documents, whatever these are; the last one adds how much of each document
the mix takes. A null text has no words: the classifier judges it as an empty text, and it is no near duplicate, no
repeat and no leak of anything; an empty text likewise. Texts are never cut to a prefix, however long. Near duplicates
with the smallest doc_id stay, of rows that share a doc_id the one of the smallest hash; a null doc_id is never a
duplicate. Rows without source are a source of their own. Empty tables give an empty result: without labels every
document scores 0.5 and stays, without benchmark nothing leaks. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, ngram_jaccard, quality_cnn, substring_dedup
from quillon.llm.store import cut, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates."""
    return ngram_jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a smaller document holds."""
    return substring_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, source_size, target and taken words."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mix_sources),
]
#: The classifier and the benchmark search are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else cut(docs), sf_dir)
    return docs
