"""A corpus pipeline of five stages, each over all that its predecessor kept.

language         rejects documents whose language can't be told, such as those without letters
near_duplicates  five-word shingles, similarity 0.8: of each class the document
                 with the smallest id stays
personal_data    entities become their kind, terms that give them away go; no
                 document is dropped
mix              sources to weights 5, 2, 1 in turn, at most three passes; documents
                 are repeated whole
bpe              token ids of each document of the mix

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.llm.bpe_codec import bpe_round_trip
from catalith.llm.common import written
from catalith.llm.jaccard import Rule, one_of_each_class
from catalith.llm.language import keep_identified
from catalith.llm.mixing import mixed_documents
from catalith.llm.pii import without_personal_data
from catalith.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs, Rule(words=5, num=8, den=10))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"), digests=False).select("doc_id", "n_tokens", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("bpe", bpe)]

#: Language identification and byte-pair encoding have no SQL form; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
