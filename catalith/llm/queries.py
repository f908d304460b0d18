"""The thin queries over the test tables; the operators have wider interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of the documents whose id is divisible by 20 against every row of ``documents``."""
    from pyspark.sql import functions as F

    from catalith.llm.bm25 import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text"), k=10)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.bpe_codec import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), digests=True)


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    from pyspark.sql import functions as F

    from catalith.llm.chat import preference_pairs

    return preference_pairs(table(spark, sf_dir, "conversations"), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.jaccard import Rule, jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from catalith.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``benchmark``, a short passage, against every row of ``documents``."""
    from catalith.llm.bm25 import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), k=10)


#: Further jobs of the operators.
FURTHER: dict[str, Query] = {"bm25_benchmark": search_benchmark}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
