"""Answers of outside services as data.

A look-up is a table of answers joined on its key.  Where a service must be asked
live, each distinct key is asked once, by a client that the caller supplies, and the
answers become such a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(df: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Rows with their answers; one answer for each key, the smallest."""
    rest = [c for c in answers.columns if c != key]
    one = answers.groupBy(key).agg(F.min(F.struct(*rest)).alias("_a")).select(key, *[F.col(f"_a.{c}").alias(c) for c in rest])
    return df.join(one, key, "left")


def ask(df: DataFrame, key: str, client: Callable[[], Callable[[str], dict]], schema: str) -> DataFrame:
    """(key, answer columns) for each distinct key; ``client()`` is made once a task."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        call = client()
        for batch in batches:
            yield pd.DataFrame([{key: k, **call(k)} for k in batch[key]])

    return df.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, schema)


def accepted(answers: DataFrame, score: str, least: float) -> DataFrame:
    return answers.where(F.col(score) >= least)
