"""Arrivals as a stream: each path is registered once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Listings that land as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def register(batch: DataFrame, catalogue: str) -> None:
    """Append the paths of a batch that the catalogue doesn't have, as PENDING rows."""
    spark = batch.sparkSession
    new = batch.groupBy("file_path").agg(F.max("size_bytes").alias("size_bytes")).withColumn("status", F.lit("PENDING"))
    try:
        known = spark.read.parquet(catalogue).select("file_path")
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        known = None
    if known is not None:
        new = new.join(known, "file_path", "left_anti")
    new.write.mode("append").parquet(catalogue)


def ingest_available(spark: SparkSession, folder: str, catalogue: str, checkpoint: str, schema: StructType) -> StreamingQuery:
    """Take in all that has arrived since the last run, then stop."""
    return arrivals(spark, folder, schema).writeStream.foreachBatch(lambda batch, _: register(batch, catalogue)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
