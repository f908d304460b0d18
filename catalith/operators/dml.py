"""Table changes as pure functions: each returns the new state of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(target: DataFrame, source: DataFrame, key: str, supplied: list[str]) -> DataFrame:
    """Overwrite only the supplied columns where the key exists, insert the rest.

    A supplied null wins over a value; columns that aren't supplied keep theirs.  The
    caller says what is supplied; it isn't guessed from nulls.  ``source`` has one
    row for each key.
    """
    s = source.select(F.col(key).alias("_key"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in supplied])
    joined = target.join(s, target[key] == s["_key"], "full_outer")
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.coalesce(target[c], s["_key"]).alias(c))
        elif c in supplied:
            columns.append(F.when(s["_there"], s[f"_{c}"].cast(target.schema[c].dataType)).otherwise(target[c]).alias(c))
        else:
            columns.append(target[c])
    return joined.select(*columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet, one for each key (the smallest row wins)."""
    rest = [c for c in target.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else rows.select(*keys).distinct()
    one = one.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else one
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def update_by_map(df: DataFrame, mapping: DataFrame, column: str, where: str = "status = 'CATALOGUED'") -> DataFrame:
    """Replace values by (old, new) pairs on the rows that ``where`` selects."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = df.join(m, (df[column] == m["_old"]) & F.expr(where), "left")
    return joined.select(*[F.coalesce("_new", df[c]).alias(c) if c == column else df[c] for c in df.columns])


def soft_reset(df: DataFrame, cleared: tuple[str, ...] = ("audio_hash",)) -> DataFrame:
    return df.withColumns({"status": F.lit("PENDING")} | {c: F.lit(None).cast(df.schema[c].dataType) for c in cleared})


def delete_matching(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def empty_like(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def evolved(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One event row for each value that differs: key, field, old_value, new_value."""
    b = before.select(F.col(key).alias(key), *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    a = after.select(F.col(key).alias(key), *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    fields = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_b_{c}").alias("old_value"), F.col(f"_a_{c}").alias("new_value"))) for c in columns]
    return a.join(b, key).select(key, F.explode(F.filter(F.array(*fields), lambda x: x.isNotNull())).alias("e")).select(key, "e.*")


#: Fields that a review sheet may set.
REVIEWABLE = ("artist", "title", "album", "genre", "year")


def apply_review(archive: DataFrame, sheet: DataFrame) -> DataFrame:
    """Set the approved values; a field outside the list is never touched."""
    ok = sheet.where((F.lower("approve") == "yes") & F.col("field_name").isin(*REVIEWABLE))
    wide = ok.groupBy("file_path").agg(*[F.max(F.when(F.col("field_name") == c, F.col("new_value"))).alias(f"_{c}") for c in REVIEWABLE])
    joined = archive.join(wide, "file_path", "left")
    return joined.select(*[F.coalesce(f"_{c}", archive[c]).alias(c) if c in REVIEWABLE else archive[c] for c in archive.columns])


def review_counts(sheet: DataFrame) -> DataFrame:
    a = F.lower(F.trim(F.coalesce("approve", F.lit(""))))
    return sheet.agg(F.count_if(a == "yes").alias("approved"), F.count_if(a == "no").alias("rejected"), F.count_if(~a.isin("yes", "no")).alias("pending"))
