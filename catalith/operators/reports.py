"""Counters, playlists and outlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions import audio, text
from catalith.functions import vocabulary as V


def status_counters(archive: DataFrame) -> DataFrame:
    """All counters in one pass."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return archive.agg(F.count("*").alias("total"), n("PENDING"), n("HASHED"), n("CATALOGUED"), n("GHOST"), n("QUARANTINED"), F.countDistinct("artist").alias("artists"), F.max("finalized_at").alias("last_finalized"))


def breakdown(archive: DataFrame) -> DataFrame:
    """Totals by genre and codec with subtotals; level 0 detail, 1 genre, 3 all."""
    rows = archive.select(F.coalesce("genre", F.lit("(none)")).alias("genre"), F.coalesce("codec", F.lit("(none)")).alias("codec"), "size_bytes")
    return rows.rollup("genre", "codec").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def bitrate_bands(archive: DataFrame) -> DataFrame:
    k = audio.kbps(F.col("bitrate"))
    band = F.when(k.isNull(), "unknown").when(k < 128, "under 128").when(k < 256, "128-255").when(k < 500, "256-499").otherwise("500 and more")
    return archive.groupBy(band.alias("band")).agg(F.count("*").alias("files"))


def upgrades(archive: DataFrame, min_gap: int = 100) -> DataFrame:
    """Lossy files for which a lossless one of the same artist and title is there."""
    rows = archive.where((F.trim("artist") != "") & (F.trim("title") != "")).select("file_path", F.lower(F.trim("artist")).alias("a"), F.lower(F.trim("title")).alias("t"), F.coalesce(audio.kbps(F.col("bitrate")), F.lit(0)).alias("kbps"), F.lower(F.coalesce("codec", F.lit(""))).isin(*V.LOSSLESS_CODECS).alias("lossless"))
    best = rows.where("lossless").groupBy("a", "t").agg(F.max("kbps").alias("best_kbps"))
    return rows.where("not lossless").join(best, ["a", "t"]).where(F.col("best_kbps") - F.col("kbps") >= min_gap).select("file_path", "kbps", "best_kbps")


def outliers(archive: DataFrame, low: int = 96, high: int = 2000) -> DataFrame:
    k = audio.kbps(F.col("bitrate"))
    why = F.when(k < low, "bitrate low").when(k > high, "bitrate high").when(~F.col("sample_rate").isin(44100, 48000), "sample rate").when(F.col("channels") > 2, "channels")
    return archive.select("file_path", why.alias("why")).where(F.col("why").isNotNull())


def playlist_lines(archive: DataFrame) -> DataFrame:
    """Every line of every playlist: one list for each primary genre, and one for all.

    Genres whose names give the same file share one list.
    """
    rows = archive.where((F.col("status") == "CATALOGUED") & (F.trim("genre") != ""))
    rows = rows.select(text.genre_file_name(text.primary_genre(F.col("genre"))).alias("playlist"), text.extinf(F.col("artist"), F.col("title"), F.col("file_path")).alias("info"), "file_path")
    return rows.unionByName(rows.withColumn("playlist", F.lit("All")))


def genre_counts(archive: DataFrame) -> DataFrame:
    return archive.where(F.trim("genre") != "").groupBy(text.primary_genre(F.col("genre")).alias("genre")).agg(F.count("*").alias("tracks"), F.countDistinct("file_path").alias("files"))


def review_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("cnt"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def report_lines(df: DataFrame, *columns: str) -> DataFrame:
    """One line of text for each row, for a text sink."""
    return df.select(F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value"))


def analysable(archive: DataFrame, least: float = 10.0, channels: int = 2) -> DataFrame:
    """Rows long enough and with few enough channels to be analysed."""
    return archive.where((F.col("duration") >= least) & (F.col("channels") <= channels))


def run_stages(events: DataFrame) -> DataFrame:
    """Processed, changed and failed counts of each stage."""
    return events.groupBy("stage").agg(F.count("*").alias("processed"), F.count_if(F.col("outcome") == "changed").alias("changed"), F.count_if(F.col("outcome") == "error").alias("errored"))
