"""Row-level quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import audio, text
from catalith.functions import vocabulary as V


def issues() -> Column:
    """All issues of a row as an array of (issue, severity); empty if the row is sound."""
    bitrate, codec = F.col("bitrate"), F.lower(F.coalesce("codec", F.lit("")))
    rules = [
        ("MISSING_TITLE", "error", text.blank(F.col("title"))),
        ("MISSING_ARTIST", "error", text.blank(F.col("artist"))),
        ("MISSING_ALBUM", "warning", text.blank(F.col("album"))),
        ("MISSING_YEAR", "warning", text.blank(F.col("year"))),
        ("MISSING_GENRE", "warning", text.blank(F.col("genre"))),
        ("MISSING_TRACK", "warning", F.col("track").isNull()),
        ("ZERO_DURATION", "error", F.col("duration").isNull() | (F.col("duration") < 1.0)),
        ("SUSPICIOUS_BITRATE", "error", bitrate.isNull() | (bitrate < 64_000) | (bitrate > 10_000_000)),
        ("LOW_QUALITY", "warning", (bitrate >= 64_000) & (bitrate < 128_000)),
        ("LOSSLESS_EXPECTED", "warning", ((F.col("ext") == ".flac") | codec.isin("alac", "flac")) & (bitrate < 300_000)),
        ("NO_AUDIO_HASH", "warning", text.is_pending(F.col("audio_hash"))),
        ("UNKNOWN_CODEC", "warning", text.blank(F.col("codec"))),
    ]
    found = [F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for issue, severity, test in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def issue_rows(archive: DataFrame) -> DataFrame:
    """(file_path, issue, severity) of every row that isn't a ghost; null status isn't looked at."""
    return archive.where(F.col("status") != "GHOST").select("file_path", F.explode(issues()).alias("i")).select("file_path", "i.issue", "i.severity")


def breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("issue", "severity").agg(F.count("*").alias("cnt"))


def top_files(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.groupBy("file_path").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "file_path").limit(k)


def suspect_reason() -> Column:
    """Why a file looks corrupt: far too small for its length, or short without cause; else null."""
    codec, ext = F.lower(F.coalesce("codec", F.lit(""))), F.regexp_replace(F.lower(F.coalesce("ext", F.lit(""))), r"^\.", "")
    table = F.create_map(*[F.lit(x) for kv in V.MIN_BYTES_PER_SECOND.items() for x in kv])
    floor = F.coalesce(table[codec], table[ext], F.lit(V.MIN_BYTES_DEFAULT))
    known = F.coalesce(F.col("duration") > 0, F.lit(False))
    small = F.col("size_bytes") < floor * F.col("duration") * V.SIZE_SHARE
    short = (F.col("duration") < V.MIN_SECONDS) & ~text.any_word(text.stem(F.col("file_path")), V.SHORT_OK)
    return F.when(known & small, "too_small").when(known & short, "too_short")


def corrupt(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("status") == "CATALOGUED").select("file_path", suspect_reason().alias("reason")).where(F.col("reason").isNotNull())


def loudness_window(archive: DataFrame) -> DataFrame:
    lufs, peak = F.col("lufs"), F.col("lufs_tp")
    return archive.where(lufs.isNotNull() & audio.flagged(lufs, peak)).select("file_path", "lufs", "lufs_tp", audio.flag_reasons(lufs, peak).alias("reasons"))


def canon_action() -> Column:
    codec, ext = F.lower(F.coalesce("codec", F.lit(""))), F.lower(F.coalesce("ext", F.lit("")))
    return F.when(codec.isin("alac", "aac") & (ext == ".m4a"), "PASSTHROUGH").when(codec.isin(*V.LOSSLESS_CODECS), "CONVERT").otherwise("TRANSCODE")


def junk(archive: DataFrame) -> DataFrame:
    rows = archive.select("file_path", text.junk_reason(F.col("artist"), F.col("title"), F.col("album")).alias("reason"))
    return rows.where(F.col("reason").isNotNull())


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
