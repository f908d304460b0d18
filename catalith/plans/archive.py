"""An archive-shaped view over the test tables, one text for both dialects.

Every value follows from the key by arithmetic, so the view is the same in Spark
and in DuckDB, at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ARTISTS = ("Chieftains", "Beatles", "Abba", "Simon and Garfunkel", "Karaoke Channel", "Various Artists", "De La Soul", "AC/DC", "Sigur Rós", "Neil Young", "Pink Floyd", "Kinks")


def _case(number: str, values, n: int) -> str:
    return f"CASE {number} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def archive_sql(source: str = "part", sha: str = "sha256", text: str = "VARCHAR") -> str:
    name = _case("k", ["'" + a + "'" for a in _ARTISTS], len(_ARTISTS))
    spelled = _case("(k // 12)", ["nm", "'The ' || nm", "nm || ', The'", "nm || ' (the)'", "upper(nm)", "nm || ' feat. Guest & Co'", "lower(nm)"], 7)
    title = _case("(k // 5)", ["p_name", "p_name || ' (Remaster)'", "p_name || ' (Live)'", "p_name || ' [2]'", "p_name || ' (2015)'", "upper(p_name)", "'01. ' || p_name", "p_name || ' PART XIV'", "'the \"' || p_name || '\": a/b?'", "NULL", "''"], 11)
    album = _case("k", ["NULL", "''", "'Best of ' || p_brand", "'best of  ' || p_brand", "p_brand || ' Tribute Album'", "'BEST OF ' || p_brand", "'Greatest Hits. '"], 7)
    genre = _case("(k // 3)", ["NULL", "'ROCK'", "'Hip-Hop/Rap'", "'Electroni'", "'Jazz, Fusion'", "'Rock'", "'Polka'", "'R&B/Funk/Soul'"], 8)
    codec = _case("k", ["'flac'", "'alac'", "'mp3'", "'aac'", "''"], 5)
    ext = _case("k", ["'.flac'", "'.m4a'", "'.mp3'", "'.m4a'", "'.ogg'"], 5)
    folder = _case("k", ["'DUPES_MOVED_FOR_REVIEW/'", "'TRIBUTE_REMOVED_FOR_REVIEW/'"] + ["''"] * 7, 9)
    status = _case("k", ["'PENDING'", "'HASHED'", "'GHOST'", "'QUARANTINED'", "NULL", "'DUPE_REVIEW'"] + ["'CATALOGUED'"] * 11, 17)
    done = _case("k", ["NULL", "''", "'2026-01-02 03:04:05'", "'2026-02-03 04:05:06'"], 4)
    return f"""
SELECT k AS id, '/vault/lib/' || folder || p_brand || '/' || nm || ' - ' || p_name || ' ' || CAST(k AS {text}) || ext AS file_path, ext,
       1000 + (k * 7919) % 40000000 AS size_bytes, status,
       CASE WHEN k % 37 = 0 THEN NULL ELSE {sha}(p_name || '|' || CAST(p_size AS {text})) END AS audio_hash,
       {title} AS title, CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN ' ' ELSE {spelled} END AS artist,
       {album} AS album, {genre} AS genre, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(1960 + k % 60 AS {text}) END AS year,
       CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 20 + 1 AS INTEGER) END AS track,
       CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN 0.5E0 ELSE CAST(10 + k % 400 AS DOUBLE) END AS duration,
       CAST({_case("k", ["320000", "900000", "128000", "50000", "250000", "NULL", "12000000", "100000"], 8)} AS BIGINT) AS bitrate,
       CAST({_case("k", ["44100", "48000", "96000"], 3)} AS BIGINT) AS sample_rate, CAST(CASE WHEN k % 29 = 0 THEN 6 ELSE 2 END AS INTEGER) AS channels,
       {codec} AS codec, {done} AS finalized_at, CAST(k % 70 - 53 AS DOUBLE) / 2 AS lufs, CAST(k % 40 - 30 AS DOUBLE) / 4 AS lufs_tp
FROM (SELECT p_partkey AS k, p_name, p_brand, p_size, {name.replace("k %", "p_partkey %")} AS nm, {ext.replace("k %", "p_partkey %")} AS ext,
             {folder.replace("k %", "p_partkey %")} AS folder, {status.replace("k %", "p_partkey %")} AS status FROM {source})
"""


def duck_archive() -> str:
    return archive_sql()


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over ``part``; only the columns that a query uses are computed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sql = archive_sql("{part}", "sha2_256", "STRING").replace("//", "div").replace("sha2_256(p_name || '|' || CAST(p_size AS STRING))", "sha2(p_name || '|' || CAST(p_size AS STRING), 256)")
    return spark.sql(sql.replace("'/vault/lib/'", "'/vault/lib/'"), part=part)
