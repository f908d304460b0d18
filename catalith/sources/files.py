"""Folders, tables of names, sheets, manifests and playlists as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.functions import audio, text
from catalith.functions import vocabulary as V


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = V.AUDIO_EXTENSIONS, skip_first: tuple[str, ...] = (), skip_any: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, ext, size_bytes, modified) of the files below a folder; contents aren't read.

    A folder that isn't there gives no rows.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, name string, ext string, size_bytes long, modified timestamp")
    path = F.regexp_replace("path", "^file:(//)?", "")
    root = folder.removeprefix("file://").rstrip("/")
    files = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.date_trunc("second", "modificationTime").alias("modified"))
    parts = F.split(F.substring("path", len(root) + 2, 100_000), "/")
    keep = text.extension(F.col("path")).isin(*extensions)
    if skip_first:
        keep &= ~F.get(parts, F.lit(0)).isin(*skip_first)
    for name in skip_any:
        keep &= ~F.array_contains(parts, name)
    return files.where(keep).select("path", text.file_name(F.col("path")).alias("name"), text.extension(F.col("path")).alias("ext"), "size_bytes", "modified")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def canon_table(spark: SparkSession, path: str) -> DataFrame:
    """raw<TAB>canonical lines; blank lines and comments are skipped, the last line of a key wins."""
    lines = _numbered(spark, path).select("line", text.stripped(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#") & F.col("value").contains("\t"))
    key = text.canon_key(F.split_part("value", F.lit("\t"), F.lit(1)))
    rows = lines.select(key.alias("raw"), text.stripped(F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1)).alias("canonical"), "line")
    return rows.groupBy("raw").agg(F.max_by("canonical", "line").alias("canonical"))


def write_canon_table(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "raw", "canonical").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def word_list(spark: SparkSession, path: str, column: str = "genre") -> DataFrame:
    return _numbered(spark, path).select(text.stripped(F.col("value")).alias(column)).where((F.col(column) != "") & ~F.col(column).startswith("#")).distinct()


def write_review_sheet(df: DataFrame, path: str) -> None:
    df.withColumn("confidence", F.format_string("%.2f", "confidence")).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.withColumns({"confidence": F.col("confidence").try_cast("double"), "approve": F.lower(F.trim(F.coalesce("approve", F.lit(""))))})


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def restore_commands(df: DataFrame) -> DataFrame:
    """One shell command for each moved file; names are quoted."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return df.select(F.concat(F.lit("mv -n -- "), quoted("destination"), F.lit(" "), quoted("source")).alias("value"))


def lossy_rows(archive: DataFrame, known: DataFrame) -> DataFrame:
    """Rows for the list of lossy files that it doesn't hold yet."""
    rows = archive.where(~F.lower(F.coalesce("codec", F.lit(""))).isin(*V.LOSSLESS_CODECS)).join(known.select("file_path").distinct(), "file_path", "left_anti")
    return rows.select("artist", "title", "album", F.upper("codec").alias("codec"), audio.kbps(F.col("bitrate")).alias("kbps"), F.round("duration", 1).alias("duration"), "file_path")


def write_playlists(lines: DataFrame, path: str) -> None:
    """One folder of M3U8 text for each playlist, in order of the information line and the path."""
    entry = F.concat("info", F.lit("\n"), "file_path")
    lines.select("playlist", entry.alias("value")).repartition("playlist").sortWithinPartitions("playlist", "value").write.mode("overwrite").partitionBy("playlist").text(path)


def playlist_entries(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(info, file_path) of the entries of a playlist that lie below a root."""
    rows = _numbered(spark, path).where("trim(value) <> ''")
    before = F.lag("value").over(Window.partitionBy(F.lit(1)).orderBy("line"))
    rows = rows.withColumn("info", F.when(before.startswith("#EXTINF"), before)).where(~F.col("value").startswith("#"))
    return rows.where(F.col("value").startswith(root.rstrip("/") + "/")).select("info", F.col("value").alias("file_path"))


def failure_report(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def settings(*texts: str) -> dict[str, str]:
    """KEY=VALUE lines; later texts win, comments and blank lines are skipped."""
    out: dict[str, str] = {}
    for lines in texts:
        for line in lines.splitlines():
            key, sign, value = line.strip().partition("=")
            if sign and not key.startswith("#"):
                out[key.strip().removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out
