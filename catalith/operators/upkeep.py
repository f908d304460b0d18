"""Plans for work on the files themselves: names, tags, modes, covers, conversions.

Each is a table of what is to be done; doing it is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import text
from catalith.functions import vocabulary as V
from catalith.operators import dupes

LIVE = "status = 'CATALOGUED'"


def organised(df: DataFrame, root: str = "/library") -> DataFrame:
    """(file_path, target, verdict): each file's place by artist and album, and whether it stays, is renamed or moves.

    A file that is where it belongs stays there, and no other gets its path.
    """
    known = lambda c, d: F.when(F.coalesce(F.trim(c), F.lit("")) == "", d).otherwise(F.col(c))
    folder = F.concat(F.lit(root + "/"), text.path_component(known("artist", "Unknown Artist")), F.lit("/"), text.path_component(known("album", "Unknown Album")))
    rows = df.select("file_path", F.concat(folder, F.lit("/"), text.track_filename(F.col("artist"), F.col("title"), F.col("ext"))).alias("target"))
    stays = rows.where("file_path = target")
    moving = rows.where("file_path != target")
    moving = dupes.with_collision_suffix(moving, "target", "file_path", df.select(F.col("file_path").alias("path"))).select("file_path", F.col("final_path").alias("target"))
    place = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    verdict = F.when(F.col("file_path") == F.col("target"), "skip").when(place("file_path") == place("target"), "rename").otherwise("move")
    return stays.unionByName(moving).withColumn("verdict", verdict)


def tag_changes(df: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_path, field, old_value, new_value) where the catalogue has a value that the file's tags differ from.

    The album artist follows the artist only if it is the same artist spelt otherwise:
    its article moved to the end gives the artist.
    """
    fields = ["artist", "album", "title", "genre", "year", "track"]
    value = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    d, t = df.alias("d"), tags.alias("t")
    rows = d.join(t, F.col("d.file_path") == F.col("t.file_path"))
    pairs = [F.struct(F.lit(f).alias("field"), value(F.col(f"t.{f}")).alias("old_value"), value(F.col(f"d.{f}")).alias("new_value")) for f in fields]
    album_artist, artist = value(F.col("t.albumartist")), value(F.col("d.artist"))
    same = (album_artist != "") & (text.article_to_suffix(album_artist) == artist)
    pairs.append(F.struct(F.lit("albumartist").alias("field"), album_artist.alias("old_value"), F.when(same, artist).otherwise("").alias("new_value")))
    out = rows.select("d.file_path", F.explode(F.array(*pairs)).alias("c")).select("file_path", "c.*")
    return out.where((F.col("new_value") != "") & (F.col("old_value") != F.col("new_value")))


def to_measure(df: DataFrame, stamp: str, force: bool = False) -> DataFrame:
    """Files whose loudness is still to be measured and tagged, or all of the working population."""
    rows = df.where(LIVE)
    return rows if force else rows.where(text.is_pending(F.col(stamp)))


def to_embed(df: DataFrame, stamp: str, tagged: DataFrame) -> DataFrame:
    """Files that were measured but whose tags lack the values: these are written from the catalogue."""
    measured = df.where(LIVE).where(~text.is_pending(F.col(stamp)) & F.col("lufs").isNotNull())
    return measured.join(tagged.select("file_path").distinct(), "file_path", "left_anti")


def wrong_modes(listing: DataFrame, file_mode: int = 0o664, dir_mode: int = 0o775) -> DataFrame:
    """(path, kind, mode, wanted) of files and folders whose mode isn't the wanted one; what has no mode is left out."""
    wanted = F.when(F.col("kind") == "dir", dir_mode).when(F.col("kind") == "file", file_mode)
    return listing.select("path", "kind", "mode", wanted.alias("wanted")).where(F.col("mode") != F.col("wanted"))


def analysis_state(df: DataFrame, stamp: str, least: float = 60.0, most: float = 200.0, tempo: str = "tempo") -> DataFrame:
    """(file_path, state, bpm): what is done, skipped for good (more than two channels), or still to be analysed.

    A measured tempo is halved or doubled once into ``least`` to ``most``.
    """
    t = F.col(tempo)
    bpm = F.when(t > most, t / 2).when((t > 0) & (t < least), t * 2).otherwise(t)
    state = F.when(~text.is_pending(F.col(stamp)), "done").when(F.coalesce("channels", F.lit(2)) > 2, "skipped_multichannel").otherwise("pending")
    return df.where(LIVE).select("file_path", state.alias("state"), F.when((t > 0) & (state != "skipped_multichannel"), F.round(bpm, 2)).alias("bpm"))


def sidecars(df: DataFrame, listing: DataFrame, names: tuple[str, ...] = V.SIDECAR_NAMES) -> DataFrame:
    """(file_path, cover): the first of the known picture names that lies in the file's folder."""
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    best = listing.select(folder.alias("folder"), rank.alias("rank"), "path").where("rank > 0").groupBy("folder").agg(F.min(F.struct("rank", "path")).alias("b"))
    rows = df.select("file_path", F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"))
    return rows.join(best, "folder").select("file_path", F.col("b.path").alias("cover"))


def transcodes(df: DataFrame, there: DataFrame, root: str = "/transcode", container: str = "m4a") -> DataFrame:
    """(file_path, target) of lossless files that are still there: artist, album, and a numbered title."""
    known = lambda c, d: text.folder_name(F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c)), 60)
    number = F.when(F.col("track") >= 0, F.concat(F.lpad(F.col("track").cast("string"), F.greatest(F.length(F.col("track").cast("string")), F.lit(2)), F.lit("0")), F.lit(" - "))).otherwise("")
    title = text.folder_name(F.when(F.coalesce("title", F.lit("")) == "", text.stem(F.col("file_path"))).otherwise(F.col("title")), 60)
    target = F.concat_ws("/", F.lit(root), known("artist", "Unknown Artist"), known("album", "Unknown Album"), F.concat(number, title, F.lit("." + container)))
    rows = df.where(LIVE).where(F.lower(F.coalesce("codec", F.lit(""))).isin(*V.LOSSLESS_CODECS))
    return rows.join(there.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("file_path", target.alias("target"))


def with_answers(df: DataFrame, artists: DataFrame, releases: DataFrame) -> DataFrame:
    """(file_path, mb_artist_id, mb_release_id) from tables of answers: artist by name, release by artist and album.

    Only files of the working population that have an artist and no id yet are looked up.
    """
    rows = df.where(LIVE).where((F.trim("artist") != "") & text.is_pending(F.col("mb_artist_id"))).select("file_path", F.lower(F.trim("artist")).alias("a"), F.lower(F.trim("album")).alias("b"))
    by_artist = artists.groupBy(F.lower(F.trim("artist")).alias("a")).agg(F.min("mb_artist_id").alias("mb_artist_id"))
    by_release = releases.groupBy(F.lower(F.trim("artist")).alias("a"), F.lower(F.trim("album")).alias("b")).agg(F.min("mb_release_id").alias("mb_release_id"))
    return rows.join(by_artist, "a", "left").join(by_release, ["a", "b"], "left").where("mb_artist_id is not null or mb_release_id is not null").select("file_path", "mb_artist_id", "mb_release_id")


def preflight(df: DataFrame, free_gb: Column, warn_gb: float = 100, fail_gb: float = 50) -> DataFrame:
    """(name, result, detail) of checks before a run: room, keys that are null or repeated, states that aren't known."""
    n = df.groupBy("file_path").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("file_path").isNull()).alias("missing"))
    states = df.agg(F.count_if(~F.coalesce("status", F.lit("")).isin(*V.STATUSES)).alias("strange"))
    room = F.when(free_gb < fail_gb, "FAIL").when(free_gb < warn_gb, "WARN").otherwise("OK")
    verdict = lambda c, bad: F.when(F.col(c) > 0, bad).otherwise("OK")
    row = lambda name, result, detail: F.struct(F.lit(name).alias("name"), result.alias("result"), detail.cast("string").alias("detail"))
    checks = F.array(row("room", room, free_gb), row("repeated_keys", verdict("repeated", "FAIL"), F.col("repeated")), row("missing_keys", verdict("missing", "FAIL"), F.col("missing")), row("states", verdict("strange", "WARN"), F.col("strange")))
    return n.crossJoin(states).select(F.explode(checks).alias("c")).select("c.*")  # one row each


def integrity(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """(file_path, integrity_ok): whether the file could be decoded; of several tries the last counts."""
    last = decoded.groupBy("file_path").agg(F.max(F.struct("ts", F.coalesce("ok", F.lit(False)).alias("ok"))).alias("l"))
    return df.where(LIVE).select("file_path").join(last, "file_path").select("file_path", F.col("l.ok").alias("integrity_ok"))


def rebuilt(listing: DataFrame, hashes: DataFrame, probes: DataFrame, limit: int | None = None) -> DataFrame:
    """Catalogue rows for the files on disk, the first ``limit`` by path if given: hash and metadata where known."""
    rows = listing.select(F.col("path").alias("file_path"), "size_bytes").dropDuplicates(["file_path"])
    rows = rows.orderBy("file_path").limit(limit) if limit is not None else rows
    rows = rows.join(hashes.groupBy(F.col("path").alias("file_path")).agg(F.min("sha256").alias("audio_hash")), "file_path", "left").join(probes, "file_path", "left")
    return rows.withColumn("status", F.when(F.col("audio_hash").isNull(), "PENDING").when(F.col("title").isNull() & F.col("artist").isNull(), "HASHED").otherwise("CATALOGUED"))


def canon_review(names: DataFrame) -> DataFrame:
    """(raw, files): names that no canon table resolves, most used first, each to be decided on."""
    return names.where("source = 'none'").groupBy("raw").agg(F.sum("n").alias("files"))


def readded(ledger: DataFrame, df: DataFrame) -> DataFrame:
    """Ledger rows to add again: the best finalised file of each hash that the ledger has lost."""
    lost = df.where(F.col("audio_hash").isNotNull() & ~text.is_pending(F.col("finalized_at"))).join(ledger.select("audio_hash").distinct(), "audio_hash", "left_anti")
    order = Window.partitionBy("audio_hash").orderBy(F.desc(F.coalesce("size_bytes", F.lit(0))), "file_path")
    return lost.withColumn("place", F.row_number().over(order)).where("place = 1").select("audio_hash", "file_path")
