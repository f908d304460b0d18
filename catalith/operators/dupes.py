"""Duplicate detection, survivor selection and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import audio, similarity, text
from catalith.functions import vocabulary as V


def exact_groups(df: DataFrame, digest: str, prefix: str = "dup_") -> DataFrame:
    groups = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("members"))
    return groups.where(F.col("members") > 1).select(text.group_id(prefix, F.col(digest)).alias("group_id"), "members")


def first_seen(df: DataFrame, digest: str, key: str) -> DataFrame:
    """Each later copy with the first row of its digest; the first comes from one aggregate."""
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("first_key"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, digest).where(F.col(key) != F.col("first_key")).select(F.col(key).alias("copy_key"), "first_key")


def keeper_order() -> list[Column]:
    """Lossless first, then bit rate, then size, then path."""
    lossless = F.lower(F.coalesce("codec", F.lit(""))).isin(*V.LOSSLESS_CODECS)
    return [F.desc(lossless), F.desc(F.coalesce("bitrate", F.lit(0))), F.desc(F.coalesce("size_bytes", F.lit(0))), F.asc("file_path")]


def ranked(df: DataFrame, group: str) -> DataFrame:
    own = Window.partitionBy(group)
    return df.withColumns({"place": F.row_number().over(own.orderBy(*keeper_order())), "members": F.count("*").over(own)})


def keepers_and_losers(df: DataFrame, group: str, lone_moves: Column | None = None) -> DataFrame:
    """Verdict for each member; a lone member moves only where ``lone_moves`` says so."""
    lone = F.lit(False) if lone_moves is None else lone_moves
    verdict = F.when((F.col("members") == 1) & lone, "loser").when(F.col("place") == 1, "keeper").otherwise("loser")
    return ranked(df, group).withColumn("verdict", verdict)


def orphan_winner(df: DataFrame) -> DataFrame:
    """The member to restore of each hash group: finalised first, then size, then path."""
    order = [F.col("finalized_at").isNull(), F.desc(F.coalesce("size_bytes", F.lit(0))), F.asc("file_path")]
    place = F.row_number().over(Window.partitionBy("audio_hash").orderBy(*order))
    return df.where(F.col("audio_hash").isNotNull()).withColumn("place", place).where("place = 1").drop("place")


def sole_copies(df: DataFrame) -> DataFrame:
    alone = df.where(F.col("audio_hash").isNotNull()).groupBy("audio_hash").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path"))
    return alone.where("n = 1").select("audio_hash", "file_path")


def claimed_once(losers: DataFrame) -> DataFrame:
    """A file that several groups would move is moved by the first of them."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("source_rank", "group_id"))
    return losers.withColumn("place", place).where("place = 1").drop("place")


def with_collision_suffix(df: DataFrame, target: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Targets of which no two are the same, nor one of ``taken`` (column path).

    The first row in ``order`` of a target keeps it if it is free.  The others get the
    numbers from 2 on that are free, in order: numbers that a target or a taken path
    already spells out, as in ``name (2).ext``, are left out.  A wanted target that
    spells a number out is kept where it is free, so it comes before numbering.
    """
    stem, ext = F.regexp_replace(F.col("want"), r"\.[^./]*$", ""), F.regexp_extract("want", r"(\.[^./]*)$", 1)
    number = F.regexp_extract("stem", r" \(([1-9][0-9]{0,8})\)$", 1)
    there = (taken.select(F.col("path").alias("want")) if taken is not None else df.select(F.col(target).alias("want")).limit(0)).distinct()
    spelt = df.select(F.col(target).alias("want")).unionByName(there).distinct().withColumns({"stem": stem, "ext": ext}).withColumn("n", number)
    spelt = spelt.where("n != '' and cast(n as int) >= 2").groupBy(F.regexp_replace("stem", r" \([0-9]+\)$", "").alias("of_stem"), F.col("ext").alias("of_ext"))
    spelt = spelt.agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("used"))

    rows = df.select(F.struct("*").alias("row"), F.col(target).alias("want"), F.col(order).alias("o"))
    rows = rows.join(there.withColumn("there", F.lit(1)), "want", "left").withColumns({"stem": stem, "ext": ext})
    place = F.row_number().over(Window.partitionBy("want").orderBy("o"))
    rows = rows.withColumn("rank", place - F.when(F.col("there").isNull(), 1).otherwise(0)).join(spelt, (F.col("stem") == F.col("of_stem")) & (F.col("ext") == F.col("of_ext")), "left")

    # the rank-th number from 2 on that isn't used: each used one at or below it moves it up
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("rank") + 1, lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    name = F.when(F.col("rank") == 0, F.col("want")).otherwise(F.concat("stem", F.lit(" ("), free.cast("string"), F.lit(")"), "ext"))
    return rows.select("row.*", (F.col("rank") + 1).alias("place"), name.alias("final_path")).drop("place")


def cross_batch(df: DataFrame, ledger: DataFrame, live: DataFrame) -> DataFrame:
    """Rows with a twin in the ledger: another path, same hash, and still there."""
    twins = ledger.select(F.col("audio_hash").alias("_hash"), F.col("file_path").alias("_twin"))
    twins = twins.join(live.select(F.col("path").alias("_twin")).distinct(), "_twin", "left_semi")
    hits = df.join(twins, (df["audio_hash"] == twins["_hash"]) & (df["file_path"] != twins["_twin"]))
    return hits.groupBy("file_path", "audio_hash").agg(F.min("_twin").alias("twin")).select("file_path", "twin", text.group_id("crossdupe_", F.col("audio_hash")).alias("group_id"))


def report(duplicates: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return duplicates.groupBy("group_id").agg(F.max("duplicate_type").alias("duplicate_type"), n("keep").alias("keep_count"), n("archive").alias("archive_count"), n("pending").alias("pending_count"))


def members(duplicates: DataFrame, archive: DataFrame) -> DataFrame:
    """Staged duplicates with what the catalogue knows of them; unknown files stay, with nulls."""
    known = archive.select("file_path", "codec", "bitrate", "size_bytes", F.col("status").alias("file_status"))
    return duplicates.join(known, "file_path", "left")


def ledger_members(ledger: DataFrame, archive: DataFrame) -> DataFrame:
    """Catalogue rows of each ledger hash, each once."""
    return ledger.select("audio_hash").distinct().join(archive.select("audio_hash", "file_path", "status"), "audio_hash").dropDuplicates(["audio_hash", "file_path"])


def near_pairs(df: DataFrame, threshold: float = V.NEAR_TITLE, excluded: DataFrame | None = None) -> DataFrame:
    """Pairs of files by one artist whose titles are nearly the same.

    Distinct titles of an artist are compared, not files, and only if their lengths
    allow the threshold; files come back by joins on the keys, so an artist with many
    files of few titles costs few comparisons.
    """
    rows = df.where((F.trim("artist") != "") & (F.trim("title") != ""))
    if excluded is not None:
        rows = rows.join(excluded.select("file_path").distinct(), "file_path", "left_anti")
    rows = rows.select("file_path", text.near_key(F.col("artist")).alias("artist_key"), text.near_key(F.col("title"), title=True).alias("title_key"), text.live(F.col("title")).alias("live"))
    keys = rows.select("artist_key", "title_key").distinct()
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, (F.col("a.artist_key") == F.col("b.artist_key")) & (F.col("a.title_key") <= F.col("b.title_key")))
    pairs = pairs.select("a.artist_key", F.col("a.title_key").alias("x"), F.col("b.title_key").alias("y"))
    pairs = pairs.withColumn("score", F.round(similarity.ratio_from(F.col("x"), F.col("y"), threshold), 4)).where(F.col("score") >= threshold)
    left = rows.select("artist_key", F.col("title_key").alias("x"), F.col("file_path").alias("p"), F.col("live").alias("p_live"))
    right = rows.select("artist_key", F.col("title_key").alias("y"), F.col("file_path").alias("q"), F.col("live").alias("q_live"))
    files = pairs.join(left, ["artist_key", "x"]).join(right, ["artist_key", "y"]).where(F.col("p") != F.col("q"))
    files = files.where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q"))).where(~(F.col("p_live") & F.col("q_live")))
    return files.select(text.pair_id(F.col("p"), F.col("q")).alias("group_id"), F.least("p", "q").alias("file_a"), F.greatest("p", "q").alias("file_b"), audio.confidence(F.col("score")).alias("confidence"))


def leader_clusters(df: DataFrame, block: str, order: str, key: str, threshold: float = V.FUZZY_DEFAULT) -> DataFrame:
    """Order-dependent leader clustering within each block.

    A string joins the first cluster whose leader it matches, else it leads a new one.
    The outcome depends on the order, so a block is folded in one row; blocks are
    expected to be small, as they hold distinct strings of one artist.
    """
    rows = df.groupBy(block).agg(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(key).alias("k")))).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        leader = F.coalesce(F.get(F.filter(acc, lambda c: (c["k"] == c["leader"]) & similarity.is_match(c["k"], r["k"], threshold)), F.lit(0))["leader"], r["k"])
        return F.concat(acc, F.array(F.struct(r["k"].alias("k"), leader.alias("leader"))))

    folded = F.aggregate("rows", F.array().cast("array<struct<k:string,leader:string>>"), step)
    return rows.select(block, F.explode(folded).alias("c")).select(block, F.col("c.k").alias(key), "c.leader")


def acoustic_pairs(df: DataFrame, least: float = V.ACOUSTIC_SCORE) -> DataFrame:
    """Every later file of a recording with the first one; the group id follows from the recording."""
    rows = df.where(F.col("recording").isNotNull() & (F.col("score") >= least))
    first = rows.groupBy("recording").agg(F.min("file_path").alias("first_path"))
    return rows.join(first, "recording").where("file_path <> first_path").select(F.concat(F.lit("acoustic_"), F.substring(F.sha2("recording", 256), 1, 12)).alias("group_id"), "first_path", "file_path")
