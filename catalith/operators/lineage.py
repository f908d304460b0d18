"""Event logs, reconciliation of catalogue, storage and ledger, and path chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import text


def latest(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last event of each key, by one aggregate."""
    return events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("e")).select(key, F.col(f"e.{order}").alias(order), *[F.col(f"e.{c}").alias(c) for c in columns])


def resolve_chain(edges: DataFrame, hops: int = 10) -> DataFrame:
    """(start, final, hops) by following ``old -> new``, latest edge first, without cycles.

    One join for each hop over the paths still moving; it stops when none moves.
    """
    step = edges.groupBy("old").agg(F.max(F.struct("seq", "new")).alias("e")).select(F.col("old").alias("_old"), F.col("e.new").alias("_new"))
    state = step.select(F.col("_old").alias("start"), F.col("_old").alias("final"), F.lit(0).alias("hops"), F.array("_old").alias("seen"))
    for _ in range(hops):
        moves = F.col("_new").isNotNull() & ~F.array_contains("seen", F.col("_new"))
        state = state.join(step, F.col("final") == F.col("_old"), "left").select(
            "start", F.when(moves, F.col("_new")).otherwise(F.col("final")).alias("final"), (F.col("hops") + moves.cast("int")).alias("hops"), F.when(moves, F.concat("seen", F.array("_new"))).otherwise(F.col("seen")).alias("seen")
        )
    return state.select("start", "final", "hops")


def kept_path(note: Column) -> Column:
    kept = F.trim(F.regexp_extract(note, r"kept=(.*)$", 1))
    return F.when((kept != "") & ~kept.startswith("("), kept)


def reconcile(catalogue: DataFrame, storage: DataFrame, ledger: DataFrame) -> DataFrame:
    """Verdict for each path: missing on disk, unknown to the catalogue, not in the ledger, or ok."""
    c = catalogue.select(F.col("file_path").alias("path"), "audio_hash").withColumn("in_catalogue", F.lit(True))
    s = storage.select("path").distinct().withColumn("on_disk", F.lit(True))
    both = c.join(s, "path", "full_outer")
    noted = ledger.select("audio_hash").distinct().withColumn("noted", F.lit(True))
    both = both.join(noted, "audio_hash", "left")
    verdict = F.when(F.col("on_disk").isNull(), "missing_on_disk").when(F.col("in_catalogue").isNull(), "untracked").when(F.col("noted").isNull(), "not_in_ledger").otherwise("ok")
    return both.select("path", verdict.alias("verdict"))


def baseline_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b = baseline.select("path", F.col("sha256").alias("was"))
    c = current.select("path", F.col("sha256").alias("now"))
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "ok").otherwise("corrupt")
    return b.join(c, "path", "full_outer").select("path", verdict.alias("verdict"))


def ledger_repair(ledger: DataFrame, archive: DataFrame) -> DataFrame:
    """Keep, repoint or prune each ledger row: a live path of the hash decides, catalogued first."""
    live = archive.where(F.col("audio_hash").isNotNull() & ~F.coalesce(F.col("status"), F.lit("")).isin("GHOST"))
    best = live.groupBy("audio_hash").agg(F.min(F.struct((F.coalesce("status", F.lit("")) != "CATALOGUED").alias("o"), "file_path")).alias("b")).select("audio_hash", F.col("b.file_path").alias("live_path"))
    alive = live.select("audio_hash", "file_path").distinct().withColumn("there", F.lit(True))
    rows = ledger.join(alive, ["audio_hash", "file_path"], "left").join(best, "audio_hash", "left")
    action = F.when(F.col("there"), "keep").when(F.col("live_path").isNotNull(), "repoint").otherwise("prune")
    return rows.select("audio_hash", "file_path", action.alias("action"), F.when(action == "repoint", F.col("live_path")).alias("new_path"))


def ghosts(archive: DataFrame, storage: DataFrame) -> DataFrame:
    return archive.where(F.coalesce("status", F.lit("")) != "GHOST").join(storage.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")


def dead_groups(archive: DataFrame, storage: DataFrame) -> DataFrame:
    """Hashes of which no member is on disk."""
    there = storage.select(F.col("path").alias("file_path")).distinct().withColumn("there", F.lit(True))
    rows = archive.where(F.col("audio_hash").isNotNull()).join(there, "file_path", "left")
    return rows.groupBy("audio_hash").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("live"), F.count("*").alias("members")).where("not live").select("audio_hash", "members")


def unknown(listing: DataFrame, archive: DataFrame) -> DataFrame:
    """Files on disk that the catalogue doesn't have."""
    return listing.select("path").distinct().join(archive.select(F.col("file_path").alias("path")), "path", "left_anti")


def twins(library: DataFrame, tier: DataFrame, library_root: str, tier_root: str) -> DataFrame:
    """Library and archive-tier files with the same relative path."""
    rel = lambda c, root: F.substring(F.col(c), len(root) + 2, 100_000)
    a = library.where(F.col("file_path").startswith(library_root + "/")).select("file_path", rel("file_path", library_root).alias("rel"))
    b = tier.where(F.col("path").startswith(tier_root + "/")).select(F.col("path").alias("tier_path"), rel("path", tier_root).alias("rel"))
    return a.join(b, "rel").select("file_path", "tier_path")


def slow_transfers(rows: DataFrame, part: str, order: str, value: str, window: int = 5, share: float = 0.4) -> DataFrame:
    """Rows below a share of the mean of the rows before, once there are enough of them."""
    before = Window.partitionBy(part).orderBy(order).rowsBetween(-window, -1)
    return rows.withColumns({"mean": F.avg(value).over(before), "n": F.count(value).over(before)}).withColumn("slow", (F.col("n") >= window) & (F.col(value) < share * F.col("mean"))).drop("n")


def history(events: DataFrame, path: str) -> DataFrame:
    return events.where(F.col("file_path") == path).orderBy("seq")


def library_path(path: Column, segment: str) -> Column:
    return text.without_segment(path, segment)
