"""The catalogue pipeline: pure stages over tables, run in order, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions import probe, text
from catalith.operators import dml, dupes, health, lineage, names, reports, upkeep
from catalith.sources import files

Tables = dict[str, DataFrame]


@dataclass
class Output:
    """New states of tables, and rows to append to side tables."""

    tables: Tables = field(default_factory=dict)
    added: Tables = field(default_factory=dict)


Stage = Callable[[Tables], Output]


def _events(stage: str, changes: DataFrame) -> DataFrame:
    return changes.select(F.lit(stage).alias("stage"), F.concat(F.lit(stage + "_"), F.upper("field")).alias("event_type"), "file_path", "old_value", "new_value")


def _rewrite(stage: str, tables: Tables, values: dict) -> Output:
    before = tables["archive"]
    live = F.col("status") == "CATALOGUED"
    after = before.withColumns({c: F.when(live, F.coalesce(v, c)).otherwise(F.col(c)) for c, v in values.items()})
    return Output({"archive": after}, {"events": _events(stage, dml.changes(before, after, "file_path", list(values)))})


def normalise(tables: Tables) -> Output:
    return _rewrite("NORMALIZE", tables, {"artist": text.fixed_artist(F.col("artist")), "title": text.fixed_text(F.col("title")), "album": text.fixed_text(F.col("album"))})


def sanitise(tables: Tables) -> Output:
    return _rewrite("SANITIZE", tables, {c: F.when(text.needs_sanitising(F.col(c)), text.sanitised(F.col(c))) for c in ("artist", "album", "title", "genre")})


def consolidate(tables: Tables) -> Output:
    before = tables["archive"]
    after = dml.update_by_map(before, names.consolidated(before), "artist")
    return Output({"archive": after}, {"events": _events("CONSOLIDATE", dml.changes(before, after, "file_path", ["artist"]))})


def check_health(tables: Tables) -> Output:
    return Output({}, {"validation_issues": health.issue_rows(tables["archive"])})


def quarantine(tables: Tables) -> Output:
    """Corrupt files and junk leave the working population."""
    before = tables["archive"]
    bad = health.suspect_reason()
    junk = text.junk_reason(F.col("artist"), F.col("title"), F.col("album"))
    live = F.col("status") == "CATALOGUED"
    status = F.when(live & bad.isNotNull(), "QUARANTINED").when(live & junk.isNotNull(), "TRIBUTE_REVIEW").otherwise(F.col("status"))
    after = before.withColumn("status", status)
    return Output({"archive": after}, {"events": _events("QUARANTINE", dml.changes(before, after, "file_path", ["status"]))})


def resolve_duplicates(tables: Tables) -> Output:
    """Of each group the best file stays, the others go to review.

    Groups are the hash groups of the working population and the pending groups that
    other stages found (near, cross-batch, acoustic).  A lone member moves only where
    its twin is in an earlier batch.  A file that several groups would move is moved once.
    """
    before = tables["archive"]
    live = before.where("status = 'CATALOGUED'")
    exact = live.where("audio_hash is not null").withColumns({"group_id": text.group_id("dup_", F.col("audio_hash")), "duplicate_type": F.lit("EXACT"), "source_rank": F.lit(0)})
    members = exact
    if "duplicates" in tables and "group_id" in tables["duplicates"].columns:
        pending = tables["duplicates"].where("status = 'pending' and group_id is not null and duplicate_type <> 'EXACT'")
        pending = pending.select("file_path", "group_id", "duplicate_type").distinct().withColumn("source_rank", F.lit(1))
        members = exact.unionByName(live.join(pending, "file_path").select(*exact.columns))
    verdicts = dupes.keepers_and_losers(members, "group_id", F.col("duplicate_type") == "CROSS_BATCH").where("members > 1 or verdict = 'loser'")
    losers = dupes.claimed_once(verdicts.where("verdict = 'loser'")).select(F.col("file_path").alias("_loser"))
    marked = before.join(losers, before["file_path"] == losers["_loser"], "left")
    after = marked.withColumn("status", F.when(F.col("_loser").isNotNull(), "DUPE_REVIEW").otherwise(F.col("status"))).drop("_loser")
    groups = verdicts.select("group_id", "file_path", "duplicate_type", F.when(F.col("verdict") == "keeper", "keep").otherwise("archive").alias("status"))
    return Output({"archive": after}, {"duplicates": groups})


def enrich(tables: Tables) -> Output:
    before = tables["archive"]
    filled = names.majority_fill(before.where("status = 'CATALOGUED'")).select(F.col("file_path").alias("_path"), "new_value")
    joined = before.join(filled, before["file_path"] == filled["_path"], "left")
    after = joined.withColumn("genre", F.coalesce("new_value", "genre")).drop("_path", "new_value")
    return Output({"archive": after}, {"events": _events("ENRICH", dml.changes(before, after, "file_path", ["genre"]))})


def playlists(tables: Tables) -> Output:
    return Output({}, {"playlists": reports.playlist_lines(tables["archive"])})


def ingest(tables: Tables) -> Output:
    """Files of the listing that the catalogue doesn't have become PENDING rows."""
    before = tables["archive"]
    new = lineage.unknown(tables["listing"], before).select(F.col("path").alias("file_path"))
    facts = tables["listing"].groupBy(F.col("path").alias("file_path")).agg(F.max("size_bytes").alias("size_bytes"))
    rows = new.join(facts, "file_path").withColumns({"status": F.lit("PENDING"), "ext": text.extension(F.col("file_path"))})
    events = rows.select(F.lit("INGEST").alias("stage"), F.lit("INGEST").alias("event_type"), "file_path")
    return Output({"archive": before.unionByName(rows.select(*[c for c in rows.columns if c in before.columns]), allowMissingColumns=True)}, {"events": events})


def hash_files(tables: Tables) -> Output:
    """Pending files take their content hash; a file whose hash is known already is a duplicate."""
    before = tables["archive"]
    digests = tables["hashes"].select(F.col("path").alias("_path"), F.col("sha256").alias("_hash"))
    pending = (F.col("status") == "PENDING") | ((F.col("status") == "HASHED") & text.is_pending(F.col("audio_hash")))
    joined = before.join(digests, (before["file_path"] == digests["_path"]) & pending, "left")
    values = {"audio_hash": F.coalesce("_hash", before["audio_hash"]), "status": F.when(F.col("_hash").isNotNull(), "HASHED").otherwise(before["status"])}
    after = joined.withColumns(values).drop("_path", "_hash")
    first = dupes.first_seen(after, "audio_hash", "file_path")
    rows = first.select(F.col("copy_key").alias("file_path"), F.lit("EXACT").alias("duplicate_type"), F.lit("pending").alias("status"))
    return Output({"archive": after}, {"duplicates": rows})


def extract(tables: Tables) -> Output:
    """Hashed files take the metadata of their probe documents and become CATALOGUED."""
    before = tables["archive"]
    flat = probe.flattened(tables["probes"].select("file_path", "raw_json"))
    supplied = [c for c in flat.columns if c != "file_path" and c in before.columns]
    source = flat.join(before.where("status = 'HASHED'").select("file_path"), "file_path", "left_semi").withColumn("status", F.lit("CATALOGUED"))
    return Output({"archive": dml.upsert(before, source, "file_path", [*supplied, "status"])})


def cross_batch(tables: Tables) -> Output:
    live = tables["listing"].select("path")
    hits = dupes.cross_batch(tables["archive"].where("audio_hash is not null").select("file_path", "audio_hash"), tables["ledger"], live)
    return Output({}, {"duplicates": hits.select("group_id", "file_path", F.lit("CROSS_BATCH").alias("duplicate_type"), F.lit("pending").alias("status"))})


def near_duplicates(tables: Tables) -> Output:
    """Pairs of near titles; files of exact groups are left out."""
    known = tables.get("duplicates")
    excluded = known.where("duplicate_type = 'EXACT'") if known is not None else None
    pairs = dupes.near_pairs(tables["archive"].where("status = 'CATALOGUED'"), excluded=excluded)
    rows = pairs.select("group_id", F.explode(F.array("file_a", "file_b")).alias("file_path"), "confidence", F.lit("NEAR").alias("duplicate_type"), F.lit("pending").alias("status"))
    return Output({}, {"duplicates": rows})


def acoustic(tables: Tables) -> Output:
    pairs = dupes.acoustic_pairs(tables["recordings"])
    return Output({}, {"duplicates": pairs.select("group_id", "file_path", F.lit("ACOUSTIC").alias("duplicate_type"), F.lit("pending").alias("status"))})


def canonicalise(tables: Tables) -> Output:
    live = F.col("status") == "CATALOGUED"
    after = tables["archive"].withColumn("canon_action", F.when(live, health.canon_action()))
    return Output({"archive": after}, {"lossy": files.lossy_rows(after.where(live), tables.get("lossy", after.where("false")))})


def finalise(tables: Tables) -> Output:
    """Target paths without collisions, and ledger rows for what reaches them."""
    rows = tables["archive"].where("status = 'CATALOGUED'")
    target = F.concat(F.lit("/library/"), text.path_component(F.col("artist")), F.lit("/"), text.track_filename(F.col("artist"), F.col("title"), F.col("ext")))
    moves = dupes.with_collision_suffix(rows.withColumn("target", target), "target", "file_path").select("file_path", "audio_hash", F.col("final_path").alias("new_value"))
    ledger = moves.where("audio_hash is not null").select("audio_hash", F.col("new_value").alias("file_path"))
    events = moves.select(F.lit("FINALIZE").alias("stage"), F.lit("FINALIZE_MOVE").alias("event_type"), "file_path", F.col("file_path").alias("old_value"), "new_value")
    added = dml.delete_matching(ledger, tables["ledger"], ["audio_hash", "file_path"]) if "ledger" in tables else ledger
    return Output({}, {"ledger": added, "events": events})


def audit(tables: Tables) -> Output:
    rows = tables["archive"].where(~text.is_pending(F.col("finalized_at")))
    return Output({}, {"audit": lineage.reconcile(rows, tables["listing"], tables["ledger"])})


def bit_rot(tables: Tables) -> Output:
    return Output({}, {"bit_rot": lineage.baseline_diff(tables["baseline"], tables["hashes"])})


def loudness(tables: Tables) -> Output:
    return Output({}, {"loudness": health.loudness_window(tables["archive"])})


def sweep_ghosts(tables: Tables) -> Output:
    before = tables["archive"]
    gone = lineage.ghosts(before, tables["listing"]).select(F.col("file_path").alias("_gone"))
    joined = before.join(gone, before["file_path"] == gone["_gone"], "left")
    after = joined.withColumn("status", F.when(F.col("_gone").isNotNull(), "GHOST").otherwise(F.col("status"))).drop("_gone")
    return Output({"archive": after}, {"events": _events("GHOST", dml.changes(before, after, "file_path", ["status"]))})


def various_artists(tables: Tables) -> Output:
    """Compilation credits give way to the artist that the file name tells."""
    found = text.real_artist(F.col("file_path"))["artist"]
    return _rewrite("VARIOUS_ARTISTS", tables, {"artist": F.when(text.is_various(F.col("artist")) & (found != ""), found)})


def export_plan(tables: Tables) -> Output:
    rows = tables["archive"].where("status = 'CATALOGUED'")
    columns = [F.col(c) for c in ("artist", "album", "track", "title", "file_path", "ext")]
    return Output({}, {"export": rows.select("file_path", text.export_path(*columns).alias("target"))})


def review(tables: Tables) -> Output:
    """Findings of a reviewer's replies on files that have none yet."""
    found = probe.valid_findings(tables["replies"])
    if "review_issues" in tables:
        found = dml.delete_matching(found, tables["review_issues"], ["file_path"])
    return Output({}, {"review_issues": found})


def needing(*names: str) -> Callable[[Stage], Stage]:
    """A stage that does nothing where a table it works from isn't there, as an outside service may be away."""

    def wrap(stage: Stage) -> Stage:
        return lambda tables: stage(tables) if all(n in tables for n in names) else Output()

    return wrap


def preflight(tables: Tables) -> Output:
    free = F.lit(tables["room"].first()["free_gb"]) if "room" in tables else F.lit(float("inf"))
    return Output({}, {"preflight": upkeep.preflight(tables["archive"], free)})


@needing("listing_modes")
def permissions(tables: Tables) -> Output:
    return Output({}, {"modes": upkeep.wrong_modes(tables["listing_modes"])})


@needing("listing")
def album_art(tables: Tables) -> Output:
    return Output({}, {"covers": upkeep.sidecars(tables["archive"].where(upkeep.LIVE), tables["listing"])})


@needing("tempos")
def tempo(tables: Tables) -> Output:
    """Measured tempos, and files with more than two channels marked as done for good."""
    rows = tables["archive"].join(tables["tempos"].groupBy("file_path").agg(F.max("tempo").alias("tempo")), "file_path", "left")
    rows = rows if "bpm_analyzed_at" in rows.columns else rows.withColumn("bpm_analyzed_at", F.lit(None).cast("string"))
    return Output({}, {"tempo": upkeep.analysis_state(rows, "bpm_analyzed_at").where("state != 'done'")})


def forge(tables: Tables) -> Output:
    """Files to measure, and files measured before whose tags are still to be written."""
    rows = tables["archive"] if "rg_tagged_at" in tables["archive"].columns else tables["archive"].withColumn("rg_tagged_at", F.lit(None).cast("string"))
    work = upkeep.to_measure(rows, "rg_tagged_at").select("file_path", F.lit("measure").alias("work"))
    if "tags" in tables and "lufs" in rows.columns:
        work = work.unionByName(upkeep.to_embed(rows, "rg_tagged_at", tables["tags"]).select("file_path", F.lit("embed").alias("work")))
    return Output({}, {"loudness_work": work})


@needing("tags")
def tag(tables: Tables) -> Output:
    return Output({}, {"tag_changes": upkeep.tag_changes(tables["archive"].where(upkeep.LIVE), tables["tags"])})


@needing("artists", "releases")
def look_up(tables: Tables) -> Output:
    rows = tables["archive"] if "mb_artist_id" in tables["archive"].columns else tables["archive"].withColumn("mb_artist_id", F.lit(None).cast("string"))
    return Output({}, {"music_ids": upkeep.with_answers(rows, tables["artists"], tables["releases"])})


@needing("listing")
def transcode(tables: Tables) -> Output:
    return Output({}, {"transcodes": upkeep.transcodes(tables["archive"], tables["listing"])})


@needing("decoded")
def check_integrity(tables: Tables) -> Output:
    return Output({}, {"integrity": upkeep.integrity(tables["archive"], tables["decoded"])})


def organise(tables: Tables) -> Output:
    plan = upkeep.organised(tables["archive"].where(upkeep.LIVE)).where("verdict <> 'skip'")
    events = plan.select(F.lit("ORGANIZE").alias("stage"), F.concat(F.lit("ORGANIZE_"), F.upper("verdict")).alias("event_type"), "file_path", F.col("file_path").alias("old_value"), F.col("target").alias("new_value"))
    return Output({}, {"organised": plan, "events": events})


DEFAULT: list[tuple[str, Stage]] = [
    ("health", check_health),
    ("quarantine", quarantine),
    ("normalise", normalise),
    ("sanitise", sanitise),
    ("consolidate", consolidate),
    ("resolve_duplicates", resolve_duplicates),
    ("enrich", enrich),
    ("playlists", playlists),
]

#: From a listing to a finalised catalogue; needs listing, hashes, probes and ledger beside the archive.
FULL: list[tuple[str, Stage]] = [
    ("ingest", ingest),
    ("hash_files", hash_files),
    ("extract", extract),
    ("health", check_health),
    ("quarantine", quarantine),
    ("various_artists", various_artists),
    ("normalise", normalise),
    ("sanitise", sanitise),
    ("consolidate", consolidate),
    ("cross_batch", cross_batch),
    ("near_duplicates", near_duplicates),
    ("resolve_duplicates", resolve_duplicates),
    ("canonicalise", canonicalise),
    ("enrich", enrich),
    ("finalise", finalise),
    ("playlists", playlists),
    ("export_plan", export_plan),
]

#: Checks of a finalised catalogue against storage, ledger and baseline.
MAINTAIN: list[tuple[str, Stage]] = [("audit", audit), ("bit_rot", bit_rot), ("loudness", loudness), ("sweep_ghosts", sweep_ghosts)]


#: Every stage by name.
STAGES: dict[str, Stage] = {
    **dict(DEFAULT), **dict(FULL), **dict(MAINTAIN),
    "preflight": preflight, "permissions": permissions, "album_art": album_art, "tempo": tempo, "forge": forge, "tag": tag, "look_up": look_up,
    "transcode": transcode, "integrity": check_integrity, "organise": organise, "acoustic": needing("recordings")(acoustic), "review": needing("replies")(review),
}


def order(names: str) -> list[tuple[str, Stage]]:
    return [(name, STAGES[name]) for name in names.split()]


_INTAKE = "preflight ingest permissions hash_files extract health quarantine album_art normalise sanitise consolidate various_artists"
_DEDUPE = "cross_batch near_duplicates resolve_duplicates"
_FINISH = "canonicalise finalise tempo forge tag audit"
_READ = "preflight ingest hash_files extract normalise sanitise"
_CARE = f"{_READ} sweep_ghosts health integrity enrich look_up near_duplicates acoustic album_art"

#: The long runs, each stage after those whose results it needs.
RUNS: dict[str, list[tuple[str, Stage]]] = {
    "canonical": order(f"{_INTAKE} {_DEDUPE} {_FINISH} enrich look_up"),
    "full": order(f"{_READ} forge tag"),
    "archive": order(f"{_CARE} tag review"),
    "everything": order(f"{_CARE} forge tag export_plan playlists review"),
    "maintain": order("preflight sweep_ghosts health normalise sanitise consolidate enrich look_up near_duplicates"),
    "enrich": order("enrich look_up acoustic review"),
    "overnight": order("sweep_ghosts health normalise enrich look_up near_duplicates review"),
}


def run(tables: Tables, stages: list[tuple[str, Stage]] = DEFAULT, save: Callable[[str, str, DataFrame], DataFrame] | None = None) -> tuple[Tables, dict[str, str]]:
    """Apply the stages; a stage that fails leaves the tables as they were and is reported.

    ``save(stage, table, df)`` writes a result and returns what later stages read, which
    cuts lineage between stages; without it the whole pipeline is one lazy plan, and
    a failure that only shows when rows are computed ends the run.
    """
    state, failed = dict(tables), {}
    keep = save or (lambda stage, name, df: df)
    for name, stage in stages:
        try:
            out = stage(state)
            new = {t: keep(name, t, df) for t, df in out.tables.items()}
            added = {t: keep(name, t, df) for t, df in out.added.items()}
        except Exception as error:  # reported below; the run goes on
            failed[name] = f"{type(error).__name__}: {error}"
            continue
        state |= new
        for t, df in added.items():
            state[t] = state[t].unionByName(df, allowMissingColumns=True) if t in state else df
    return state, failed
