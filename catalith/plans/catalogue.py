"""Registry of the catalogue queries: each applies an operator to whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import audio, probe, similarity, text
from catalith.operators import dml, dupes, health, lineage, lookups, names, reports, upkeep
from catalith.plans.archive import archive
from catalith.sources import files
from catalith.streaming import windows

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- health and reports -------------------------------------------------------


@query
def health_issue_rows(spark, sf_dir):
    return health.issue_rows(archive(spark, sf_dir))


@query
def health_issue_breakdown(spark, sf_dir):
    return health.breakdown(health.issue_rows(archive(spark, sf_dir)))


@query
def health_top_files(spark, sf_dir):
    return health.top_files(health.issue_rows(archive(spark, sf_dir)))


@query
def status_counters(spark, sf_dir):
    return reports.status_counters(archive(spark, sf_dir))


@query
def report_rollup(spark, sf_dir):
    return reports.breakdown(archive(spark, sf_dir))


@query
def bitrate_bands(spark, sf_dir):
    return reports.bitrate_bands(archive(spark, sf_dir))


@query
def upgrade_candidates(spark, sf_dir):
    return reports.upgrades(archive(spark, sf_dir))


@query
def spec_outliers(spark, sf_dir):
    return reports.outliers(archive(spark, sf_dir))


@query
def genre_counts(spark, sf_dir):
    return reports.genre_counts(archive(spark, sf_dir))


@query
def playlist_lines(spark, sf_dir):
    return reports.playlist_lines(archive(spark, sf_dir))


@query
def review_summary(spark, sf_dir):
    """Orders stand in for review issues: priority as type, price as confidence."""
    issues = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("issue_type"), (F.col("o_orderkey") % 100 / 100.0).cast("double").alias("confidence"))
    return reports.review_summary(issues)


@query
def run_stage_counters(spark, sf_dir):
    """Events stand in for stage records."""
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "changed").otherwise("skipped")
    return reports.run_stages(read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("stage"), outcome.alias("outcome")))


# -- flags --------------------------------------------------------------------


@query
def corrupt_flags(spark, sf_dir):
    return health.corrupt(archive(spark, sf_dir))


@query
def loudness_window(spark, sf_dir):
    return health.loudness_window(archive(spark, sf_dir))


@query
def canon_action(spark, sf_dir):
    return archive(spark, sf_dir).groupBy(health.canon_action().alias("action")).agg(F.count("*").alias("files"))


@query
def junk_classify(spark, sf_dir):
    return health.junk(archive(spark, sf_dir))


@query
def various_detect(spark, sf_dir):
    return archive(spark, sf_dir).where(text.is_various(F.col("artist"))).select("file_path", "artist")


@query
def bracket_extract(spark, sf_dir):
    """Artists from made-up file names in the three forms that the rules know."""
    rows = archive(spark, sf_dir).where(F.trim("artist") != "")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Various Artists - "), "artist", F.lit(" - Song.m4a"))).when(F.col("id") % 3 == 1, F.concat(F.lit("Song ["), "artist", F.lit("-Label].m4a"))).otherwise(F.concat("artist", F.lit(".m4a")))
    rows = rows.select("id", F.translate(name, "/", "_").alias("name"))
    return rows.select("id", text.real_artist(F.col("name")).alias("r")).select("id", F.col("r.artist").alias("artist"), F.col("r.strategy").alias("strategy"))


# -- texts --------------------------------------------------------------------


def _text(name: str, column: str, f) -> None:
    def run(spark, sf_dir):
        rows = archive(spark, sf_dir).where(F.col(column).isNotNull())
        return rows.select("id", f(F.col(column)).alias("value"))

    run.__name__ = name
    query(run)


_text("article_suffix", "artist", text.article_to_suffix)
_text("title_case", "title", text.title_case)
_text("sanitize_value", "title", text.sanitised)
_text("path_component", "title", text.path_component)
_text("strip_track_no", "title", text.without_track_number)
_text("near_normalise", "title", lambda x: text.near_key(x, title=True))
_text("fuzzy_normalise", "artist", text.fuzzy_key)
_text("consolidate_key", "artist", text.consolidation_key)
_text("lookup_form", "artist", text.natural_form)
_text("primary_artist", "artist", text.primary_artist)
_text("display_title", "artist", text.display_title)


@query
def normalised_fields(spark, sf_dir):
    """Event rows of the normalisation stage: what changes, from what to what."""
    before = archive(spark, sf_dir).where("status = 'CATALOGUED'").select("id", "artist", "title", "album")
    fixed = {"artist": F.coalesce(text.fixed_artist(F.col("artist")), "artist"), "title": F.coalesce(text.fixed_text(F.col("title")), "title"), "album": F.coalesce(text.fixed_text(F.col("album")), "album")}
    new = before.select("*", *[v.alias(f"new_{c}") for c, v in fixed.items()])
    fields = [F.when(F.col(f"new_{c}") != F.col(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("old_value"), F.col(f"new_{c}").alias("new_value"))) for c in fixed]
    return new.select("id", F.explode(F.filter(F.array(*fields), lambda x: x.isNotNull())).alias("e")).select("id", "e.*")


@query
def track_filename(spark, sf_dir):
    return archive(spark, sf_dir).select("id", text.track_filename(F.col("artist"), F.col("title"), F.col("ext")).alias("value"))


@query
def export_paths(spark, sf_dir):
    return archive(spark, sf_dir).select("id", text.export_path(*[F.col(c) for c in ("artist", "album", "track", "title", "file_path", "ext")]).alias("value"))


@query
def fuzzy_ratio(spark, sf_dir):
    """Each distinct part name against the next one in order."""
    return _neighbours(spark, sf_dir, similarity.ratio)


@query
def fuzzy_token(spark, sf_dir):
    return _neighbours(spark, sf_dir, similarity.token_ratio)


def _neighbours(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    names_of = read(spark, sf_dir, "part").select("p_name").distinct()
    a, b = names_of.alias("a"), names_of.alias("b")
    pairs = a.join(b, (F.split_part("a.p_name", F.lit(" "), F.lit(1)) == F.split_part("b.p_name", F.lit(" "), F.lit(1))) & (F.col("a.p_name") < F.col("b.p_name"))).select(F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y"))
    return pairs.select("x", "y", F.round(f(F.col("x"), F.col("y")), 4).alias("score"))


@query
def audio_arithmetic(spark, sf_dir):
    lufs, peak = F.col("lufs"), F.col("lufs_tp")
    return archive(spark, sf_dir).select(
        "id",
        audio.gain(lufs).alias("gain"),
        F.round(audio.linear_peak(peak), 6).alias("peak"),
        audio.q78(audio.gain(lufs)).alias("q78"),
        audio.loudness_state(lufs * 3).alias("state"),
        audio.hash_timeout(F.col("duration"), F.col("sample_rate")).alias("hash_timeout"),
        audio.kbps(F.col("bitrate")).alias("kbps"),
        text.human_size(F.col("size_bytes")).alias("size"),
    )


@query
def path_status(spark, sf_dir):
    return archive(spark, sf_dir).select("id", text.status_of_path(F.col("file_path"), "/vault/lib").alias("path_status"), lineage.library_path(F.col("file_path"), "DUPES_MOVED_FOR_REVIEW").alias("library_path"))


@query
def probe_flatten(spark, sf_dir):
    """Probe documents made of the archive's own values."""
    rows = archive(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    doc = F.struct(
        F.struct(s("duration").alias("duration"), s("bitrate").alias("bit_rate"), F.create_map(F.lit("TITLE"), "title", F.lit("date"), F.concat("year", F.lit("-05-01")), F.lit("Track"), F.concat(s("track"), F.lit("/20"))).alias("tags")).alias("format"),
        F.array(
            F.struct(F.lit("video").alias("codec_type"), F.lit("mjpeg").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("string").alias("channels"), F.create_map(F.lit("x"), F.lit("y")).alias("tags")),
            F.struct(F.lit("audio").alias("codec_type"), F.col("codec").alias("codec_name"), s("sample_rate").alias("sample_rate"), s("channels").alias("channels"), F.create_map(F.lit("title"), F.lit("stream title"), F.lit("ARTIST"), F.col("artist")).alias("tags")),
        ).alias("streams"),
    )
    flat = probe.flattened(rows.select("id", F.to_json(doc).alias("raw_json")))
    return flat.select("id", "title", "artist", "year", "track", "duration", "bitrate", "sample_rate", "channels", "codec")


# -- duplicates ---------------------------------------------------------------


@query
def exact_dupe_groups(spark, sf_dir):
    return dupes.exact_groups(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query
def first_seen_pairs(spark, sf_dir):
    return dupes.first_seen(read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query
def keeper_ranking(spark, sf_dir):
    rows = archive(spark, sf_dir).where("audio_hash is not null")
    return dupes.keepers_and_losers(rows, "audio_hash", F.col("status") == "HASHED").select("file_path", "audio_hash", F.col("place").cast("long").alias("place"), "members", "verdict")


@query
def orphan_group_winner(spark, sf_dir):
    return dupes.orphan_winner(archive(spark, sf_dir)).select("audio_hash", "file_path")


@query
def sole_copies(spark, sf_dir):
    return dupes.sole_copies(archive(spark, sf_dir))


@query
def claim_resolution(spark, sf_dir):
    """Losers of two groupings, by hash and by title; each file is claimed once."""
    rows = archive(spark, sf_dir).where("status = 'CATALOGUED'")
    by_hash = dupes.keepers_and_losers(rows.where("audio_hash is not null").withColumn("group_id", text.group_id("dup_", F.col("audio_hash"))), "group_id").withColumn("source_rank", F.lit(0))
    by_title = dupes.keepers_and_losers(rows.where("title <> ''").withColumn("group_id", F.concat(F.lit("t_"), F.lower("title"))), "group_id").withColumn("source_rank", F.lit(1))
    losers = by_hash.unionByName(by_title).where("verdict = 'loser'").select("file_path", "group_id", "source_rank")
    return dupes.claimed_once(losers)


@query
def collision_suffix(spark, sf_dir):
    """Few names for many files, some of which spell a number out, and some paths that are taken."""
    id_ = F.col("id")
    name = F.concat(F.lit("/out/track "), (id_ % 40).cast("string"), F.when(id_ % 7 == 0, " (2)").when(id_ % 11 == 0, " (4)").otherwise(""), F.when(id_ % 40 < 35, F.col("ext")).otherwise(""))
    rows = archive(spark, sf_dir).select("id", name.alias("target"))
    taken = rows.where("id % 13 = 0").select(F.regexp_replace("target", "track ([0-9])( |[.]|$)", "track $1 (3)$2").alias("path"))
    return dupes.with_collision_suffix(rows, "target", "id", taken).select("id", "final_path")


@query
def cross_batch_flag(spark, sf_dir):
    """Ledger: every third file under its old path; live: the even ones."""
    rows = archive(spark, sf_dir)
    old = F.concat(F.lit("/old"), "file_path")
    ledger = rows.where("id % 3 = 0 and audio_hash is not null").select("audio_hash", old.alias("file_path"))
    live = rows.where("id % 2 = 0").select(old.alias("path"))
    return dupes.cross_batch(rows.where("audio_hash is not null").select("file_path", "audio_hash"), ledger, live)


@query
def dedupe_report(spark, sf_dir):
    """Orders stand in for duplicate rows: customers as groups, status letters as states."""
    status = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "archive").otherwise("pending")
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("group_id"), F.col("o_orderpriority").alias("duplicate_type"), status.alias("status"))
    return dupes.report(rows)


@query
def near_dupe_pairs(spark, sf_dir):
    return dupes.near_pairs(archive(spark, sf_dir).where("status = 'CATALOGUED'"))


@query
def acoustic_pairs(spark, sf_dir):
    rows = archive(spark, sf_dir).select("file_path", F.when(F.col("id") % 5 != 0, F.concat(F.lit("rec"), (F.col("id") % 97).cast("string"))).alias("recording"), (F.col("id") % 10 / 10.0).cast("double").alias("score"))
    return dupes.acoustic_pairs(rows)


@query
def duplicate_members(spark, sf_dir):
    rows = archive(spark, sf_dir)
    path = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise("/gone")
    staged = rows.where("audio_hash is not null and id % 3 = 0").select(text.group_id("dup_", F.col("audio_hash")).alias("group_id"), path.alias("file_path"))
    return dupes.members(staged, rows).select("group_id", "file_path", "codec", "bitrate", "file_status")


@query
def ledger_members(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return dupes.ledger_members(rows.where("id % 5 = 0 and audio_hash is not null").select("audio_hash"), rows)


@query
def leader_clusters(spark, sf_dir):
    """Part names in blocks of their first word, in order of name."""
    rows = read(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("block"), F.col("p_name").alias("name"), F.col("p_name").alias("place"))
    return dupes.leader_clusters(rows, "block", "place", "name", 70)


# -- names --------------------------------------------------------------------

CANON = (("the beatles", "The Beatles"), ("kinks", "Kinks, The"), ("pink floid", "Pink Floyd"), ("sigur ros", "Sigur Rós"), ("abba", ""), ("neil yuong", "Neil Young"))
GENRES = ("Rock", "Jazz", "Hip-Hop", "Electronic", "Folk")
GENRE_MAP = (("hip-hop/rap", "Hip-Hop"), ("jazz, fusion", "Jazz"))


@query
def canon_artist(spark, sf_dir):
    return names.canon_artists(archive(spark, sf_dir), spark.createDataFrame(list(CANON), "raw string, canonical string"))


@query
def canon_genre(spark, sf_dir):
    return names.canon_genres(archive(spark, sf_dir), spark.createDataFrame([(g,) for g in GENRES], "genre string"), spark.createDataFrame(list(GENRE_MAP), "raw string, canonical string"))


@query
def consolidate_artists(spark, sf_dir):
    return names.consolidated(archive(spark, sf_dir))


@query
def genre_majority_fill(spark, sf_dir):
    return names.majority_fill(archive(spark, sf_dir))


@query
def album_variants(spark, sf_dir):
    """The brand in the path stands in for the artist, so that spellings meet."""
    return names.album_variants(archive(spark, sf_dir).withColumn("artist", F.regexp_extract("file_path", r"(Brand#[0-9]+)", 1)))


@query
def first_match(spark, sf_dir):
    rows = archive(spark, sf_dir)
    found = names.first_match(rows.where("id % 2 = 0").select("id", "artist", "title"), rows.where("id % 2 = 1").select("artist", "title", F.col("file_path").alias("path")))
    return found.select("id", "match")


# -- table changes ------------------------------------------------------------


@query
def partial_upsert(spark, sf_dir):
    rows = archive(spark, sf_dir).select("file_path", "status", "artist", "year")
    fresh = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.concat(F.lit("/new"), "file_path"))
    source = archive(spark, sf_dir).where("id % 4 < 2").select(fresh.alias("file_path"), F.lit("HASHED").alias("status"), F.lit(None).cast("string").alias("artist"))
    return dml.upsert(rows, source, "file_path", ["status", "artist"])


@query
def insert_ignore(spark, sf_dir):
    rows = archive(spark, sf_dir).where("audio_hash is not null")
    return dml.insert_ignore(rows.where("id % 2 = 0").select("audio_hash", "file_path"), rows.select("audio_hash", "file_path"), ["audio_hash", "file_path"])


@query
def update_by_map(spark, sf_dir):
    mapping = spark.createDataFrame([("Beatles", "Beatles, The"), ("abba", "ABBA")], "old string, new string")
    return dml.update_by_map(archive(spark, sf_dir).select("id", "artist", "status"), mapping, "artist")


@query
def soft_reset(spark, sf_dir):
    return dml.soft_reset(archive(spark, sf_dir).where("status = 'CATALOGUED'").select("id", "status", "audio_hash", "finalized_at"), ("audio_hash", "finalized_at"))


@query
def delete_stale(spark, sf_dir):
    rows = archive(spark, sf_dir).select("file_path", "status")
    return dml.delete_matching(rows, rows.where("status in ('GHOST', 'QUARANTINED')"), ["file_path"])


@query
def review_apply(spark, sf_dir):
    rows = archive(spark, sf_dir).select("file_path", "artist", "title", "album", "genre", "year", "status")
    return dml.apply_review(rows, _sheet(spark, sf_dir))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("id") % 3 == 0, "artist").when(F.col("id") % 3 == 1, "genre").otherwise("status")
    approve = F.when(F.col("id") % 4 == 0, "yes").when(F.col("id") % 4 == 1, "NO").otherwise("")
    return archive(spark, sf_dir).where("id % 2 = 0 or id % 4 = 1").select("file_path", field.alias("field_name"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("new_value"), approve.alias("approve"))


@query
def review_counts(spark, sf_dir):
    return dml.review_counts(_sheet(spark, sf_dir))


# -- lineage and reconciliation -----------------------------------------------


@query
def runs_recent(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").orderBy(F.desc("event_id")).limit(20)


@query
def event_latest_per_key(spark, sf_dir):
    return lineage.latest(read(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"])


@query
def event_chain_resolve(spark, sf_dir):
    n = lambda x: F.concat(F.lit("n"), x.cast("string"))
    edges = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), n(F.col("event_id") % 1000).alias("old"), n((F.col("event_id") * 7 + 3) % 1500).alias("new"))
    return lineage.resolve_chain(edges)


@query
def kept_paths(spark, sf_dir):
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("moved kept=/a/"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.lit("kept=(no keeper on record)")).otherwise(F.lit("plain"))
    return read(spark, sf_dir, "events").select("event_id", lineage.kept_path(note).alias("kept")).where("kept is not null")


def _storage(rows: DataFrame) -> DataFrame:
    path = F.when(F.col("id") % 10 == 0, F.concat(F.lit("/stray"), "file_path")).otherwise(F.col("file_path"))
    return rows.where("id % 7 <> 0").select(path.alias("path"))


@query
def audit_reconcile(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return lineage.reconcile(rows.where("finalized_at <> ''"), _storage(rows), rows.where("id % 3 <> 0 and audio_hash is not null").select("audio_hash"))


@query
def bitrot_diff(spark, sf_dir):
    rows = archive(spark, sf_dir).where("audio_hash is not null")
    now = F.when(F.col("id") % 11 == 0, F.lit("changed")).otherwise(F.col("audio_hash"))
    return lineage.baseline_diff(rows.where("id % 5 <> 0").select(F.col("file_path").alias("path"), F.col("audio_hash").alias("sha256")), rows.where("id % 7 <> 0").select(F.col("file_path").alias("path"), now.alias("sha256")))


@query
def ledger_repair(spark, sf_dir):
    rows = archive(spark, sf_dir)
    moved = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.concat(F.lit("/old"), "file_path"))
    return lineage.ledger_repair(rows.where("audio_hash is not null").select("audio_hash", moved.alias("file_path")), rows.where("id % 3 <> 0"))


@query
def ghost_sweep(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return lineage.ghosts(rows, _storage(rows)).select("file_path")


@query
def dead_groups(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return lineage.dead_groups(rows, _storage(rows))


@query
def unknown_files(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return lineage.unknown(_storage(rows), rows)


@query
def archive_by_status(spark, sf_dir):
    return archive(spark, sf_dir).where("status = 'CATALOGUED'").select("id", "artist", "album", "title").orderBy("artist", "album", "title", "id")


@query
def path_prefix(spark, sf_dir):
    return archive(spark, sf_dir).where(text.starts_with(F.col("file_path"), "/VAULT/lib/Brand#1")).select("file_path")


@query
def analysable_files(spark, sf_dir):
    return reports.analysable(archive(spark, sf_dir)).select("file_path", text.human_duration(F.col("duration") * 30).alias("length"))


@query
def report_lines(spark, sf_dir):
    return reports.report_lines(health.breakdown(health.issue_rows(archive(spark, sf_dir))), "severity", "issue", "cnt")


@query
def lossy_rows(spark, sf_dir):
    rows = archive(spark, sf_dir)
    return files.lossy_rows(rows, rows.where("id % 4 = 0"))


@query
def restore_commands(spark, sf_dir):
    return files.restore_commands(archive(spark, sf_dir).where("title <> ''").select(F.col("title").alias("source"), F.col("file_path").alias("destination")))


@query
def looked_up(spark, sf_dir):
    """Answers by brand, of which only good ones count."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string"))
    answers = read(spark, sf_dir, "supplier").select(brand.alias("brand"), F.col("s_name").alias("answer"), (F.col("s_suppkey") % 10 / 10.0).cast("double").alias("score"))
    return lookups.answered(part, lookups.accepted(answers, "score", 0.5).select("brand", "answer"), "brand")


@query
def twin_join(spark, sf_dir):
    rows = archive(spark, sf_dir)
    tier = rows.where("id % 2 = 0").select(F.regexp_replace("file_path", "^/vault/lib", "/tier").alias("path"))
    return lineage.twins(rows, tier, "/vault/lib", "/tier")


@query
def rolling_speed_flag(spark, sf_dir):
    rows = lineage.slow_transfers(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return rows.select("event_id", F.round("mean", 6).alias("mean"), "slow")


# -- additions on the events table ----------------------------------------------


@query
def tumbling_counts(spark, sf_dir):
    return windows.tumbling(read(spark, sf_dir, "events"), "1 hour")


@query
def sliding_counts(spark, sf_dir):
    return windows.sliding(read(spark, sf_dir, "events"), "2 hours", "1 hour")


@query
def session_counts(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "user_id", "30 minutes")


# -- work on the files --------------------------------------------------------


@query
def organise_plan(spark, sf_dir):
    """Files in their place, in the right folder under another name, and elsewhere."""
    n = lambda letter, m: F.concat(F.lit(letter), (F.col("id") % m).cast("string"))
    rows = archive(spark, sf_dir).select("id", n("A", 5).alias("artist"), n("B", 3).alias("album"), n("t", 20).alias("title"), F.lit(".m4a").alias("ext"))
    folder = F.concat(F.lit("/library/"), "artist", F.lit("/"), "album", F.lit("/"))
    there = F.concat(folder, "artist", F.lit(" - "), "title", "ext")
    path = F.when((F.col("id") < 60) & (F.col("id") % 4 == 0), there).when(F.col("id") % 4 == 1, F.concat(folder, n("w", 10**9))).otherwise(n("/in/", 10**9))
    return upkeep.organised(rows.withColumn("file_path", path))


@query
def tag_diff(spark, sf_dir):
    a = archive(spark, sf_dir)
    odd = lambda c, m: F.when(F.col("id") % m == 0, F.lit(None).cast("string")).otherwise(F.col(c).cast("string")).alias(c)
    tags = a.select("file_path", F.concat("artist", F.lit(" ")).alias("artist"), odd("album", 3), odd("title", 4), odd("genre", 5), odd("year", 6), odd("track", 7), F.when(F.col("id") % 2 == 0, "The Chieftains").alias("albumartist"))
    return upkeep.tag_changes(a.withColumn("artist", F.when(F.col("id") % 8 == 0, "Chieftains, The").otherwise(F.col("artist"))), tags)


@query
def loudness_pending(spark, sf_dir):
    return upkeep.to_measure(archive(spark, sf_dir), "finalized_at").select("id", "file_path")


@query
def loudness_embeds(spark, sf_dir):
    a = archive(spark, sf_dir)
    return upkeep.to_embed(a, "finalized_at", a.where("id % 3 = 0")).select("id", "file_path")


@query
def wrong_modes(spark, sf_dir):
    listing = archive(spark, sf_dir).select(F.col("file_path").alias("path"), F.when(F.col("id") % 4 == 0, "dir").when(F.col("id") % 9 == 0, "link").otherwise("file").alias("kind"), F.when(F.col("id") % 3 == 0, 0o775).when(F.col("id") % 5 == 0, None).otherwise(0o664).alias("mode"))
    return upkeep.wrong_modes(listing)


@query
def analysis_state(spark, sf_dir):
    return upkeep.analysis_state(archive(spark, sf_dir).withColumn("tempo", (F.col("id") % 260).cast("double")), "finalized_at")


@query
def sidecar_covers(spark, sf_dir):
    a = archive(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(n) for n in ("front.png", "notes.txt", "cover.png", "AlbumArtSmall.jpg", "folder.jpg")]), (F.col("id") % 5 + 1).cast("int"))
    listing = a.where("id % 7 = 0").select(F.concat(F.regexp_replace("file_path", "/[^/]*$", "/"), name).alias("path"))
    return upkeep.sidecars(a.select("file_path"), listing)


@query
def transcode_plan(spark, sf_dir):
    a = archive(spark, sf_dir)
    return upkeep.transcodes(a, a.where("id % 5 <> 3").select(F.col("file_path").alias("path")))


@query
def release_lookups(spark, sf_dir):
    a = archive(spark, sf_dir).withColumn("mb_artist_id", F.when(F.col("id") % 6 == 0, "known"))
    artists = a.where("id % 4 = 0").select(F.upper("artist").alias("artist"), F.concat(F.lit("a"), F.length("artist").cast("string")).alias("mb_artist_id"))
    releases = a.where("id % 5 = 0").select("artist", "album", F.concat(F.lit("r"), F.length("album").cast("string")).alias("mb_release_id"))
    return upkeep.with_answers(a, artists, releases)


@query
def preflight_checks(spark, sf_dir):
    return upkeep.preflight(archive(spark, sf_dir), F.lit(70))


@query
def integrity_flags(spark, sf_dir):
    a = archive(spark, sf_dir)
    tries = a.where("id % 3 > 0").select("file_path", (F.col("id") % 4 == 1).alias("ok"), F.lit(1).alias("ts")).unionByName(a.where("id % 6 = 1").select("file_path", F.lit(True).alias("ok"), F.lit(2).alias("ts")))
    return upkeep.integrity(a, tries)


@query
def rebuilt_rows(spark, sf_dir):
    a = archive(spark, sf_dir)
    listing, hashes = a.select(F.col("file_path").alias("path"), "size_bytes"), a.where("id % 4 > 0").select(F.col("file_path").alias("path"), F.coalesce("audio_hash", F.lit("none")).alias("sha256"))
    return upkeep.rebuilt(listing, hashes, a.where("id % 3 > 0").select("file_path", "title", "artist"), limit=500).select("file_path", "size_bytes", "audio_hash", "title", "artist", "status")


@query
def canon_review(spark, sf_dir):
    counts = archive(spark, sf_dir).where("trim(artist) <> ''").groupBy(F.col("artist").alias("raw")).agg(F.count("*").alias("n"))
    return upkeep.canon_review(counts.withColumn("source", F.when(F.length("raw") % 3 == 0, "exact").otherwise("none")))


@query
def ledger_readd(spark, sf_dir):
    a = archive(spark, sf_dir)
    return upkeep.readded(a.where("id % 2 = 0").select("audio_hash", "file_path"), a)


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict:
    from catalith.plans import oracles

    return oracles.oracle_sql()
