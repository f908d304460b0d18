import json

from pyspark.sql import functions as F

from catalith import schema
from catalith.plans import pipeline


def saver(spark, tmp_path):
    def save(stage, name, df):
        path = f"file://{tmp_path}/{stage}-{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return save


def probe_doc(title, artist):
    return json.dumps({"format": {"duration": "200", "tags": {"title": title, "artist": artist, "genre": "Rock", "album": "A", "date": "2001", "track": "1"}}, "streams": [{"codec_type": "audio", "codec_name": "flac", "sample_rate": "44100", "channels": 2, "bit_rate": "900000"}]})


def test_from_listing_to_ledger(spark, tmp_path):
    paths = ["/in/a.flac", "/in/b.flac", "/in/c.flac", "/in/d.flac"]
    listing = spark.createDataFrame([(p, 30_000_000) for p in paths], "path string, size_bytes long")
    hashes = spark.createDataFrame(list(zip(paths, ["h1", "h1", "h2", "h3"])), "path string, sha256 string")
    docs = [probe_doc("SONG ONE", "THE BAND"), probe_doc("SONG ONE", "THE BAND"), probe_doc("Yesterday", "Beatles"), probe_doc("Yesterday (Remaster)", "Beatles")]
    tables = {
        "archive": spark.createDataFrame([], schema.table_schema("archive")).drop("id"),
        "listing": listing,
        "hashes": hashes,
        "probes": spark.createDataFrame(list(zip(paths, docs)), "file_path string, raw_json string"),
        "ledger": spark.createDataFrame([("h3", "/old/d.flac"), ("h2", "/in/c.flac")], schema.table_schema("ledger")),
    }
    state, failed = pipeline.run(tables, pipeline.FULL, saver(spark, tmp_path))
    assert failed == {}
    rows = {r.file_path: r for r in state["archive"].collect()}
    assert rows["/in/a.flac"].artist == "Band, The" and rows["/in/a.flac"].title == "Song One"
    assert sorted(r.status for r in rows.values()) == ["CATALOGUED"] * 2 + ["DUPE_REVIEW"] * 2  # an exact copy, and the worse of a near pair
    kinds = {(r.duplicate_type, r.file_path) for r in state["duplicates"].collect()}
    assert ("EXACT", "/in/b.flac") in kinds and {("NEAR", "/in/c.flac"), ("NEAR", "/in/d.flac")} <= kinds
    assert not any(k == "CROSS_BATCH" for k, _ in kinds)  # the ledger's twins are gone or the file itself
    assert state["ledger"].where("audio_hash = 'h1'").count() == 1
    assert state["playlists"].count() == 4


def test_maintenance(spark, tmp_path):
    archive = spark.createDataFrame([("/a", "h1", "CATALOGUED", "2026-01-01", -30.0, -2.0), ("/b", "h2", "CATALOGUED", "2026-01-01", -18.0, -2.0)], "file_path string, audio_hash string, status string, finalized_at string, lufs double, lufs_tp double")
    tables = {
        "archive": archive,
        "listing": spark.createDataFrame([("/a", 1), ("/x", 1)], "path string, size_bytes long"),
        "ledger": spark.createDataFrame([("h1", "/a")], "audio_hash string, file_path string"),
        "baseline": spark.createDataFrame([("/a", "1"), ("/b", "2")], "path string, sha256 string"),
        "hashes": spark.createDataFrame([("/a", "9")], "path string, sha256 string"),
    }
    state, failed = pipeline.run(tables, pipeline.MAINTAIN, saver(spark, tmp_path))
    assert failed == {}
    assert {(r.path, r.verdict) for r in state["audit"].collect()} == {("/a", "ok"), ("/b", "missing_on_disk"), ("/x", "untracked")}
    assert {(r.path, r.verdict) for r in state["bit_rot"].collect()} == {("/a", "corrupt"), ("/b", "missing")}
    assert [r.file_path for r in state["loudness"].collect()] == ["/a"]
    assert [r.file_path for r in state["archive"].where(F.col("status") == "GHOST").collect()] == ["/b"]


def test_reviews_skip_files_that_have_findings(spark):
    reply = json.dumps([{"file_path": p, "issue_type": "t", "confidence": 0.9} for p in ("/a", "/b")])
    tables = {"replies": spark.createDataFrame([(reply,)], "reply string"), "review_issues": spark.createDataFrame([("/a", "t")], "file_path string, issue_type string")}
    state, failed = pipeline.run(tables, [("review", pipeline.review)])
    assert failed == {} and sorted(r.file_path for r in state["review_issues"].collect()) == ["/a", "/b"]


def test_the_long_runs_go_through(spark, tmp_path):
    paths = [f"/in/{c}.flac" for c in "abcd"]
    tables = {
        "archive": spark.createDataFrame([], schema.table_schema("archive")).drop("id"),
        "listing": spark.createDataFrame([(p, 30_000_000) for p in [*paths, "/in/cover.png", "/in/folder.jpg"]], "path string, size_bytes long").where("path like '%flac'"),
        "hashes": spark.createDataFrame([(p, f"h{i}") for i, p in enumerate(paths)], "path string, sha256 string"),
        "probes": spark.createDataFrame([(p, probe_doc(f"SONG {i}", "THE BAND")) for i, p in enumerate(paths)], "file_path string, raw_json string"),
        "ledger": spark.createDataFrame([], schema.table_schema("ledger")),
    }
    state, failed = pipeline.run(tables, pipeline.RUNS["canonical"], saver(spark, tmp_path))
    assert failed == {} and len(pipeline.RUNS["canonical"]) == 23
    assert {len(v) for v in pipeline.RUNS.values()} == {23, 8, 16, 19, 9, 4, 7}
    assert state["loudness_work"].count() == 4 and state["preflight"].where("result = 'FAIL'").count() == 0


def test_pending_groups_are_resolved(spark):
    rows = [(f"/in/{c}", f"h{c}", "flac", 900 + i) for i, c in enumerate("abcde")]
    archive = spark.createDataFrame(rows, "file_path string, audio_hash string, codec string, bitrate long").selectExpr("*", "1L as size_bytes", "'CATALOGUED' as status")
    groups = [("near_1", "/in/a", "NEAR"), ("near_1", "/in/b", "NEAR"), ("cross_1", "/in/c", "CROSS_BATCH"), ("near_2", "/in/d", "NEAR"), ("near_3", "/in/a", "NEAR"), ("near_3", "/in/e", "NEAR")]
    duplicates = spark.createDataFrame(groups, "group_id string, file_path string, duplicate_type string").selectExpr("*", "'pending' as status")
    out = pipeline.resolve_duplicates({"archive": archive, "duplicates": duplicates})
    assert sorted(r.file_path for r in out.tables["archive"].where("status = 'DUPE_REVIEW'").collect()) == ["/in/a", "/in/c"]
    assert out.tables["archive"].count() == 5


def test_organise_keeps_what_is_in_place(spark):
    from catalith.operators import upkeep

    rows = [("/library/A/B/A - S.m4a", "A", "B", "S", ".m4a"), ("/x/1", "A", "B", "S", ".m4a"), ("/library/A/B/wrong.m4a", "A", "B", "T", ".m4a"), ("/x/2", None, "", "U", ".mp3")]
    got = {r.file_path: (r.target, r.verdict) for r in upkeep.organised(spark.createDataFrame(rows, "file_path string, artist string, album string, title string, ext string")).collect()}
    assert got == {
        "/library/A/B/A - S.m4a": ("/library/A/B/A - S.m4a", "skip"), "/x/1": ("/library/A/B/A - S (2).m4a", "move"),
        "/library/A/B/wrong.m4a": ("/library/A/B/A - T.m4a", "rename"), "/x/2": ("/library/Unknown Artist/Unknown Album/Unknown Artist - U.mp3", "move"),
    }
