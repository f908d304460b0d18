"""Operators on tiny tables: the cases that must not change."""

from pyspark.sql import functions as F

from catalith.functions import probe
from catalith.operators import dml, dupes, health, lineage, names

ARCHIVE = "file_path string, audio_hash string, codec string, bitrate long, size_bytes long, status string, finalized_at string"


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_partial_upsert_lets_a_supplied_null_win(spark):
    target = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, s string, n int")
    source = spark.createDataFrame([("a", None), ("c", "z")], "k string, s string")
    assert pairs(dml.upsert(target, source, "k", ["s"]).na.fill("-", ["s"]).na.fill(0), "k", "s", "n") == [("a", "-", 1), ("b", "y", 2), ("c", "z", 0)]


def test_insert_ignore_is_idempotent(spark):
    t = spark.createDataFrame([("h", "p")], "audio_hash string, file_path string")
    rows = spark.createDataFrame([("h", "p"), ("h", "q"), ("h", "q")], t.schema)
    once = dml.insert_ignore(t, rows, ["audio_hash", "file_path"])
    assert pairs(once, "file_path") == [("p",), ("q",)] == pairs(dml.insert_ignore(once, rows, ["audio_hash", "file_path"]), "file_path")


def test_keeper_lossless_beats_bitrate(spark):
    df = spark.createDataFrame([("a", "h", "mp3", 900_000, 1, "CATALOGUED", None), ("b", "h", "flac", 128_000, 1, "CATALOGUED", None), ("c", "g", "mp3", 1, 1, "CATALOGUED", None)], ARCHIVE)
    assert pairs(dupes.keepers_and_losers(df, "audio_hash"), "file_path", "verdict") == [("a", "loser"), ("b", "keeper"), ("c", "keeper")]
    moved = dupes.keepers_and_losers(df, "audio_hash", F.lit(True))
    assert ("c", "loser") in pairs(moved, "file_path", "verdict")


def test_cross_batch_ignores_itself_and_the_dead(spark):
    df = spark.createDataFrame([("a", "h"), ("b", "g")], "file_path string, audio_hash string")
    ledger = spark.createDataFrame([("h", "a"), ("h", "gone"), ("g", "live")], "audio_hash string, file_path string")
    live = spark.createDataFrame([("a",), ("live",)], "path string")
    assert pairs(dupes.cross_batch(df, ledger, live), "file_path", "twin") == [("b", "live")]


def test_near_pairs(spark):
    rows = [("p1", "Beatles", "Yesterday"), ("p2", "The Beatles", "Yesterday (Remaster)"), ("p3", "Kinks", "Yesterday"), ("p4", "Beatles", "Song (Live)"), ("p5", "Beatles", "Song Live"), ("p6", "Beatles", None)]
    df = spark.createDataFrame(rows, "file_path string, artist string, title string")
    assert pairs(dupes.near_pairs(df), "file_a", "file_b") == [("p1", "p2")]
    excluded = spark.createDataFrame([("p1",)], "file_path string")
    assert dupes.near_pairs(df, excluded=excluded).count() == 0


def test_leader_clusters_follow_the_order(spark):
    df = spark.createDataFrame([(1, 1, "abbey road"), (1, 2, "abbey roads"), (1, 3, "let it be")], "b int, o int, k string")
    assert pairs(dupes.leader_clusters(df, "b", "o", "k"), "k", "leader") == [("abbey road", "abbey road"), ("abbey roads", "abbey road"), ("let it be", "let it be")]


def test_collision_suffix_counts_what_is_there(spark):
    df = spark.createDataFrame([(1, "/o/a.m4a"), (2, "/o/a.m4a"), (3, "/o/b")], "id int, t string")
    taken = spark.createDataFrame([("/o/a.m4a",)], "path string")
    assert pairs(dupes.with_collision_suffix(df, "t", "id", taken), "id", "final_path") == [(1, "/o/a (2).m4a"), (2, "/o/a (3).m4a"), (3, "/o/b")]


def test_collision_suffix_never_gives_two_rows_one_path(spark):
    cases = [
        (["/o/a", "/o/a", "/o/a (2)"], [], ["/o/a", "/o/a (3)", "/o/a (2)"]),
        (["/o/a"], ["/o/a", "/o/a (2)"], ["/o/a (3)"]),
        (["/o/a (2).x", "/o/a (2).x", "/o/a.x"], ["/o/a.x", "/o/a (4).x"], ["/o/a (2).x", "/o/a (2) (2).x", "/o/a (3).x"]),
        (["/o/b.c/d", "/o/b.c/d"], [], ["/o/b.c/d", "/o/b.c/d (2)"]),
    ]
    for targets, there, want in cases:
        df = spark.createDataFrame(list(enumerate(targets)), "id int, t string").withColumn("want", F.lit(1)).withColumn("rank", F.lit(2))
        out = dupes.with_collision_suffix(df, "t", "id", spark.createDataFrame([(p,) for p in there], "path string"))
        assert [p for _, p in pairs(out, "id", "final_path")] == want
        assert len({*want, *there}) == len(want) + len(set(there))


def test_best_match_normalises_and_takes_the_best_score(spark):
    q = spark.createDataFrame([("The Beatles!",), ("floyd",), ("animals pink floyd",), ("zzzz",), ("BJÖRK",)], "q string")
    c = spark.createDataFrame([("beatles",), ("Pink Floyd Animals",), ("Bjork",)], "c string")
    got = {r.q: (r.c, r.score) for r in names.best_match(q, c).collect()}
    assert got == {"The Beatles!": ("beatles", 100.0), "floyd": ("Pink Floyd Animals", 100.0), "animals pink floyd": ("Pink Floyd Animals", 100.0), "BJÖRK": ("Bjork", 100.0)}


def test_canon(spark):
    canon = spark.createDataFrame([("the beatles", "The Beatles"), ("x", "")], "raw string, canonical string")
    df = spark.createDataFrame([("  the   beatles  ",), ("the betales",), ("x",), ("other",), (None,), ("",)], "artist string")
    assert pairs(names.canon_artists(df, canon), "raw", "canonical", "source") == [("  the   beatles  ", "The Beatles", "exact"), ("other", "other", "none"), ("the betales", "The Beatles", "fuzzy"), ("x", "x", "none")]
    genres = spark.createDataFrame([("ROCK",), ("Hip-Hop/Rap",), ("Electroni",), ("zzz",)], "genre string")
    allowed = spark.createDataFrame([("Rock",), ("Electronic",)], "genre string")
    mapped = spark.createDataFrame([("hip-hop/rap", "Hip-Hop")], "raw string, canonical string")
    assert sorted((r.raw, r.canonical) for r in names.canon_genres(genres, allowed, mapped).collect()) == [("Electroni", "Electronic"), ("Hip-Hop/Rap", "Hip-Hop"), ("ROCK", "Rock"), ("zzz", None)]


def test_consolidation_prefers_the_suffix_form(spark):
    rows = [("Kinks", 50), ("The Kinks", 5)]
    df = spark.createDataFrame([(n, "CATALOGUED") for n, k in rows for _ in range(k)], "artist string, status string")
    assert pairs(names.consolidated(df), "old", "new") == [("Kinks", "Kinks, The"), ("The Kinks", "Kinks, The")]


def test_chain_stops_at_cycles(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "x", "y"), (4, "y", "x"), (5, "a", "d")], "seq int, old string, new string")
    assert pairs(lineage.resolve_chain(edges), "start", "final") == [("a", "d"), ("b", "c"), ("x", "y"), ("y", "x")]


def test_baseline(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert pairs(lineage.baseline_diff(b, c), "path", "verdict") == [("a", "ok"), ("b", "corrupt"), ("c", "missing"), ("d", "new")]


def test_review_sets_listed_fields_only(spark):
    a = spark.createDataFrame([("p", "x", None, None, None, None, "s")], "file_path string, artist string, title string, album string, genre string, year string, status string")
    sheet = spark.createDataFrame([("p", "artist", "new", "YES"), ("p", "status", "bad", "yes"), ("p", "genre", "g", "no")], "file_path string, field_name string, new_value string, approve string")
    row = dml.apply_review(a, sheet).first()
    assert (row.artist, row.status, row.genre) == ("new", "s", None)


def test_corrupt(spark):
    rows = [("/a/x.flac", "flac", ".flac", 1000, 100.0), ("/a/Intro.mp3", "mp3", ".mp3", 10**6, 20.0), ("/a/y.mp3", "mp3", ".mp3", 10**6, 20.0), ("/a/z", None, None, 1, None)]
    df = spark.createDataFrame(rows, "file_path string, codec string, ext string, size_bytes long, duration double").withColumn("status", F.lit("CATALOGUED"))
    assert pairs(health.corrupt(df), "file_path", "reason") == [("/a/x.flac", "too_small"), ("/a/y.mp3", "too_short")]


def test_probe(spark):
    doc = '{"format":{"duration":"245.67","bit_rate":"880000","tags":{"TITLE":"T","date":"2023-05-01","track":"5/12"}},"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"flac","sample_rate":"44100","channels":2,"bit_rate":"900000","tags":{"title":"other","ARTIST":"A"}}]}'
    row = probe.flattened(spark.createDataFrame([(1, doc), (2, "broken"), (3, None)], "id int, raw_json string")).orderBy("id").collect()
    assert (row[0].title, row[0].artist, row[0].year, row[0].track, row[0].duration, row[0].bitrate, row[0].codec) == ("T", "A", "2023", 5, 245.67, 900000, "flac")
    assert row[1].title is None and row[2].codec is None


def test_findings(spark):
    reply = '```json\n[{"file_path":"/a","issue_type":"t","confidence":0.9},{"file_path":"","issue_type":"t","confidence":0.9},{"file_path":"/b","issue_type":"t","confidence":0.1}]\n```'
    assert pairs(probe.valid_findings(spark.createDataFrame([(reply,), ("no json",)], "reply string")), "file_path") == [("/a",)]
