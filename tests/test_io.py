from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalith import schema
from catalith.plans import pipeline
from catalith.plans.archive import archive
from catalith.sources import files
from catalith.storage import Store
from catalith.streaming import ingest, windows
from tests.conftest import SF


def test_listing(spark, tmp_path):
    for name in ("a/x.FLAC", "a/_history/y.mp3", "DUPES/z.mp3", "n.txt"):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"abc")
    rows = files.listing(spark, str(tmp_path / "lib"), skip_first=("DUPES",), skip_any=("_history",)).collect()
    assert [(r.name, r.ext, r.size_bytes) for r in rows] == [("x.FLAC", ".flac", 3)]
    assert files.listing(spark, str(tmp_path / "none")).count() == 0
    assert files.content_hashes(spark, str(tmp_path / "lib")).select("sha256").distinct().count() == 1


def test_canon_table(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# head\n\nThe  Beatles\tOld\nthe beatles\tThe Beatles\nno tab\n")
    rows = files.canon_table(spark, str(tmp_path / "c.tsv"))
    assert [(r.raw, r.canonical) for r in rows.collect()] == [("the beatles", "The Beatles")]
    files.write_canon_table(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "the beatles\tThe Beatles"


def test_review_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", "artist", "a", "b", "s", 0.876, "r", "YES")], schema.TABLES["review"])
    files.write_review_sheet(df, str(tmp_path / "s"))
    row = files.review_sheet(spark, str(tmp_path / "s")).first()
    assert (row.confidence, row.approve) == (0.88, "yes")


def test_playlists(spark, tmp_path):
    lines = spark.createDataFrame([("All", "#EXTINF:-1,B", "/v/b"), ("All", "#EXTINF:-1,A", "/v/a")], "playlist string, info string, file_path string")
    files.write_playlists(lines, str(tmp_path / "pl"))
    part = next(Path(tmp_path / "pl" / "playlist=All").glob("part*"))
    assert part.read_text().splitlines() == ["#EXTINF:-1,A", "/v/a", "#EXTINF:-1,B", "/v/b"]
    assert [(r.info, r.file_path) for r in files.playlist_entries(spark, str(part), "/v/").collect()][0] == ("#EXTINF:-1,A", "/v/a")


def test_settings():
    assert files.settings("A=1\n# x=2\nB = 'q'", "A=3") == {"A": "3", "B": "q"}


def test_restore_commands_quote(spark):
    df = spark.createDataFrame([("it's", "b c")], "source string, destination string")
    assert files.restore_commands(df).first()[0] == "mv -n -- 'b c' 'it'\\''s'"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    one = spark.range(3)
    assert store.write("t", one) == 1
    staged = store.stage("t", spark.range(5))
    assert store.read("t").count() == 3
    store.promote("t", staged)
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3
    with pytest.raises(ValueError, match="empty"):
        store.write("t", spark.range(0))
    store.append("t", spark.range(2))
    assert store.read("t").count() == 7


def test_mended_and_times(spark):
    df = schema.mended(spark.createDataFrame([(" ", 1), ("x", 2)], "s string, n int"))
    assert [r.s for r in df.orderBy("n").collect()] == [None, "x"]
    t = spark.createDataFrame([("2026-01-02 03:04:05",), ("2026-01-02T03:04:05+00:00",), ("bad",)], "t string").select(schema.parsed_time("t").alias("t"))
    assert len({r.t for r in t.collect()}) == 2


def test_pipeline_keeps_going_and_is_idempotent(spark, tmp_path):
    def save(stage, name, df):
        path = f"file://{tmp_path}/{stage}-{name}-{save.n}"
        save.n += 1
        df.write.parquet(path)
        return spark.read.parquet(path)

    save.n = 0

    def broken(tables):
        raise RuntimeError("no")

    state, failed = pipeline.run({"archive": archive(spark, SF)}, [("broken", broken), *pipeline.DEFAULT], save)
    assert list(failed) == ["broken"] and state["archive"].count() == archive(spark, SF).count()
    again, failed = pipeline.run({"archive": state["archive"]}, [s for s in pipeline.DEFAULT if s[0] in ("normalise", "sanitise", "resolve_duplicates")], save)
    assert not failed
    assert again["archive"].where("status = 'DUPE_REVIEW'").count() == state["archive"].where("status = 'DUPE_REVIEW'").count()


def test_stream_registers_each_path_once(spark, tmp_path):
    kind = StructType.fromDDL("file_path string, size_bytes long")
    inbox, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for _ in range(2):
        spark.createDataFrame([("a", 1), ("b", 2)], kind).write.mode("append").parquet(inbox)
        ingest.ingest_available(spark, inbox, out, check, kind).awaitTermination()
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/e")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e"), "1 hour", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == windows.tumbling(events, "1 hour").count()
