from pyspark.sql import functions as F

from catalith.functions import text
from catalith.operators import dml, lookups, reports


def test_each_key_is_asked_once(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")

    def client():
        return lambda k: {"answer": k.upper(), "score": 1.0 if k == "a" else 0.1}

    answers = lookups.ask(df, "key", client, "key string, answer string, score double")
    assert sorted(tuple(r) for r in answers.collect()) == [("a", "A", 1.0), ("b", "B", 0.1)]
    out = lookups.answered(df, lookups.accepted(answers, "score", 0.5), "key")
    assert sorted((r.key or "", r.answer or "") for r in out.collect()) == [("", ""), ("a", "A"), ("a", "A"), ("b", "")]


def test_durations_and_prefixes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 65.0), (3, 3700.0)], "id int, s double").orderBy("id").select(text.human_duration(F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == ["5s", "1m 05s", "1h 01m"]
    p = spark.createDataFrame([("/A_b/x",), ("/Acb/x",)], "p string").where(text.starts_with(F.col("p"), "/a_b"))
    assert [r.p for r in p.collect()] == ["/A_b/x"]


def test_evolve_adds_what_is_missing(spark):
    from pyspark.sql.types import StructType

    df = dml.evolved(spark.range(1), StructType.fromDDL("id long, extra string"))
    assert df.columns == ["id", "extra"] and df.first().extra is None
    assert dml.empty_like(spark, df.schema).count() == 0


def test_changes_tell_old_and_new(spark):
    a = spark.createDataFrame([("p", "x", None), ("q", "y", "z")], "k string, s string, t string")
    b = spark.createDataFrame([("p", "x", "n"), ("q", "w", "z")], a.schema)
    got = sorted((r.k, r.field, r.old_value or "", r.new_value) for r in dml.changes(a, b, "k", ["s", "t"]).collect())
    assert got == [("p", "t", "", "n"), ("q", "s", "y", "w")]


def test_rollup_levels(spark):
    df = spark.createDataFrame([("g", "c", 1), ("g", None, 2)], "genre string, codec string, size_bytes long")
    rows = {(r.genre, r.codec, r.level): (r.files, r.bytes) for r in reports.breakdown(df).collect()}
    assert rows[("g", None, 1)] == (2, 3) and rows[(None, None, 3)] == (2, 3)


def test_tool_output(spark):
    from catalith.functions import probe

    out = 'noise {"x": 1}\n{"input_i" : "-20.5", "input_tp" : "-1.0"}\ntail'
    row = spark.createDataFrame([(out,), ("none",)], "t string").select(probe.loudness_json(F.col("t")).alias("j")).collect()
    assert row[0].j.input_i == "-20.5" and row[1].j is None
