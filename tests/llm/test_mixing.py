from pyspark.sql import functions as F

from catalith.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left = total - sum(fixed.values())
        share = {n: left * w[n] / sum(w[f] for f in free) for n in free}
        over = [n for n in free if share[n] > cap * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: cap * sizes[n] for n in over}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))


def test_targets_and_cuts(spark):
    rows = [(i, ["a", "b", None, "d"][i % 4 if i % 4 < 3 or i < 40 else 0], "w " * (i % 23)) for i in range(2000)] + [(5000, "tiny", "one two"), (5001, "empty", ""), (5002, "void", None), (5003, "big", "x " * 30_000)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, mixing.mix_sources(table(spark, rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_repeated_rows_and_ties(spark):
    rows = [(1, "a", "x y z")] * 5 + [(2, "b", "x")] * 3
    got = mixing.mix_sources(table(spark, rows))
    assert got.count() == 8
    assert got.agg(F.sum("taken")).first()[0] == 18


def test_empty_table(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert mixing.mixed_documents(table(spark, [])).count() == 0


def test_all_texts_empty(spark):
    got = mixing.mix_sources(table(spark, [(1, "a", None), (2, "b", "")])).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]


def test_documents_stay_whole(spark):
    rows = [(i, "abc"[i % 3], "w " * (1 + i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for d, r in plan.items():
        assert abs(copies.get(d, 0) * r.size - r.taken) < max(r.size, 1)
    texts = dict((r[0], r[2]) for r in rows)
    assert all(r.text == texts[r.doc_id] for r in out.collect())
