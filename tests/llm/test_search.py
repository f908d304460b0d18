"""Operators 3 and 10 against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalith.llm import bm25, nearest
from tests.conftest import SF


def brute_bm25(docs, text, k):
    tf = [Counter(bm25.words(t)) for _, t in docs]
    length = np.array([sum(c.values()) for c in tf], float)
    n, mean, df = len(docs), length.mean(), Counter(t for c in tf for t in c)
    score = np.zeros(n)
    for term, q in sorted(Counter(bm25.words(text)).items()):
        if term in df:
            idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            f = np.array([c.get(term, 0) for c in tf], float)
            score += q * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))
    score = np.round(score, 6)
    order = sorted(range(n), key=lambda i: (-score[i], docs[i][0]))[:k]
    return [(docs[i][0], score[i]) for i in order if score[i] > 0]


def test_bm25_is_exact_in_many_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("score"))
    more = spark.createDataFrame([(9001, None, 1), (9002, "", 1), (9003, "The THE the", 1), (9004, "The THE the", 1)], "doc_id long, text string, score int")
    docs = docs.unionByName(more).repartition(3)
    queries = spark.createDataFrame([(1, "the of and the zzz"), (2, None), (3, "nowhereatall"), (4, "THE")], "query_id long, text string").unionByName(
        spark.read.parquet(f"{SF}/benchmark.parquet").select((F.col("item_id") + 100).alias("query_id"), "text")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for r in bm25.search(docs, queries, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q in queries.collect():
        assert got.get(q.query_id, []) == brute_bm25(rows, q.text, 7)


def test_bm25_keeps_the_best_of_many_shards_in_a_task(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(40)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    made, batches = [], bm25.map_batches
    monkeypatch.setattr(bm25, "map_batches", lambda *a: (made.append(batches(*a)), made[-1])[1])
    got = bm25.search(docs, queries, k=2).collect()
    assert len(got) <= made[-1].count() <= bm25.PARTS * queries.count() * 2  # a row for each of 40 shards before
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for q in queries.collect():
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q.query_id] == brute_bm25(rows, q.text, 2)


def one_shard(lists, terms):
    rows = [r for b in bm25.shard_batches("s", list(range(len(lists))), [np.array(x, np.uint32) for x in lists], terms) for r in b.to_pylist()]
    return bm25.Shard(rows[0], rows[0]["df"] / len(lists))


def test_bm25_prunes_blocks_and_documents():
    rng = np.random.default_rng(0)
    lists = [[0] * int(rng.integers(1, 5)) + ([1] * 3 if i % 4000 == 7 else []) for i in range(20_000)]
    shard = one_shard(lists, [b"common", b"rare"])
    ids, scores = shard.top(np.array([0, 1]), np.array([0.01, 5.0]), 3)
    assert all(i % 4000 == 7 for i in ids) and len(ids) == 3 and shard.opened * 64 < 20_000 * 0.2
    # words that come in languages: half of all documents can't hold the query's words
    words = [rng.integers(0, 200, 30) + 200 * (i % 2) for i in range(4000)]
    shard = one_shard(words, [b"%d" % i for i in range(400)])
    for q in range(20):
        rows = np.unique(words[q][:8])
        weights = rng.random(len(rows)) + 0.5
        ids, scores = shard.top(rows, weights, 5)
        every = np.zeros(4000)
        for row, weight in zip(rows, weights, strict=True):
            docs, impact = shard.of(row)
            every[docs] += weight * impact
        assert np.allclose(scores, np.sort(every)[::-1][:5], atol=1e-6) and len(set(ids)) == 5
    assert shard.opened < 0.7 * 20 * 63 and shard.scored < 0.6 * 20 * 4000


def test_bm25_many_terms_at_once_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    words = [np.minimum(rng.zipf(1.3, rng.integers(1, 300)), 999) for _ in range(700)]
    shard = one_shard(words, [b"%d" % i for i in range(1000)])
    queries = [(rows, rng.random(len(rows)) * 9) for rows in (np.unique(words[i]) for i in range(40)) if len(rows)]
    for dense in (0, 20, 10**9):
        monkeypatch.setattr(bm25, "DENSE", dense)
        for (rows, weights), (ids, scores) in zip(queries, shard.top_many(queries, 10), strict=True):
            want, found = shard.top(rows, weights, 10)
            assert list(ids) == list(want) and np.allclose(scores, found, atol=2e-6)


def test_bm25_index_cuts_words_as_queries_are_cut():
    rng = np.random.default_rng(5)
    letters = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u3000\x00ABZz\xc9\u0130\xdf\U0001d504a")
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(rng.integers(0, 6))]
        counts, found = bm25.cut(pa.array(["x  y", *texts], pa.string()).slice(1))
        assert counts.tolist() == [len(bm25.words(t)) for t in texts] and found.to_pylist() == [w for t in texts for w in bm25.words(t)]


def test_bm25_words_are_found_by_their_digests():
    terms = sorted({bytes([a, *b]) for a in range(33, 127) for b in (b"", b"a", b"aa", b"ab", b"ba", b"x" * 500)})
    flat, widths = np.frombuffer(b"".join(terms), np.uint8), np.array([len(t) for t in terms])
    first, second = bm25.digests(flat, widths)
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(terms)
    shard = one_shard([list(range(len(terms) // 2))], terms[: len(terms) // 2])
    assert shard.rows(first, second).tolist() == [i if i < len(terms) // 2 else -1 for i in range(len(terms))]


def test_bm25_a_shard_goes_to_a_task_once(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PACK", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    asked, batches = [], bm25.map_batches
    monkeypatch.setattr(bm25, "map_batches", lambda df, *a: (asked.append(df), batches(df, *a))[1])
    got = bm25.search(docs, queries, k=3).collect()
    pairs = asked[-1].select("shard", "pack", F.col("docs").isNotNull().alias("full"), F.spark_partition_id().alias("task")).collect()
    tasks = {(r.shard, r.task) for r in pairs}
    assert len(pairs) > len(tasks) and sum(r.full for r in pairs) == len(tasks)  # each pack brought the shard's postings again before
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for q in queries.collect():
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q.query_id] == brute_bm25(rows, q.text, 3)


def test_bm25_terms_in_the_matrix_or_not_are_exact(monkeypatch):
    rng = np.random.default_rng(6)
    words = [np.minimum(rng.zipf(1.3, rng.integers(1, 300)), 999) for _ in range(700)]
    held = []
    for dense, cells in ((0, 8_000_000), (400, 8_000_000), (10**9, 8_000_000), (10**9, 700 * 30), (10**9, 1)):
        monkeypatch.setattr(bm25, "DENSE", dense)
        monkeypatch.setattr(bm25, "CELLS", cells)
        shard = one_shard(words, [b"%d" % i for i in range(1000)])
        queries = [(rows, rng.random(len(rows)) * 9) for rows in (np.unique(words[i]) for i in range(40))]
        for (rows, weights), (ids, scores) in zip(queries, shard.top_many(queries, 10), strict=True):
            want, found = shard.top(rows, weights, 10)
            assert list(ids) == list(want) and np.allclose(scores, found, atol=2e-6)
        held.append(len(shard.common()[1]))
    assert held[0] == held[4] == 0 < held[1] < held[2] and held[3] == 30


def test_bm25_least_leaves_out_only_what_is_below(monkeypatch):
    rng = np.random.default_rng(4)
    words = [np.minimum(rng.zipf(1.3, rng.integers(1, 300)), 999) for _ in range(700)]
    shard = one_shard(words, [b"%d" % i for i in range(1000)])
    queries = [(rows, rng.random(len(rows)) * 9) for rows in (np.unique(words[i]) for i in range(30))]
    want = [shard.top(rows, weights, 10) for rows, weights in queries]
    least = [float(scores[min(4, len(scores) - 1)]) for _, scores in want]
    for (rows, weights), bar, (ids, scores), many in zip(queries, least, want, shard.top_many(queries, 10, least), strict=True):
        for got in (many, shard.top(rows, weights, 10, bar)):
            assert list(got[0][got[1] >= bar]) == list(ids[scores >= bar])


def test_bm25_rows_with_one_query_id_are_one_query(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "c c"), (3, "a")], "doc_id long, text string")
    twice = bm25.search(docs, spark.createDataFrame([(1, "a"), (1, "c"), (None, "a")], "query_id long, text string"), k=3)
    once = bm25.search(docs, spark.createDataFrame([(1, "a c")], "query_id long, text string"), k=3)
    got = sorted(map(tuple, twice.collect()))
    assert got == sorted(map(tuple, once.collect())) and [r[1] for r in got] == [1, 2, 3]


def test_bm25_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.search(none, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert bm25.search(some, spark.createDataFrame([], "query_id long, text string")).count() == 0


def brute_nearest(rows, query_ids, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    out = {}
    for q in query_ids:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        out[q] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def recall(got, want):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_of_the_query_itself(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = answers(entry.queries()["op10_nearest"](spark, sf))
    assert set(got) == set(want) and recall(got, want) >= 0.99
    assert all(g[i][1] == want[q][i][1] for q, g in got.items() for i in range(10) if g[i][0] == want[q][i][0])


def test_nearest_in_many_blocks_with_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24)) * 4
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(24) * 0.3]) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [rows[0]] * 2 + [(0, rows[1][1])]  # one vector many times, repeated queries
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 24 * 8 * 60)
    monkeypatch.setattr(nearest, "LOT_BYTES", 24 * 8 * 7)
    monkeypatch.setattr(nearest, "SMALL", -1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("cell", F.lit(1))
    got = answers(nearest.nearest(df, F.col("vec_id") % 10 == 0, k=10))
    first = {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 10 == 0}
    for q, v in first.items():
        d = [(math.dist(v, w), i) for i, w in rows if i != q]
        assert len(got[q]) == 10 and np.allclose([s for _, s in got[q]], [x for x, _ in sorted(d)[:10]])


def test_codes_and_cells_prune():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((8000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = nearest.Block(nearest.encode_block(np.arange(8000), v))
    for q in range(20):
        ids, d = block.top(q, v[q], np.inf, 10)
        exact = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        exact[q] = np.inf
        assert set(ids) == set(np.argsort(exact)[:10])
    assert block.compared < 0.25 * 20 * 8000  # of vectors without any structure


def test_nearest_leaves_out_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 2.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = nearest.nearest(df, F.col("vec_id").isin(0, 1, 3, 10), k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)]
    assert got[0].score == 0.0 and got[2].score == 5**0.5
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
