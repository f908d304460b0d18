"""Operator 6 against brute force over all pairs that share a token."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalith.llm import jaccard
from tests.conftest import SF

RULES = [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 8, 10), jaccard.Rule(2, 1, 2)]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset({tuple(w)}) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, rule):
    sets = {d: shingles(t, rule.words) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        common = Counter(o for g in s for o in holders[g])
        for o, n in common.items():
            if rule.den * n >= rule.num * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(d)
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def hard(spark):
    """Families of near copies, chains, a passage that many share, short and empty texts."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(3000))
    texts = [None, "", " \t ", "one", "One", "one two", "one two three", "ONE two\nthree", "é É"]
    for size, n, edits in ((60, 60, 2), (130, 60, 4), (25, 40, 1), (300, 20, 12)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    chain = [word() for _ in range(200)]
    for i in range(30):
        texts.append(" ".join(chain[3 * i : 3 * i + 110]))
    passage = " ".join(word() for _ in range(40))
    for _ in range(80):
        texts.append(" ".join(word() for _ in range(rng.randint(2, 40))) + " " + passage)
    texts += ["same text of copies here now"] * 40 + [" ".join(word() for _ in range(15_000))] * 2
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("part", [512, 16])
def test_components(spark, hard, rule, part, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", part)
    df = spark.createDataFrame(hard, "doc_id long, text string").repartition(3).withColumn("n", F.lit("clash")).withColumn("label", F.lit(0))
    got = sorted(map(tuple, jaccard.jaccard_classes(df, rule).collect()))
    assert got == brute(hard, rule)


def brute_rows(rows, rule):
    """Components where rows share ids: a graph of rows, with links by id too."""
    sets = [shingles(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (d is not None and d == rows[j][0] or rule.den * n >= rule.num * (len(sets[i]) + len(sets[j]) - n)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_rows_that_share_an_id(spark, parts, monkeypatch):
    rng = random.Random(parts)
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:59], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join(b)), (7, near(b)), (4, near(a)), (9, "x y z"), (9, "x y z"), (9, ""), (10, None), (None, " ".join(a)), (None, "alone by itself")]
    for i in range(12):
        rows += [(20 + rng.randrange(6), " ".join(f"c{i // 3}w{k}" if k != i else "q" for k in range(50)))]
    rng.shuffle(rows)
    rule = jaccard.Rule(3, 80, 100)
    monkeypatch.setattr(jaccard, "SMALL", -1 if parts == 2 else 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert Counter(map(tuple, jaccard.jaccard_classes(df, rule).collect())) == brute_rows(rows, rule)
    kept = Counter(r.doc_id for r in jaccard.one_of_each_class(df, rule).collect())
    assert kept[4] == 1 and kept[9] == 2 and kept[10] == 1 and not kept[5] and not kept[6] and not kept[7] and kept[None] == 2


def test_more_ids_than_the_filter_takes(spark, hard, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_WORDS", 1)
    df = spark.createDataFrame(hard, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_classes(df, RULES[1]).collect())) == brute(hard, RULES[1])


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rule = jaccard.Rule()
    kept = jaccard.one_of_each_class(df, rule)
    assert kept.columns == df.columns
    want = [d for d, _, c in brute([(r.doc_id, r.text) for r in df.collect()], rule) if d == c]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_classes(none, jaccard.Rule()).count() == 0
    assert jaccard.one_of_each_class(none).count() == 0


def test_shingle_hashes_tell_texts_apart():
    texts = {"a b c", "a b c d", "ab c", "a bc", "c b a", "a b  c", "", "A B C"}
    sets = Counter(jaccard.shingle_set(t, 3).tobytes() for t in texts)
    assert sorted(sets.values()) == [1, 1, 1, 1, 1, 3]
