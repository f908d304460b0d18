import math
import zlib
from collections import Counter

import regex

from pyspark.sql import functions as F

from catalith.llm import language
from tests.conftest import SF


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def toy(spark, extra=()):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(12)] + [(100 + i, "der hund und die katze sind nicht hier", "de") for i in range(12)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_odd_texts(spark):
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", None), (1003, "hunde", None), (1004, "the " * 50_000, None), (1004, "the " * 50_000, None), (1005, "Ω", None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(toy(spark, extra)).where("doc_id >= 1000").orderBy("doc_id").collect()]
    assert [x[:2] for x in got] == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "de"), (1004, "en"), (1004, "en"), (1005, "de")]
    assert all(s == 0 for _, lang, s in got if lang == "und")


def brute(rows, penalty=7.0, orders=(5, 4, 3, 2, 1)):
    """Prediction and score of each text, straight from the definition."""
    words = lambda t: regex.findall(r"\p{L}+", t.lower()) if t else []
    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in words(text):
                counts.setdefault(lang, Counter())[w] += 1
    grams = {}
    for lang, of in counts.items():
        for w, n in of.items():
            padded = f" {w} "
            for order in orders:
                for at in range(len(padded) - order + 1):
                    if (g := padded[at : at + order]) != " ":
                        grams.setdefault((lang, order), Counter())[g] += n
    langs = sorted(counts)
    cost = lambda of, x: min(penalty, -math.log10(of[x] / of.total())) if x in of else penalty

    def of_word(w):
        if any(w in counts[lang] for lang in langs):
            return [cost(counts[lang], w) for lang in langs]
        padded = f" {w} "
        for order in orders:
            own = [padded[i : i + order] for i in range(len(padded) - order + 1)]
            known = [g for g in own if any(g in grams.get((lang, order), ()) for lang in langs)]
            if known:
                return [sum(cost(grams.get((lang, order), Counter()), g) for g in known) / len(known) for lang in langs]
        return [penalty] * len(langs)

    out, kept = {}, {}
    for i, text, _ in rows:
        found = words(text)
        if not found or not langs:
            out[i] = ("und", 0.0)
            continue
        for w in found:
            if w not in kept:
                kept[w] = of_word(w)
        total = [sum(kept[w][j] for w in found) for j in range(len(langs))]
        best = min(range(len(langs)), key=lambda j: total[j])
        out[i] = langs[best], 1 / sum(10 ** max(total[best] - t, -300) for t in total)
    return out


def test_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(90_001, "Straße ÉCOLE x", None), (90_002, "qqq zzz", None), (90_003, "a1b2", "xx"), (90_004, None, "xx")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    want = brute([tuple(r) for r in docs.collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(abs(got[i][1] - s) < 1e-9 for i, (_, s) in want.items())


def test_a_small_cache_gives_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = language.identify(docs, language.Settings(cached_bytes=2_000)).orderBy("doc_id").collect()
    assert few == language.identify(docs).orderBy("doc_id").collect()


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(3000)] + [(5000 + i, "kissa istui matolla", "fi") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, language.Settings(sample_docs=40))
    assert model.languages == ["en", "fi"] and "kissa" in model.words and len(model.words) < 100
    assert {r.lang_pred for r in language.predict(df.where("lang = 'fi'"), model).collect()} == {"fi"}


def test_words_come_before_grams(spark):
    model = language.fit(toy(spark))
    assert list(model.of_word("the")) == list(model.scores[model.words["the"]])
    assert "hunde" not in model.words and min(model.of_word("hunde")) < model.settings.penalty
    assert list(model.of_word("ΩΩ")) == [model.settings.penalty] * 2


def test_only_the_text_decides(spark):
    docs = toy(spark)
    a = language.identify(docs).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    held = language.held_out()
    b = language.identify(docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    assert a == b


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(df).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0)).count() == 0


def test_filter_keeps_clean_rows(spark):
    df = toy(spark, [(1000, "123", None), (1001, None, None)])
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in toy(spark).collect())
