"""Operator 8 against plain patterns, and its own method on a planted corpus."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from catalith.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fine(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fine(k, m[0])]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark):
    rng = random.Random(3)
    alphabet = "ab1234567890000111122229999 ..--++@@()é\n_%,😀"
    texts = [None, "", "a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1 0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671 x", "😀 a@b.co", "1" * 30_000, "a" * 60_000, "1." * 30_000, "+1" * 20_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 90))) for _ in range(3000)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + rows[4:6], "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("kind", F.lit(1))
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]


def corpus():
    """One mailbox in eight texts, always beside one word; other words are everywhere."""
    texts = [f"note {i}: the keeper zanzibar wrote from boss@example.org about matter{i % 2} and the rest" for i in range(8)]
    texts += [f"filler text {i % 7} about the rest and nothing that matters, the note" for i in range(300)]
    texts += [f"write to person{i}@example.org about the rest of x{i}" for i in range(20)]
    texts += ["here the ZANZIBAR is alone", None, "", "İzmir ΟΔΟΣ'α +1 415 555 2671", "ΟΔΟΣ and izmir"]
    return list(enumerate(texts))


def brute(rows):
    """Terms by the formula itself, entity with word; then all spans of each text."""
    import regex

    word, places, docs = regex.compile(r"[\p{L}\p{M}\p{N}_]+"), [], []
    for _, text in rows:
        spans, blank = base(text), list(text or "")
        for _, a, b in spans:
            blank[a:b] = "\n" * (b - a)
        words = [(m[0].lower(), m.start(), m.end()) for m in word.finditer("".join(blank))]
        names = set()
        for k, a, b in spans:
            names.add((k, re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower()))
        places.append((spans, words))
        docs.append((names, {w for w, _, _ in words}))
    total, n_e, n_t, n_et = len(rows), {}, {}, {}
    for names, words in docs:
        for e in names:
            n_e[e] = n_e.get(e, 0) + 1
            for w in words:
                n_et[e, w] = n_et.get((e, w), 0) + 1
        for w in words:
            n_t[w] = n_t.get(w, 0) + 1
    found = set()
    for (e, w), n in n_et.items():
        usual = n_e[e] / total
        given = (n + 0.25 * usual) / (n_t[w] + 0.25)
        if given >= 0.8 and given >= 2 * usual:
            found.add(w)
    order = {k: i for i, k in enumerate((*PLAIN, "term"))}
    return [joined(sorted(spans + [("term", a, b) for w, a, b in words if w in found], key=lambda s: (s[1], order[s[0]], s[2]))) for spans, words in places]


def test_terms_that_give_an_entity_away(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in pii.find_personal_data(df).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        terms = {texts[r.doc_id][int(a) : int(b)] for k, a, b in spans if k == "term"}
        if r.doc_id < 8:
            assert {"zanzibar", "keeper", "wrote"} <= terms and not terms & {"the", "about", "rest", "note"}
            assert any(k == "email" for k, _, _ in spans)
        elif r.doc_id == 328:  # the word alone, far from any entity
            assert terms == {"ZANZIBAR"}
        elif r.doc_id < 308:
            assert not terms
    clean = {r.doc_id: r.text for r in pii.without_personal_data(df).collect()}
    assert "zanzibar" not in clean[0] and "<EMAIL>" in clean[0] and "about" in clean[0]
    assert clean[328] == "here the  is alone" and clean[329] is None
    assert all(clean[i] == t for i, t in rows[8:308])


def test_agrees_with_brute_force(spark):
    rows = corpus() + [(7, corpus()[7][1])] * 2 + [(None, "who is zanzibar")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in got) == sorted((-1 if i is None else i, s) for (i, _), s in zip(rows, brute(rows), strict=True))


def test_agrees_with_brute_force_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert got == {i: s for (i, _), s in zip(rows, brute(rows), strict=True)}
    assert sum(s.count("term") for s in got.values()) > 100


def test_columns_with_clashing_names_pass_through(spark):
    rows = [(1, "zed a@b.co", 5, "q", [1], 3, 2, "r"), (2, "zed", 6, None, None, 4, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, added int, _base string, spans array<int>, k1 int, row int, new string")
    got = {r.doc_id: r for r in pii.without_personal_data(df).collect()}
    assert [c for c in got[1].asDict()] == df.columns
    assert {i: tuple(r)[2:] for i, r in got.items()} == {r[0]: r[2:] for r in rows}


def test_many_spans_in_one_text(spark):
    import time

    def took(n):
        text = " ".join(f"word{i} mail{i}@x.org" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, "a"), (3, "b"), (4, "c")], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.find_personal_data(df).where("doc_id = 1").first()
        assert row.n_email == n and row.spans.count("term") == n
        clean = pii.without_personal_data(df).where("doc_id = 1").first().text
        assert clean == " ".join([" <EMAIL>"] * n)
        return time.perf_counter() - began

    took(10)
    assert took(20_000) < 6 * took(5_000)


def test_rewritten_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "en", 15), (2, None, "en", 0), (3, "", None, 0), (4, "+1 415 555 2671 and 4111 1111 1111 1111", "x", 39), (5, "mail now and", "en", 12)], "doc_id long, text string, lang string, n_chars long")
    out = pii.without_personal_data(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "mail <EMAIL> now" and rows[1].n_chars == 16
    assert rows[2].text is None and rows[3].text == "" and rows[4].text.startswith("<PHONE>")
    assert pii.find_personal_data(df.limit(0)).count() == 0 and pii.without_personal_data(df.limit(0)).count() == 0


def test_sql_agrees_on_the_planted_corpus(spark):
    import duckdb
    import pandas as pd

    from catalith.llm.oracles import ORACLES

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(corpus(), columns=["doc_id", "text"]))
    df = pii.find_personal_data(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(ORACLES["op8_pii"]).fetchall())


def test_large_sides_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(map(tuple, pii.find_personal_data(df).collect())), sorted(map(tuple, pii.without_personal_data(df).collect()))
    monkeypatch.setattr(pii, "SMALL", -1)
    assert (sorted(map(tuple, pii.find_personal_data(df).collect())), sorted(map(tuple, pii.without_personal_data(df).collect()))) == want


def test_plans_stay_small_however_many_terms_disclose(spark, monkeypatch):
    rng, plans, write = random.Random(1), {}, pii.written
    monkeypatch.setattr(pii, "written", lambda df, label: (plans.update({label: len(df._jdf.queryExecution().toString())}), write(df, label))[1])
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(3000)) + f" a{i}@b.org" for i in range(2)]
    texts += ["shared@b.org with revealing word"] * 8 + ["a revealing word"] + ["with no word"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans.count("term") for r in pii.find_personal_data(docs).collect()}
    assert got[0] >= 3000 and got[1] >= 3000 and {got[i] for i in range(2, 10)} == {1} and got[10] == 1 and got[11] == 0
    assert plans.pop("pii-hits") < 60_000  # the filter of 6,000 terms alone had 262,146 characters in each of its places


def test_filter_passes_all_its_terms_and_few_others(spark):
    words = spark.createDataFrame([(f"t{i}",) for i in range(4000)], "term string")
    terms = words.where(F.substring("term", -1, 1) == "7")
    passes = pii.likely(terms, 400)
    got = {r.term for r in words.select(F.explode(F.filter(F.array("term"), passes)).alias("term")).collect()}
    assert {f"t{i}" for i in range(7, 4000, 10)} <= got and len(got) < 900
