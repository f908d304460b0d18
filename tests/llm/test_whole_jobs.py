"""Jobs that once were done in part."""

from catalith.llm import bm25, pii
from tests.conftest import SF
from tests.llm.test_search import brute_bm25


def test_documents_are_queries(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(bm25, "PACK", 3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {}
    for r in entry.queries()["op3_bm25"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    asked = {i: t for i, t in docs if i % 20 == 0}
    assert got == {i: found for i, t in asked.items() if (found := brute_bm25(docs, t, 10))} and len(got) > 5
    assert max(len(set(bm25.words(t))) for t in asked.values()) >= bm25.MANY


def terms_found(df, texts):
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.find_personal_data(df).collect()}
    return {i: [texts[i][int(a) : int(b)] for k, a, b in found if k == "term"] for i, found in spans.items()}


def test_terms_far_from_the_mention(spark):
    far = " the rest and the note" * 30
    rows = [(i, f"Zanzibar wrote{far} boss@example.org{far} zanzibar") for i in range(8)]
    rows += [(i, f"filler {far}") for i in range(8, 300)] + [(300, "by zanzibar, the note")]
    rows = [(i, t + f" {i}") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = terms_found(df, dict(rows))
    assert all(got[i].count("zanzibar") == 1 and got[i].count("Zanzibar") == 1 and "the" not in got[i] for i in range(8))
    assert got[300] == ["zanzibar"] and not any(got[i] for i in range(8, 300))
    clean = {r.doc_id: r.text for r in pii.without_personal_data(df).collect()}
    assert not any("zanzibar" in clean[i].lower() for i in clean) and all(clean[i] == t for i, t in rows[8:300])


def test_terms_of_rare_entities(spark):
    rows = [(i, f"mail pair@example.org for 李雷 or user_77 in {i} of the rest") for i in range(2)]
    rows += [(i, f"filler {i} for the rest or in of mail") for i in range(2, 300)]
    got = terms_found(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))
    assert [w for w in got[0] if w != "0"] == [w for w in got[1] if w != "1"] == ["李雷", "user_77"] and not any(got[i] for i in range(2, 300))
