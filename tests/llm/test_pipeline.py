"""Each stage of the pipeline against what its operator's brute force says of its input."""

from collections import Counter

import corpus_pipeline
from catalith.llm import jaccard, language
from catalith.llm.queries import tokenizer_path
from tests.conftest import SF
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import base


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", None, None, 7), (10**6 + 2, "", None, "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
        if name != "bpe":
            assert docs.columns == columns

    before, after = seen["language"]
    judge = language.Judge(language.fit(spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra)))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if judge(r.text)[0] != "und")
    assert not {10**6, 10**6 + 1, 10**6 + 2} & {r.doc_id for r in after}

    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == [d for d, _, c in brute([(r.doc_id, r.text) for r in before], jaccard.Rule()) if d == c]

    before, after = seen["personal_data"]
    now = {r.doc_id: r for r in after}
    assert len(now) == len(before)
    for r in before:
        if base(r.text):
            assert "<" in now[r.doc_id].text and now[r.doc_id].n_chars == len(now[r.doc_id].text)
        else:
            assert now[r.doc_id] == r

    before, after = seen["mix"]
    assert {r.text for r in after} <= {r.text for r in before} and max(Counter(r.doc_id for r in after).values()) <= 3

    before, after = seen["bpe"]
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert Counter((r.doc_id, r.n_tokens) for r in after) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
