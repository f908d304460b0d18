"""Operators 1 and 4 against the library, on odd texts and the test table."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalith.llm.bpe_codec import bpe_round_trip
from catalith.llm.queries import tokenizer_path
from catalith.llm.token_counts import TokenIndex, count_tokens
from tests.conftest import SF

ALPHABET = "aebcdéß's t'relm 12²<|>endofx́İΣσςЖ日😀\n\t\x85‍_-."


def odd_texts():
    rng = random.Random(1)
    fixed = [None, "", "  ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "I'Re we'LL", "日本語 テスト", "😀👍🏽 x", "\x00\x1f\x85 a", "''s 'tis", "<|end", "x" * 3000, "ﬁ ǅ ß ẞ", "word " * 30_000]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, and columns whose names clash with the results'."""
    odd = [(10**6 + i, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame([*odd, odd[4]], "doc_id long, text string")
    return df.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).selectExpr("*", "'x' AS n_tokens", "1 AS block", "2 AS ids")


def test_counts(docs):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = count_tokens(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.over_limit:
            assert len(tok.encode(texts[r.doc_id][: r.fit_chars], add_special_tokens=False).ids) <= 2048


def test_every_prefix_of_words():
    path = tokenizer_path("word_bpe_49k.json")
    index, tok = TokenIndex(path), Tokenizer.from_file(path)
    for word in ("understandableness", "xyzzyqwert", "ünïcödé"):
        raw = word.encode()
        counts = index.table.ended(word)
        for i in range(len(raw) + 1):
            try:
                head = raw[:i].decode()
            except UnicodeDecodeError:
                continue
            assert counts[i] == len(tok.encode(head, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_prefix_of_texts(name):
    index, tok = TokenIndex(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    texts = ["Hello brave new world, it's 2024.", "we'RE  here \n\n now!'re 're", "   lead", "trail   ", "", "xyzzyqwertunbroken" * 4, "日本語テスト と x", "a<|endoftext|>b c", "İx ß"]
    for text in texts:
        prefixes = index.counted(text)
        want = [count(text[:i]) for i in range(len(text) + 1)]
        assert [prefixes.count(i) for i in range(len(text) + 1)] == want and prefixes.count() == want[-1]
        for budget in range(max(want) + 2):
            fit = prefixes.fit(budget)
            assert want[fit] <= budget
            if prefixes.exact and name.startswith("word"):
                assert fit == max(i for i, n in enumerate(want) if n <= budget)


def test_unbroken_texts_fit_in_part():
    index = TokenIndex(tokenizer_path("word_bpe_49k.json"))
    for text in ("abcdefghij" * 2000, "日本語" * 3000, "x" * 20_000):
        fit = index.counted(text).fit(2048)
        assert 0 < fit and 2000 < index.count(text[:fit]) <= 2048


def test_small_caches_give_the_same(monkeypatch):
    from catalith.llm import token_counts

    path, texts = tokenizer_path("word_bpe_49k.json"), [f"some words w{i} and x{i} again" for i in range(50)]
    want = [TokenIndex(path).count(t) for t in texts]
    monkeypatch.setattr(token_counts, "CACHED_BYTES", 1000)
    index = TokenIndex(path)
    assert [index.count(t) for t in texts] == want and len(index.counts) < 20


def test_codec(docs):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False).encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    got = bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_codec_gives_ids_and_text(spark):
    df = spark.createDataFrame([(1, "Round trip: ünïcödé 日本 😀"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe_round_trip(df, tokenizer_path("byte_bpe_50k.json"), digests=False).collect()}
    assert rows[1].text.decode() == "Round trip: ünïcödé 日本 😀" and len(rows[1].ids) == 4 * rows[1].n_tokens
    assert rows[2].n_tokens == 0 and bytes(rows[2].ids) == b""


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert bpe_round_trip(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_small_blocks_give_the_same(spark, docs, monkeypatch):
    from catalith.llm import bpe_codec

    want = sorted(map(tuple, bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json")).collect()))
    monkeypatch.setattr(bpe_codec, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 50)
    monkeypatch.setattr(bpe_codec, "TOGETHER", 1)
    for f in (bpe_codec.blocks, bpe_codec.word_positions):
        assert f.__module__ == "catalith.llm.bpe_codec"
    assert sorted(map(tuple, bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json")).collect())) == want
