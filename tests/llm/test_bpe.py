from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from test_packing import library_ids

from trafficlens.llm import bpe, tokens

PIECES = ["the ", "The", "don't ", "it's", "Ångström ", "é", "é", "́", "𝔘😀", "123", "!!", "...", ".", ",", "\n", "\t", "\xa0", " ",
          "\x1c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "İ", "ΣΑΣ ", "ﬁ", "日本語", "a" * 30, "x-y_z", "'s", "J̌", " "]


def texts(seed, n=150, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_words_encode_as_whole_texts(seed):
    own = texts(seed)
    got = list(tokens.WordEncoder(tokens.vocabulary()).encode(own))
    assert got == [ids.tobytes() for ids in library_ids(own)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 300)
    monkeypatch.setattr(tokens, "NEAR_BYTES", 300)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    own = texts(9)
    got = list(tokens.WordEncoder(tokens.vocabulary()).encode(own))
    assert got == [ids.tobytes() for ids in library_ids(own)]


def test_long_and_plain_texts(monkeypatch):
    """Texts of plain letters take the way of columns; long ones are cut between words."""
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 40)
    rng = random.Random(4)
    own = ["".join(rng.choices(["The ", "Über", "ß. ", "don't", ", ", "a.b", "x..", "\t", "\x0b", "12", "ÀÉ, "], k=k)) for k in range(80)]
    got = list(tokens.WordEncoder(tokens.vocabulary()).encode([*own, None, *texts(3, 30)]))
    assert got == [ids.tobytes() for ids in library_ids([*own, "", *texts(3, 30)])]


@pytest.mark.parametrize("seed", range(3))
def test_joins_are_repaired_wherever_the_cuts_are(seed):
    """Cuts anywhere between two characters, also inside words."""
    rng = random.Random(seed)
    encoder = tokens.WordEncoder(tokens.vocabulary())
    for text in texts(seed + 50, 80):
        if tokens.ODD_SPACE.search(text):
            continue
        edges = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randint(0, 8)))})
        parts, at = [], 0
        for a, b in zip(edges, edges[1:]):
            parts.append((at, encoder.short(text[a:b])))
            at += len(text[a:b].encode())
        assert bpe.join(encoder, text.encode(), parts) == encoder.whole(text)


def test_equal_passages_are_cut_alike():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000))
    one, two = set(bpe.chunks(passage)), set(bpe.chunks("something else before it " + passage + " and after"))
    assert len(one & two) >= len(one) - 2 and len(one) > 10
    assert b"".join(bpe.chunks(passage)) == passage.encode() and bpe.chunks("") == [b""]


def check(rows, docs):
    encoder = tokens.WordEncoder(tokens.vocabulary())
    want = []
    for doc_id, text in docs:
        ids = encoder.whole(text or "")
        decoded = encoder.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_documents(spark, odd_docs, no_docs, small):
    passages = "".join(texts(70, 30, 200))
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(i, f"start {i} {passages} end {i}") for i in range(20)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert bpe.shared_ids(docs, tokens.vocabulary())
    check(bpe.digests(bpe.encode(docs)).collect(), rows)
    check(bpe.report(docs).collect(), rows)
    assert bpe.digests(bpe.encode(no_docs)).count() == 0


def test_the_shared_table_is_bounded(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    all_ids = bpe.shared_ids(docs, tokens.vocabulary())
    few = bpe.shared_ids(docs, tokens.vocabulary(), 4000)
    assert len(few) < len(all_ids) and sum(map(len, few.values())) < sum(map(len, all_ids.values()))
    check(bpe.digests(bpe.encode(docs, shared_bytes=4000)).collect(), [(i, text) for i in range(4)])
