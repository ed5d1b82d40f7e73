from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trafficlens.llm import packing, tokens


def library_ids(texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_limit_holds(rule):
    rng = np.random.default_rng(1)
    lengths = -np.sort(-rng.integers(1, 100, 3000))
    limits = dict(max_tokens=100, max_documents=6, max_attention=6000)
    fit = lengths[lengths**2 <= 6000]
    sequence, offset = packing.best_fit(fit, rule=rule, **limits)
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        sizes = fit[own]
        assert sizes.sum() <= 100 and len(own) <= 6 and (sizes**2).sum() <= 6000
        order = np.argsort(offset[own])
        assert (offset[own][order] == np.concatenate([[0], np.cumsum(sizes[order])[:-1]])).all()


def test_best_fit_takes_the_tightest_sequence():
    sequence, offset = packing.best_fit(np.array([60, 50, 40, 30, 20]), max_tokens=100)
    assert sequence.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 60, 50, 80]


def test_documents_against_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = packing.pack_documents(docs).collect()
    want = {}
    for row, ids in zip(rows, library_ids([r.text for r in rows])):
        ids = np.append(ids, [1]).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[row.doc_id, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    check_sequences(got)
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 4096 * 1.02 + 1


def check_sequences(rows, most=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most


def test_groups_and_odd_inputs(odd_docs, no_docs):
    cut = packing.store(packing.pieces(odd_docs, tokens.vocabulary(), 64), "pieces")
    for group in (3, 1000):
        rows = packing.pack(cut, group=group, max_tokens=64, max_documents=5).collect()
        assert len(rows) == cut.count()
        check_sequences(rows, 64)
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 6 and r.piece == 0 for r in rows) == 2
    assert packing.pack_documents(no_docs).count() == 0


def test_a_block_costs_its_own_words_and_hashes_only_lead_to_words(monkeypatch):
    rng = np.random.default_rng(3)
    drawn = ["".join(w) for w in rng.choice(list("abcdéñ"), (3000, 5)).tolist()]
    texts = [" ".join(drawn), "one, two. three " + drawn[0], " " + drawn[7], ""]
    want = [ids.tobytes() for ids in library_ids(texts)]
    encoder = tokens.WordEncoder(tokens.vocabulary())
    assert list(encoder.encode(texts)) == want
    hashed, plain = [], tokens._hashes
    monkeypatch.setattr(tokens, "_hashes", lambda words: hashed.append(len(words)) or plain(words))
    assert list(encoder.encode(texts[1:])) == want[1:] and sum(hashed) < 12
    monkeypatch.setattr(tokens, "_hashes", lambda words: np.full(len(words), 5, np.uint64))
    alike = tokens.WordEncoder(tokens.vocabulary())
    assert list(alike.encode(texts)) == want and list(alike.encode(texts[::-1])) == want[::-1]
