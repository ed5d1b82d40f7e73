from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from trafficlens.llm import fingerprints as fp


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]

    def spark_hash(run):
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return h

    runs = [words] if 0 < len(words) < 5 else [words[i : i + 5] for i in range(len(words) - 4)]
    hashes = [spark_hash(r) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_report_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    own = {i: brute(texts[i]) for i in ids}
    rows = {r.doc_id: r for r in fp.search(fp.report(docs)).collect()}
    assert sorted(rows) == ids
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, r = texts[i], rows[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (f"{own[i]:016x}", f"{brute(edited):016x}")
        assert r.near_edited == 1 - (own[i] ^ brute(edited)).bit_count() / 64
        assert r.near_next == 1 - (own[i] ^ own[after]).bit_count() / 64
        assert r.n_near == (None if i % 20 else sum((own[i] ^ x).bit_count() <= fp.RADIUS for x in own.values()) - 1)


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for k in range(6):
            for bit in rng.sample(range(64), k):
                p ^= 1 << bit
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    for radius, blocks in ((0, 2), (2, 4), (3, 5), (3, 6)):
        got = {(r.query, r.fingerprint, r.distance) for r in fp.near(df, df.limit(50), radius, blocks).collect()}
        asked = {r.fingerprint for r in df.limit(50).collect()}
        want = {(q, p, ((q ^ p) & (2**64 - 1)).bit_count()) for q in asked for p in signed}
        assert got == {w for w in want if w[2] <= radius}


def test_odd_inputs(odd_docs, no_docs):
    rows = fp.search(fp.report(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{brute(texts[r.doc_id]):016x}" and r.n_chars == len(texts[r.doc_id] or "")
    assert len({(r.fingerprint, r.edited_fingerprint) for r in rows if r.doc_id == 6}) == 1
    assert fp.search(fp.report(no_docs)).count() == 0
    one = fp.search(fp.report(odd_docs.where("doc_id = 5"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_near_copies_of_jaccard_08_are_found(spark):
    """Texts of 400 words with 8 words changed, ten apart or more: 8 * 5 of 396 shingles differ, a similarity of 0.816."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(400)]
        changed = list(words)
        for place in range(20, 400, 48):
            changed[place] = word()
        rows += [(20 * i, " ".join(words)), (20 * i + 1, " ".join(changed))]
    report = fp.report(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r.doc_id: (r.fingerprint, r.n_near) for r in fp.search(report).collect()}
    pairs = {(r.fingerprint, r.near_fingerprint): (r.distance, r.n_rows) for r in fp.near_pairs(report).collect()}
    hits = sum((of[20 * i][0], of[20 * i + 1][0]) in pairs for i in range(60))
    assert hits >= 54
    assert sum(of[20 * i][1] for i in range(60)) == sum(n for _, n in pairs.values())
    assert all(d == (int(a, 16) ^ int(b, 16)).bit_count() <= fp.RADIUS for (a, b), (d, _) in pairs.items())


def test_wide_radius_in_slices_loses_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for k in (5, 12, 15, 16):
            q = p
            for bit in rng.sample(range(64), k):
                q ^= 1 << bit
            prints.append(q)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    monkeypatch.setattr(fp, "SLICE", 100)
    monkeypatch.setattr(fp, "LISTED", 50)
    got = [(r.query, r.fingerprint, r.distance) for r in fp.near(df, df).collect()]
    want = {(q, p, ((q ^ p) & (2**64 - 1)).bit_count()) for q in signed for p in signed}
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[2] <= fp.RADIUS}


def test_many_equal_rows_of_a_key_do_not_overflow_the_counters(spark):
    """2,400 equal rows of 2,000 words: 4.8 million votes in one key, more than 2^22."""
    rng = random.Random(9)
    text = " ".join(str(rng.random()) for _ in range(2000))
    rows = spark.range(2400).select(F.lit(None).cast("long").alias("id"), F.lit(text).alias("text"))
    (r,) = fp.fingerprints(rows, "id").collect()
    assert (r.fingerprint % 2**64, r.n_rows) == (brute(text), 2400)
