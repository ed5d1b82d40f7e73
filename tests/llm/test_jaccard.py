"""Signature trees and the whole join against brute force, with blocks small enough that large groups are split."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from trafficlens.llm import jaccard, sigtree
from trafficlens.llm.components import components


def brute_sets(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    """component of each row, by comparing all pairs of different sets"""
    sets = {}
    for k, (_, text) in enumerate(rows):
        sets.setdefault(frozenset(brute_sets(text)), []).append(k)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for own, places in sets.items():
        for k in places[1:] if own else []:
            parent[root(k)] = root(places[0])
    for a, b in combinations([s for s in sets if s], 2):
        common = len(a & b)
        if 100 * common >= 80 * (len(a) + len(b) - common):
            parent[root(sets[a][0])] = root(sets[b][0])
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(k)] = min(doc_id, smallest.get(root(k), doc_id))
    return sorted(((d, len(brute_sets(t)), smallest.get(root(k))) for k, (d, t) in enumerate(rows)), key=repr)


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_copies(rng, n_bases=12, n_copies=14):
    """Bases, copies with a few words changed, and texts that share a long passage and little else."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(n_bases):
        words = [word() for _ in range(rng.choice([6, 30, 60, 200]))]
        for _ in range(n_copies):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                new[rng.randrange(len(new))] = word()
            rows.append(" ".join(new))
        rows += [" ".join(passage + [word() for _ in range(rng.randint(5, 90))]) for _ in range(4)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_links_of_all_pairs(seed):
    rng = random.Random(seed)
    sets = list({jaccard.set_id(s): s for _, t in near_copies(rng) if len(s := jaccard.shingles(t))}.values())
    want = sigtree.Links(len(sets))
    for i, j in combinations(range(len(sets)), 2):
        if sigtree.similar(sets[i], sets[j]):
            want.add(i, j)
    assert sigtree.link_all(sets).roots().tolist() == want.roots().tolist()
    assert sigtree.link_all(sets, first=3).roots().tolist() == want.roots().tolist()
    hosts, visitors = np.arange(len(sets))[::2], np.arange(len(sets))[1::2]
    between = sigtree.Links(len(sets))
    for i in hosts.tolist():
        for j in visitors.tolist():
            if sigtree.similar(sets[i], sets[j]):
                between.add(i, j)
    assert sigtree.link_between(sets, hosts, visitors).roots().tolist() == between.roots().tolist()


def test_shingles_hash_as_sets():
    for text in ("", "a", "a b c d", "a b c d e", "A B c d e f a b c d e f", "x " * 40):
        assert len(jaccard.shingles(text)) == len(brute_sets(text))
    assert (jaccard.shingles("The QUICK brown fox jumps") == jaccard.shingles("the\tquick\nbrown fox  jumps")).all()
    assert jaccard.shingles("É a b c d").tolist() != jaccard.shingles("é a b c d").tolist()


@pytest.mark.parametrize("block_sets", [1024, 8])
def test_join_against_brute_force(spark, monkeypatch, block_sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(jaccard, "MIN_HOT", 16 if block_sets > 100 else 4)
    rows = near_copies(random.Random(11), 8, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(jaccard.link(docs)) == brute_components(rows)


def test_one_large_group_in_many_blocks(spark, monkeypatch):
    """Near copies of near copies: a chain that only sets apart from the rep hold together."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(60):
        words[step % 100] = f"new{step}"
        rows.append((step * 3, " ".join(words)))
    rows += [(1000 + i, " ".join(words[:50] + [f"other{i}x{j}" for j in range(i)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(jaccard.link(docs)) == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (60, 61), (62, 61)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50, 60: 60, 61: 60, 62: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_inputs(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert collected(jaccard.link(odd_docs)) == brute_components(rows)
    assert jaccard.link(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_signatures_keep_every_link(seed):
    sets = list({jaccard.set_id(s): s for _, t in near_copies(random.Random(seed + 20)) if len(s := jaccard.shingles(t))}.values())
    roots = sigtree.candidates([sigtree.signature(s) for s in sets], np.array([len(s) for s in sets])).roots()
    exact = sigtree.link_all(sets).roots()
    for i, j in combinations(range(len(sets)), 2):
        assert exact[i] != exact[j] or roots[i] == roots[j]
    assert len(np.unique(roots)) > len(sets) / 20  # and do not keep all


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" * k for a in "abcé" for b in "xyz0" for k in (1, 2, 5, 40)] + ["a" * 100, "a" * 101]
    raw = "  ".join(words * 2).encode()
    found = jaccard.word_hashes(b"\n" + raw + b" ")
    assert len(set(found.tolist())) == len(set(words)) and found[: len(words)].tolist() == found[len(words) :].tolist()
    assert len(jaccard.word_hashes(b" \t ")) == 0
    long = ("word " * 40_000).encode()
    assert len(set(jaccard.word_hashes(long).tolist())) == 1
