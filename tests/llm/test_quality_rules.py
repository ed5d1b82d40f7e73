"""Base statistics against plain Python, exact binomial tails, certified cutoffs, odd inputs."""

from __future__ import annotations

import re
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from trafficlens.llm import quality_rules as rules
from trafficlens.llm.textstats import text_stats


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd_docs, small):
    docs = odd_docs.select("text").union(spark.read.parquet(f"{small}/documents.parquet").select("text"))
    got = docs.select("text", text_stats(F.col("text")).alias("s")).collect()
    for row in got:
        s = row["s"]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute(row["text"])


def test_repeats_that_overlap(spark):
    texts = ["a " * 30, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "a b c d e f g h"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", text_stats(F.col("text")).alias("s")).collect()
    assert all(r["s"].n_repeat_words == brute(r["text"])[4] for r in rows)


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 10, 300, 1300) for k in (0, 1, 3, 5) if k <= n for p in (0.005, 0.02)]
    for p in (0.005, 0.02):
        own = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(own, "k long, n long")
        for row in df.select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            f = Fraction(str(p))
            exact = float(sum(comb(row.n, i) * f**i * (1 - f) ** (row.n - i) for i in range(row.k + 1)))
            assert abs(row.t - exact) < 1e-9 if row.k < row.n * p else row.t == 1.0


NAMES = list(rules.GRID)
SCORED = f"doc_id long, stratum string, failed boolean, scores struct<{','.join(f'{n}:double' for n in NAMES)}>, quality int"


def with_scores(i, stratum, good, **scores):
    return (i, stratum, False, tuple(scores.get(n, 0.0) for n in NAMES), int(good))


def brute_cutoffs(rows):
    """(stratum, rule): the strictest cutoff reached by the walk, with exact fractions."""
    sizes = {}
    for _, stratum, _, _, good in rows:
        sizes[stratum] = sizes.get(stratum, 0) + good
    alpha, delta = Fraction(str(rules.ALPHA)), Fraction(str(rules.DELTA))
    own = [s for s, n in sizes.items() if n and (1 - alpha) ** n <= delta / (len(NAMES) * sum(m >= n for m in sizes.values()))]
    out = {}
    for stratum in own:
        n = sizes[stratum]
        for at, rule in enumerate(NAMES):
            for cutoff in rules.GRID[rule]:
                k = sum(r[3][at] > cutoff for r in rows if r[1] == stratum and r[4])
                tail = sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) if k < n * alpha else 1
                if tail > delta / (len(own) * len(NAMES)):
                    break
                out[stratum, rule] = cutoff
    return out


def test_cutoffs_keep_their_promise(spark):
    """One rule separates, another would reject too many good documents, a stratum is too small."""
    rows = []
    for i in range(3000):
        good, lang = i % 3 > 0, "big" if i < 2900 else "tiny"
        rows.append(with_scores(i, lang, good, symbols=0.0 if good else 0.9, repeats=0.35 if i % 10 == 1 else 0.0))
    df = spark.createDataFrame(rows, SCORED)
    cutoffs = rules.calibrate(df.drop("quality"), df.select("doc_id", "quality"))
    table = {(r.stratum, r.rule): r for r in cutoffs.collect()}
    assert table["big", "symbols"].cutoff == min(rules.GRID["symbols"]) and table["big", "symbols"].n_rejected == 0
    assert table["big", "repeats"].cutoff == 0.4  # below it, a tenth of the good ones would go
    assert {stratum for stratum, _ in table} == {"big"}  # 66 good ones certify nothing
    kept = {r.doc_id: r.kept for r in rules.judge(df.drop("quality"), cutoffs).collect()}
    assert all(kept[i] == (i % 3 > 0 or i >= 2900) for i in range(3000))


def test_strata_stand_on_their_own(spark):
    """Two strata certified apart, one tested without a certified rule, and small ones that together would have been enough."""
    rows = []
    for stratum, n in (("a", 3000), ("b", 2400), ("none", 1800), ("edge", 1000), *((f"s{k}", 400) for k in range(6))):
        for j in range(n):
            good = j % 4 > 0
            bad_for = {"a": "symbols", "b": "marks"}.get(stratum, "symbols")
            scores = {bad_for: 0.0 if good else 2.0, "sameness": 0.97 if good and j % 50 == 1 else 0.0}
            rows.append(with_scores(len(rows), stratum, good, **(scores if stratum != "none" else dict.fromkeys(NAMES, 2.0))))
    df = spark.createDataFrame(rows, SCORED)
    cutoffs = rules.calibrate(df.drop("quality"), df.select("doc_id", "quality"))
    assert {(r.stratum, r.rule): r.cutoff for r in cutoffs.collect()} == brute_cutoffs(rows)
    assert {r.stratum for r in cutoffs.collect()} == {"a", "b"}
    judged = rules.judge(df.drop("quality"), cutoffs).groupBy("stratum").agg(F.sum((~F.col("kept")).cast("int")).alias("n")).collect()
    assert {r.stratum: r.n for r in judged if r.n} == {"a": 750, "b": 600}


def test_odd_inputs(odd_docs, no_docs, labels):
    scored = rules.score(odd_docs)
    judged = rules.judge(scored, rules.calibrate(scored, labels)).collect()
    assert len(judged) == odd_docs.count()
    assert all(not r.kept for r in judged if r.stats.n_words < 20)
    empty = rules.score(no_docs)
    assert rules.judge(empty, rules.calibrate(empty, labels)).count() == 0
