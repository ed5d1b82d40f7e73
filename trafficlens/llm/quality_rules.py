"""Quality rules whose cutoffs are certified on labelled documents.

Every rule rejects a document whose score (larger is worse) exceeds a cutoff. For each stratum (language) and rule the
grid of cutoffs is walked from the most lenient one on; a cutoff is certified while the exact binomial tail
``P(Bin(good, alpha) <= rejected good)`` stays at or below ``delta / (strata * rules)``. That is fixed-sequence testing inside
a rule and a Bonferroni correction across strata and rules, so with probability ``1 - delta`` every rule in every
stratum rejects at most a share ``alpha`` of the good documents, and all rules together at most ``rules * alpha``.
The strictest certified cutoff is used; a rule without one rejects nothing.

Every stratum stands on its own evidence. Those with too few good documents for any certificate are not tested, count in no
correction and reject nothing: of the strata by falling number of good documents, the r-th is tested if no rejection at all
would pass among r, ``(1 - alpha) ** good <= delta / (r * rules)``. That looks at the numbers of good documents alone, never at their scores.

Defined cases: a null or empty text has no words and fails the base rules. A null label or language is no label, or
the stratum ''. Repeated label rows of a document count once, as good only if all of them are 1. Repeated document
rows are judged one by one. Without labels only the base rules reject. Other columns are ignored or handed through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.textstats import text_stats

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Cutoffs of each rule, most lenient first.
GRID = {
    "symbols": (1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15),
    "repeats": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25),
    "dup_lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "shouting": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "marks": (1.0, 0.75, 0.5, 0.4, 0.3, 0.2),
    "sameness": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7),
}
ALPHA = 0.005
DELTA = 0.05
#: Terms of the binomial tail that are summed one by one; what is left is bounded by a geometric series.
TAIL_TERMS = 2000


def rule_scores(s: Column) -> Column:
    """A struct with one score per rule, from a ``text_stats`` struct."""

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return F.struct(
        ratio(s["n_symbols"], s["n_words"]).alias("symbols"),
        ratio(s["n_repeat_words"], s["n_words"]).alias("repeats"),
        ratio(s["n_dup_lines"], s["n_lines"]).alias("dup_lines"),
        ratio(s["n_upper"], s["word_chars"]).alias("shouting"),
        ratio(s["n_marks"], s["n_words"]).alias("marks"),
        ratio(s["n_words"] - s["n_distinct"], s["n_words"]).alias("sameness"),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _ln_factorial(x: Column) -> Column:
    """Exact up to 20, then Stirling's series, whose error there is below 1e-12."""
    y = x.cast("double")
    small = F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))
    large = y * F.ln(y) - y + F.ln(2 * F.pi() * y) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return F.when(x <= 20, small).otherwise(large)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)``; 1 where k is not below the mean (such a cutoff can never be certified)."""
    k, n = k.cast("long"), n.cast("long")
    log_term = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    odds = (1 - p) / p
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TAIL_TERMS).cast("long"))),
        F.struct(F.exp(log_term).alias("term"), F.lit(0.0).alias("total"), F.lit(0.0).alias("ratio")),
        lambda acc, i: F.struct(
            (acc["term"] * ((k - i) * odds / (n - k + i + 1))).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
            ((k - i) * odds / (n - k + i + 1)).alias("ratio"),
        ),
        lambda acc: acc["total"] + acc["term"] / (1 - acc["ratio"]),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(summed, F.lit(1.0)))


def _is_above() -> Column:
    """(rule, score, number of the rule's cutoffs that the score exceeds) for each rule."""
    return F.array(*[
        F.struct(
            F.lit(rule).alias("rule"),
            sum((F.col(f"scores.{rule}") > c).cast("int") for c in cutoffs).alias("above"),
        )
        for rule, cutoffs in GRID.items()
    ])


def calibrate(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum, rule, n_good, n_rejected, p_value, cutoff; one row per stratum and certified rule.

    ``scored`` holds doc_id, stratum, failed (by the base rules) and scores. Only good documents that pass the base rules count.
    """
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("good")).where("good = 1").select("doc_id")
    )
    holdout = scored.where(~F.col("failed")).join(good, "doc_id").select("stratum", F.explode(_is_above()).alias("r"))
    levels = holdout.groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.above").alias("above")).agg(F.count(F.lit(1)).alias("n"))
    counted = levels.groupBy("stratum", "rule").agg(F.collect_list(F.struct("above", "n")).alias("levels"), F.sum("n").alias("n_good"))

    def may_pass(n_tests: Column | int) -> Column:
        return F.col("n_good") * F.log1p(F.lit(-alpha)) <= F.log(F.lit(delta) / n_tests)

    # Windows of a rule see one row per stratum, and only strata with some hundreds of labels each (956 at the defaults).
    by_size = Window.partitionBy("rule").orderBy(F.desc("n_good"))
    sized = counted.where(may_pass(len(GRID))).withColumn("rank", F.count(F.lit(1)).over(by_size))
    tested = sized.where(may_pass(F.col("rank") * len(GRID))).withColumn("n_tests", F.count(F.lit(1)).over(Window.partitionBy("rule")) * len(GRID))
    grid = F.create_map(*[x for rule, cutoffs in GRID.items() for x in (F.lit(rule), F.array(*map(F.lit, cutoffs)))])
    tests = (
        tested.select("stratum", "rule", "levels", "n_good", "n_tests", F.posexplode(grid[F.col("rule")]).alias("j", "cutoff"))
        # The cutoffs fall, so a score above the j-th is above all that follow: above len - j cutoffs at least.
        .withColumn("least", F.size(grid[F.col("rule")]) - F.col("j"))
        .withColumn("n_rejected", F.aggregate(F.filter("levels", lambda x: x["above"] >= F.col("least")), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    )
    passed = tests.withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha)).where(F.col("p_value") <= F.lit(delta) / F.col("n_tests"))
    best = F.max_by(F.struct("n_good", "n_rejected", "p_value", "cutoff"), "j").alias("best")
    return passed.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "best.*")


def judge(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``scored`` with ``rejected_by`` (names of the rules that reject, in the order of GRID) and ``kept``.

    ``cutoffs`` has a row for each certified rule of a stratum; Spark broadcasts it if it is as small as its files say.
    """
    own = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    joined = scored.join(own, "stratum", "left")
    rejecting = F.array_compact(F.array(*[
        F.when(F.col(f"scores.{rule}") > F.col("limits")[rule], F.lit(rule)) for rule in GRID
    ]))
    return (
        joined.withColumn("rejected_by", F.array_join(rejecting, ","))
        .withColumn("kept", ~F.col("failed") & (F.col("rejected_by") == ""))
        .drop("limits")
    )


def score(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, stratum, stats, failed, scores and the columns of ``keep`` for every row of ``docs``."""
    stats = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text_stats(F.col("text")).alias("stats"), *keep)
    return stats.withColumn("failed", base_failed(F.col("stats"))).withColumn("scores", rule_scores(F.col("stats")))
