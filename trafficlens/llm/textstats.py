"""Statistics of a text as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Names and types of the fields of ``text_stats``.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_sentences",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas an inlined column would be computed per element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lines_of(text: Column) -> Column:
    """Lines (cut at line feeds) that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of eight words found at least twice in the text.

    Windows are compared by a 64-bit hash. Sorting (hash, position) brings equal windows together; their sorted
    positions then cover ``min(8, distance to the previous one)`` new words each.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
    )

    def covered(sorted_windows: Column) -> Column:
        repeated = F.filter(
            sorted_windows,
            lambda x, i: (F.get(sorted_windows, i - 1)["h"] == x["h"]) | (F.get(sorted_windows, i + 1)["h"] == x["h"]),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            F.array_sort(F.transform(repeated, lambda x: x["i"])),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, count))


def text_stats(text: Column) -> Column:
    """A struct of FIELDS (all long) for a text; a null text counts as empty, all fields 0."""
    text = F.coalesce(text, F.lit(""))
    by_word = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    by_line = let(
        lines_of(text),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    whole = F.struct(
        count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("[!?]").alias("n_marks"),
        count("[0-9]").alias("n_digits"),
        count(r"\.").alias("n_sentences"),
    )
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l"), whole.alias("t")),
        lambda s: F.struct(*[
            s["l" if f in ("n_lines", "n_dup_lines") else "w" if f in ("n_words", "word_chars", "n_repeat_words", "n_distinct") else "t"][f].alias(f)
            for f in FIELDS
        ]),
    )
