"""SimHash fingerprints of 64 bits and the search for all within a Hamming radius, in DataFrame operations only.

Terms are the distinct runs of five words of the text in lower case (with fewer words, all of them as one term), each
weighted by how often it occurs. A term's 64-bit hash votes on every bit, its weight for a 1 and against
a 0; the fingerprint has the bits with more votes for than against. Three votes share a long, in fields of 21 bits, so a
text is counted in segments of at most SEGMENT terms, whose counts are then added.

RADIUS follows from the near copies that are wanted, five-word shingles of Jaccard similarity 0.8 or more: at 0.8 about 10 of
64 bits differ. Of the 48 pairs of different sets at 0.8 or more in sf0.1 (found exactly), 3 lie within 3 bits, 35 within 10,
46 within 13, 48 within 15.

Search: the 64 bits are cut into BLOCKS blocks, a table each. Two fingerprints within the radius differ in some block by no more
than its share (the shares add up to radius - BLOCKS + 1), so a fingerprint meets all others under the values of a block that
are as near as its share: no pair is missed. All that meet are compared exactly, and a pair is reported by the first such block only.
The share of pairs that meet is 1 in 24 for the defaults, whatever the size.

Equal fingerprints are one class, named by its fingerprint: rows carry it (membership), and ``near_pairs`` lists the pairs of classes.

Defined cases: a null or empty text (or one without words) has the fingerprint 0. The next document of the last one is
the first. Repeated rows of a doc_id: each gets a row; the next document of every one of them is the next *different* doc_id,
with the smallest text of its rows (near_next: the row of fewest characters). A null doc_id comes before all others, counts as one
id and is not distinguished from the smallest long; it is never a query of the search.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.tables import shuffle_width, store
from trafficlens.llm.textstats import let, words_of

BITS = 64
SHINGLE = 5
#: Three counters in a long: bits i, i + 21 and i + 42; bit 63 has a sum of its own.
FIELD = 21
MASK = 1 | 1 << FIELD | 1 << 2 * FIELD
SEGMENT = 1 << 20
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
RADIUS = 15
BLOCKS = 4
#: Queries broadcast at once; fingerprints of a block value are gathered in as many lists as there are times LISTED of them.
SLICE = 1 << 20
LISTED = 1 << 20


def term_hashes(text: Column) -> Column:
    """A hash per run of five words (repeats included); one for the whole of fewer words; none without words."""
    return let(
        words_of(F.lower(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < SHINGLE, F.array(F.xxhash64(w)))
        .otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))
        ),
    )


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys``, fingerprint (long) and n_rows for each key of ``texts`` (keys, text); rows of a key must have equal texts.

    One row per key votes, so a segment never adds more than SEGMENT votes to a field.
    """
    each = texts.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n_rows"))
    terms = each.select(*keys, "n_rows", F.posexplode_outer(term_hashes(F.col("text"))).alias("i", "h"))
    votes = [
        F.sum(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(MASK))).alias(f"v{s}") for s in range(FIELD)
    ] + [F.sum(F.shiftrightunsigned("h", BITS - 1)).alias("v63"), F.count("h").alias("n"), F.max("n_rows").alias("n_rows")]
    segments = terms.groupBy(*keys, F.floor(F.coalesce("i", F.lit(0)) / SEGMENT).alias("segment")).agg(*votes)
    low = (1 << FIELD) - 1

    def ones(bit: int) -> Column:
        if bit == BITS - 1:
            return F.col("v63")
        return F.shiftrightunsigned(f"v{bit % FIELD}", FIELD * (bit // FIELD)).bitwiseAND(F.lit(low))

    counted = segments.groupBy(*keys).agg(*[F.sum(ones(b)).alias(f"b{b}") for b in range(BITS)], F.sum("n").alias("n"), F.max("n_rows").alias("n_rows"))
    weight = [1 << b if b < BITS - 1 else -(1 << b) for b in range(BITS)]
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(weight[b])).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return counted.select(*keys, total.alias("fingerprint"), "n_rows")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def text_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def following(ids: DataFrame) -> DataFrame:
    """id and next_id, the following id (of the last: the first) for distinct ids, without gathering all in a task.

    Ids are dealt by ranges; inside a range the next id follows by a window, and the last of a range takes the first of
    the next range that has any.
    """
    width = shuffle_width(ids.sparkSession)
    ranged = ids.repartitionByRange(width, "id").withColumn("part", F.spark_partition_id())
    ranged = store(ranged, "id-ranges")  # the numbers of the ranges must not change between the uses below
    inside = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))  # one row per range
    ordered = Window.orderBy("part")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(ordered), F.first("first").over(whole)).alias("after"))
    return inside.join(after, "part").select("id", F.coalesce("next", "after").alias("next_id"))


def with_edited(docs: DataFrame) -> DataFrame:
    """id (doc_id, NO_ID for null), next_id, n_chars, text and edited of every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Texts are shuffled by id once (both joins use that shuffle, and all that follows per id stays in place), and the needed
    beginnings once more.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    wanted = sizes.join(following(texts.select("id").distinct()), "id").select(
        F.col("id").alias("to_id"), "next_id", F.floor(F.col("n") / 2).cast("int").alias("cut")
    )
    beginnings = (
        wanted.join(texts, F.col("next_id") == F.col("id"))
        .select("to_id", "next_id", F.substring("text", F.lit(1), F.col("cut")).alias("beginning"))
        .groupBy("to_id").agg(F.min("beginning").alias("beginning"), F.max("next_id").alias("next_id"))
    )
    joined = texts.join(beginnings, F.col("id") == F.col("to_id"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("beginning"), F.lit(1), half))
    return joined.select("id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def block_shares(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, width, share) of the blocks to look at: within ``radius``, one of them differs by at most its share."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    total = radius - blocks + 1
    shares = [(total + blocks - 1 - i) // blocks for i in range(blocks)]
    return [(lo, hi - lo, share) for lo, hi, share in zip(edges, edges[1:], shares) if share >= 0]


def near_lists(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, near): for each query, lists of the fingerprints (found, n_rows) within ``radius`` bits; two blocks at least.

    ``prints`` and ``queries`` hold distinct values in a column fingerprint, ``prints`` also n_rows. Fingerprints are gathered by block
    value, and each value looks its neighbours up among the queries, which are broadcast, a slice after the other. A list is searched
    where it stands: what lies beyond the radius never becomes a row. A fingerprint is in one list of a query.
    """
    tables = block_shares(radius, blocks)

    def value(x: Column, lo: int, width: int) -> Column:
        return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << width) - 1))

    def keys(x: Column) -> Column:
        return F.explode(F.array(*[F.lit(t << 32).bitwiseOR(value(x, lo, width)) for t, (lo, width, _) in enumerate(tables)]))

    def flips(width: int, share: int) -> str:
        masks = (sum(1 << b for b in chosen) for k in range(share + 1) for chosen in combinations(range(width), k))
        return f"array({','.join(f'{m}L' for m in masks)})"

    masks = F.expr(f"array({','.join(flips(width, share) for _, width, share in tables)})")
    lists = 1 + prints.count() // LISTED
    gathered = (
        prints.select(F.struct(F.col("fingerprint").alias("found"), "n_rows").alias("one"), keys(F.col("fingerprint")).alias("key"))
        .groupBy("key", F.pmod(F.xxhash64("one.found"), F.lit(lists)).alias("list")).agg(F.collect_list("one").alias("founds"))
        .select("founds", "key", F.explode(F.get(masks, F.shiftright("key", 32).cast("int"))).alias("mask"))
        .select("founds", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    )

    def inside(one: Column) -> Column:
        apart = F.col("query").bitwiseXOR(one["found"])
        first = F.coalesce(*[F.when(F.bit_count(value(apart, lo, width)) <= share, F.lit(t)) for t, (lo, width, share) in enumerate(tables)])
        # Only what is near enough is asked for the first of the tables in which it is met.
        return F.when(F.bit_count(apart) <= radius, first == F.shiftright("key", 32)).otherwise(False)

    def found(asked: DataFrame) -> DataFrame:
        probe = asked.select(F.col("fingerprint").alias("query"), keys(F.col("fingerprint")).alias("key"))
        met = gathered.join(F.broadcast(probe), "key").select("query", F.filter("founds", inside).alias("near"))
        return met.where(F.size("near") > 0)

    slices = 1 + queries.count() // SLICE
    if slices == 1:
        return found(queries)
    each = [store(found(queries.where(F.pmod(F.xxhash64("fingerprint"), F.lit(slices)) == i)), "near") for i in range(slices)]
    return reduce(DataFrame.union, each)


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance): all pairs of a query and a fingerprint within ``radius`` bits."""
    pairs = near_lists(prints.withColumn("n_rows", F.lit(1).cast("long")), queries, radius, blocks).select("query", F.explode("near").alias("one"))
    return pairs.select("query", F.col("one.found").alias("fingerprint"), F.bit_count(F.col("query").bitwiseXOR(F.col("one.found"))).alias("distance"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def report(docs: DataFrame) -> DataFrame:
    """id, next_id, n_chars, edited_sha256, own and edit (the two fingerprints) of every row, as a stored table."""
    both = with_edited(docs).select(
        "id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("text_hash"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t"),
    )
    keys = ["id", "next_id", "n_chars", "edited_sha256", "text_hash"]
    # Equal rows share a key, and one of them votes.
    printed = fingerprints(both.select(*keys, "t.kind", "t.text"), *keys, "kind")
    rows = printed.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edit"),
        F.max("n_rows").alias("n_rows"),
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))
    return store(rows.select(*keys, "own", "edit", each.alias("copy")).drop("copy", "text_hash"), "fingerprints")


def _near_classes(rows: DataFrame, radius: int) -> DataFrame:
    """query and the lists of near classes (found, n_rows), for the classes with an id divisible by 20."""
    by_print = rows.groupBy(F.col("own").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_rows"))
    asked = rows.where((F.col("id") % 20 == 0) & (F.col("id") != NO_ID)).select(F.col("own").alias("fingerprint")).distinct()
    return near_lists(by_print, asked, radius)


def near_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs of different classes that ``search`` counts; ``fingerprint`` of its rows tells their class."""
    pairs = _near_classes(rows, radius).select("query", F.explode("near").alias("one")).where("query <> one.found")
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("one.found"))).alias("distance")
    return pairs.select(text_of(F.col("query")).alias("fingerprint"), text_of(F.col("one.found")).alias("near_fingerprint"), apart, "one.n_rows")


def search(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Likenesses of each row of ``report``; n_near: for ids divisible by 20, the other rows within ``radius`` bits."""
    found = _near_classes(rows, radius)
    in_list = F.aggregate("near", F.lit(0).cast("long"), lambda total, one: total + one["n_rows"])
    n_near = found.groupBy("query").agg((F.sum(in_list) - 1).alias("n_near"))
    # Joined by id, which spreads the rows, and not by a fingerprint that most rows do not ask about.
    asking = rows.where((F.col("id") % 20 == 0) & (F.col("id") != NO_ID)).select(F.col("id").alias("asking"), F.col("own").alias("asked")).distinct()
    answers = asking.join(n_near, F.col("asked") == F.col("query")).select("asking", "asked", "n_near")
    next_print = rows.groupBy(F.col("id").alias("after_id")).agg(F.min(F.struct("n_chars", "own")).alias("x")).select("after_id", F.col("x.own").alias("after"))
    return (
        rows.join(next_print, F.col("next_id") == F.col("after_id"))
        .join(answers, (F.col("id") == F.col("asking")) & (F.col("own") == F.col("asked")), "left")
        .select(
            F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256",
            text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edit")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
            "n_near",
        )
    )
