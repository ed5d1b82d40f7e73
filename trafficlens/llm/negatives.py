"""Hard negatives of vectors, scored exactly by matrix products in a residue number system.

Components are whole numbers. They are reduced modulo a few small primes to residues around zero, the residue matrices are multiplied
in float32 (every sum stays below 2^24, so each product is exact), and the signed scores are put together from the products' remainders
by the Chinese remainder theorem. As many primes are taken as the largest possible score needs, which follows from the largest norm.

Anchors go in blocks of bounded size, each of which is sent to all tasks and meets all rows twice: the first pass finds the positives of
each anchor, the second, knowing their scores, its negatives. A task keeps only the best few partners of each anchor of the block; windows
over these choose the final ones. Nothing else leaves a task, so neither copies of one vector nor a common label fill any group.

Given results: rows with a missing label, vector or component, or one that is not finite, take no part, as do rows without components.
A row without an id is never an anchor; as a partner it comes after all others of its score (the largest long stands for its id inside).
Of vectors of different lengths the shorter one counts as filled up with zeros. Repeated rows are rows of their own, also beside an anchor
with the same id. An empty table gives no rows. Other columns are not looked at. Vectors so long that a score may not fit into
56 bits are an error, as a hundred times a score could not be stated in longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.tables import fresh_path, store

#: Primes are taken from below this number; their residues are smaller than half of it.
PRIME_LIMIT = 512
#: Whole numbers up to this size are exact in float32.
EXACT = 1 << 24
#: Components of the anchors of one block.
BLOCK_COMPONENTS = 1 << 22
#: Scores that a task holds at once.
CELLS = 1 << 22
SCORE_BITS = 56
NO_ID = (1 << 63) - 1
NONE = -(1 << 62)


def primes(bound: int) -> list[int]:
    """The largest primes below the limit whose product exceeds twice ``bound``, so that signed values up to it are told apart."""
    found, product = [], 1
    for p in range(PRIME_LIMIT - 1, 2, -1):
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
            if product > 2 * bound:
                return found
    raise ValueError(f"scores up to {bound} need more primes than there are below {PRIME_LIMIT}")


def residues(values: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """One float32 matrix per prime, with residues from -(p-1)/2 to (p-1)/2."""
    return [((values + p // 2) % p - p // 2).astype(np.float32) for p in moduli]


def _product(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left times right transposed, modulo p; columns are cut so that each float32 sum is exact."""
    width = EXACT // (p // 2) ** 2
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, left.shape[1], width):
        total += (left[:, at : at + width] @ right[:, at : at + width].T).astype(np.int64)
    return total % p


def scores(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The exact signed inner products, digit by digit in the mixed radix of the primes.

    Digits are at most p-1 and the value before centring is below the product of the primes. That may pass 63 bits where a score does
    not; sums then wrap around and the final subtraction wraps back, so the result is the score.
    """
    digits: list[np.ndarray] = []
    total, radix = np.zeros((len(left[0]), len(right[0])), dtype=np.uint64), 1
    for k, p in enumerate(moduli):
        digit = _product(left[k], right[k], p)
        for q, known in zip(moduli[:k], digits, strict=True):
            digit = (digit - known) * pow(q, -1, p) % p
        digits.append(digit)
        total += digit.astype(np.uint64) * np.uint64(radix % (1 << 64))
        radix *= p
    # Above half of the range a value stands for a negative score. The leading digits tell; compare from the last digit down.
    half, negative, undecided = (radix - 1) // 2, np.zeros(total.shape, dtype=bool), np.ones(total.shape, dtype=bool)
    limits, rest = [], half
    for p in moduli:
        limits.append(rest % p)
        rest //= p
    for digit, limit in zip(reversed(digits), reversed(limits), strict=True):
        negative |= undecided & (digit > limit)
        undecided &= digit == limit
    total[negative] -= np.uint64(radix % (1 << 64))
    return total.view(np.int64)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part, stored: row_no, vec_id, label, parts (components times ``scale``, rounded down)."""
    x = F.col("embedding")
    usable = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    parts = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    kept = vectors.where(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(usable)
    names = [F.col(c).cast("long") for c in ("vec_id", "label")]
    return store(kept.select(F.monotonically_increasing_id().alias("row_no"), *names, parts.alias("parts")), "whole-vectors")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The components of a batch as one matrix, shorter vectors filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and lengths.min() == lengths.max() == width:
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class _Best:
    """The first ``size`` partners of each line, by falling score, then rising id."""

    def __init__(self, lines: int, size: int):
        self.score = np.full((lines, size), NONE, dtype=np.int64)
        self.id = np.full((lines, size), NO_ID, dtype=np.int64)
        self.row = np.full((lines, size), -1, dtype=np.int64)

    def better(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where a partner (a column) comes before the last one kept for its line (a row)."""
        last, last_id = self.score[line, -1:], self.id[line, -1:]
        return (score > last) | ((score == last) & (ids < last_id))

    def take(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(line):
            return
        size = self.score.shape[1]
        met = np.unique(line)
        line = np.concatenate([line, np.repeat(met, size)])
        score = np.concatenate([score, self.score[met].ravel()])
        ids = np.concatenate([ids, self.id[met].ravel()])
        row = np.concatenate([row, self.row[met].ravel()])
        order = np.lexsort((row, ids, -score, line))
        line, order = line[order], order
        place = np.arange(len(line)) - np.searchsorted(line, line)
        first = place < size
        order, line, place = order[first], line[first], place[first]
        self.score[line, place], self.id[line, place], self.row[line, place] = score[order], ids[order], row[order]

    def rows(self) -> pa.RecordBatch:
        line, place = np.nonzero(self.row >= 0)
        values = (line, self.score[line, place], self.id[line, place], self.row[line, place])
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=["line", "score", "partner_id", "partner_row"])


class _Block:
    """Anchors of one block as the tasks need them."""

    def __init__(self, anchors: pa.Table, width: int, moduli: list[int]):
        self.row = anchors["row_no"].to_numpy()
        self.label = anchors["label"].to_numpy()
        self.width, self.moduli = width, moduli
        self.parts = residues(_matrix(anchors["parts"].combine_chunks(), width), moduli)

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Ids, rows, labels and residues of some rows at a time: few at first, while nearly every row is among the best."""
        size, most = 64, max(64, CELLS // max(1, len(self.row)))
        for batch in batches:
            ids = batch["vec_id"].fill_null(NO_ID).to_numpy()
            row, label, at = batch["row_no"].to_numpy(), batch["label"].to_numpy(), 0
            while at < len(row):
                cut = slice(at, at + size)
                yield ids[cut], row[cut], label[cut], residues(_matrix(batch["parts"].slice(at, size), self.width), self.moduli)
                at, size = at + size, min(2 * size, most)

    def positives(self, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        """The best other rows of each anchor's label in this task."""
        best = _Best(len(self.row), size)
        for ids, row, label, parts in self.chunks(batches):
            for one in np.intersect1d(label, self.label):
                a, b = np.nonzero(self.label == one)[0], np.nonzero(label == one)[0]
                got = scores([p[a] for p in self.parts], [p[b] for p in parts], self.moduli)
                i, j = np.nonzero(best.better(a, got, ids[b]) & (self.row[a][:, None] != row[b]))
                best.take(a[i], got[i, j], ids[b][j], row[b][j])
        yield best.rows()

    def negatives(self, batches: Iterator[pa.RecordBatch], pairs: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        """The best rows of other labels for each line of ``pairs``: number of the anchor, lowest and highest score."""
        anchor, low, high = (pairs[:, k] for k in range(3))
        best = _Best(len(pairs), size)
        # Each anchor's lines by their place among the anchor's, so that one place is one comparison of whole matrices.
        order = np.argsort(anchor, kind="stable")
        place = np.empty(len(pairs), dtype=np.int64)
        place[order] = np.arange(len(pairs)) - np.searchsorted(anchor[order], anchor[order])
        lines = [np.nonzero(place == k)[0] for k in range(place.max() + 1)] if len(pairs) else []
        for ids, row, label, parts in self.chunks(batches):
            got = scores(self.parts, parts, self.moduli)
            other = self.label[:, None] != label
            for line in lines:
                a = anchor[line]
                mine = got[a]
                fits = other[a] & (mine >= low[line][:, None]) & (mine <= high[line][:, None])
                i, j = np.nonzero(fits & best.better(line, mine, ids))
                best.take(line[i], mine[i, j], ids[j], row[j])
        yield best.rows()


_FOUND = "line long, score long, partner_id long, partner_row long"


def _first(found: DataFrame, size: int) -> DataFrame:
    """The final partners of each line: the best of what the tasks found. Each task hands on a few rows per line only."""
    by_score = Window.partitionBy("line").orderBy(F.desc("score"), "partner_id", "partner_row")
    return found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= size)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label. Positives are the ``n_positives`` best other rows of the anchor's label; negatives the
    ``n_negatives`` best rows of other labels whose score lies between the two percentages of the positive's score.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    norm = F.aggregate("parts", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    anchors = rows.where(is_anchor & F.col("vec_id").isNotNull())
    most, width, n_anchors = rows.select(F.max(norm), F.max(F.size("parts")), F.count_if(is_anchor & F.col("vec_id").isNotNull())).first()
    out = fresh_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    # By Cauchy and Schwarz no score exceeds the largest squared norm; the doubles' sum may be off in its last bits.
    bound = int(most * 1.001) + 1
    if bound >> SCORE_BITS:
        raise ValueError(f"scores up to {bound} do not fit into {SCORE_BITS} bits")
    moduli = primes(bound)
    n_blocks = -(-n_anchors * width // BLOCK_COMPONENTS)
    block_of = F.pmod(F.xxhash64("row_no"), F.lit(n_blocks))
    for number in range(n_blocks):
        chosen = anchors.where(block_of == number).select("row_no", "vec_id", "label", "parts").toArrow()
        if not chosen.num_rows:
            continue
        sent = spark.sparkContext.broadcast(_Block(chosen, width, moduli))
        positives = _first(
            rows.mapInArrow(lambda batches, sent=sent: sent.value.positives(batches, n_positives), _FOUND), n_positives
        ).select("line", "partner_id", "score")
        pairs = positives.toArrow()  # a few rows for each anchor of the block
        anchor, score = pairs["line"].to_numpy(), pairs["score"].to_numpy()
        low, high = -((-score * low_percent) // 100), score * high_percent // 100
        bands = spark.sparkContext.broadcast(np.stack([anchor, low, high], axis=1))
        found = rows.mapInArrow(lambda batches, sent=sent, bands=bands: sent.value.negatives(batches, bands.value, n_negatives), _FOUND)
        named = pa.table(
            {
                "line": np.arange(len(anchor)),
                "anchor_id": chosen["vec_id"].to_numpy()[anchor],
                "positive_id": pairs["partner_id"],
                "positive_score": pairs["score"],
            }
        )
        final = _first(found, n_negatives).join(F.broadcast(spark.createDataFrame(named)), "line")
        no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        final.withColumn("negative_id", F.col("partner_id")).select(
            "anchor_id", no_id("positive_id"), F.col("place").alias("rank"), no_id("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
        sent.unpersist()
        bands.unpersist()
    return spark.read.schema(schema).parquet(out)
