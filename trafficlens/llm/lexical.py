"""The best documents for each item of a query set, by a whole-number lexical score, with masks of the terms that are present.

Each text becomes a posting once: its number of terms and, of those terms that occur in an item, their numbers and counts. Sums over the
postings give the corpus's statistics. Then every task searches its own postings: of a block of documents, bitmaps tell which of an
item's terms each one holds; documents of the same mask form a group, the sum of the terms' highest contributions in the block bounds the
scores of the group, and groups are evaluated from the highest bound downwards until no bound left reaches the tenth score found so far,
which is kept from block to block. So the results of a task are exact, and a window over the tasks' ten best per item gives the final ten.

Items are taken in blocks of bounded size, each sent to all tasks; the corpus is never sent anywhere, and no task holds more than a block of
postings and ten documents per item. How often a term occurs, or how many documents are copies of each other, changes no bound.

Given results: documents without a text or a term match nothing and count in no statistic; items without terms get no rows. Equal scores go
by id, missing ids last. Repeated rows are documents of their own, and repeated items get their own ranks. Empty tables on either side give
no rows. Other columns are not looked at. Texts of any length are read in pieces cut between terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.tables import fresh_path, store

TOP = 10
#: Bytes of item texts in one block of items (a longer item is a block of its own).
BLOCK_BYTES = 8_000_000
#: Terms of the items that are searched together, and cells of one block of documents by these terms.
GROUP_TERMS = 4096
CELLS = 1 << 23
#: Bytes of a text that are cut into terms at once.
PIECE = 4_000_000


def _term_bytes() -> bytes:
    """Letters and digits of ASCII, lower-cased, and all bytes beyond it belong to terms; others become blanks."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256)))


_TERMS = _term_bytes()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece."""
    plain, at = text.translate(_TERMS), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms' counts, in blocks of bounded size."""
    block, size = [], 0
    for item_id, text in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        counts: Counter = Counter()
        for piece in terms(raw):
            counts.update(piece)
        if counts:
            block.append((item_id, counts))
            size += len(raw)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, and the numbers (rising) and counts of the vocabulary's terms, of every document with a term; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            ids, lengths, numbers, counts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"].cast(pa.large_binary()), strict=True):
                n, found = 0, []
                for piece in terms(text.as_py() or b""):
                    n += len(piece)
                    found.append(np.array([k for k in map(number, piece) if k is not None], dtype=np.int32))
                if n:
                    unique, count = np.unique(np.concatenate(found), return_counts=True)
                    ids.append(doc_id.as_py())
                    lengths.append(n)
                    numbers.append(unique.astype("<i4").tobytes())
                    counts.append(count.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n_terms", "numbers", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return store(rows.mapInArrow(cut, "doc_id long, n_terms long, numbers binary, counts binary"), "postings")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column in one array, and how many each row has."""
    size = np.dtype(kind).itemsize
    pieces = column.to_pylist()
    return np.frombuffer(b"".join(pieces), dtype=kind), np.array([len(p) // size for p in pieces], dtype=np.int64)


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms, and the number of documents holding each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, holding = 0, 0, np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            total += sum(batch["n_terms"].to_pylist())
            holding += np.bincount(_flat(batch["numbers"], "<i4")[0], minlength=n_terms)
        held = np.nonzero(holding)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n, total, *holding[held].tolist()], pa.int64())], names=["term", "n"]
        )

    sums = found.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(n_terms, dtype=np.int64)
    n, total = 0, 0
    for term, value in sums.collect():  # one row per term of the block of items
        if term == -2:
            n = value
        elif term == -1:
            total = value
        else:
            df[term] = value
    return n, total, df


class _Search:
    """The items of a block, weighted, as the tasks need them."""

    def __init__(self, items: list[dict[int, int]], weights: list[int], n_docs: int, n_total: int):
        self.n_docs, self.n_total = n_docs, n_total
        self.items = [(np.array(sorted(x), dtype=np.int64), np.array([x[t] * weights[t] for t in sorted(x)], dtype=np.int64)) for x in items]
        self.groups: list[list[int]] = []
        held: set[int] = set()
        for k, (own, _) in enumerate(self.items):
            more = held.union(own.tolist())
            if not self.groups or len(more) > GROUP_TERMS:
                self.groups.append([])
                more = set(own.tolist())
            self.groups[-1].append(k)
            held = more
        self.n_terms = len(weights)

    def slack(self, n: int) -> int:
        return 100 - 75 + (75 * n * self.n_docs) // self.n_total

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in self.items]
        for batch in batches:
            numbers, sizes = _flat(batch["numbers"], "<i4")
            counts, _ = _flat(batch["counts"], "<i8")
            row = np.repeat(np.arange(batch.num_rows), sizes)
            slack = np.array([8 * self.slack(n) for n in batch["n_terms"].to_pylist()], dtype=np.int64)
            parts = (1_000_000_000 * counts) // (1000 * counts + slack[row])
            no_id = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(0).to_numpy()
            for group in self.groups:
                column = np.full(self.n_terms, -1, dtype=np.int64)
                own = np.unique(np.concatenate([self.items[k][0] for k in group]))
                column[own] = np.arange(len(own))
                at = column[numbers]
                inside = at >= 0
                step = max(1, CELLS // len(own))
                for first in range(0, batch.num_rows, step):
                    last = min(first + step, batch.num_rows)
                    low, high = np.searchsorted(row, [first, last])
                    here = inside[low:high]
                    grid = np.zeros((last - first, len(own)), dtype=np.int32)
                    grid[row[low:high][here] - first, at[low:high][here]] = parts[low:high][here]
                    present, most = grid > 0, grid.max(axis=0).astype(np.int64)
                    for k in group:
                        cols = column[self.items[k][0]]
                        best[k] = self._item(best[k], grid, present, most, cols, self.items[k][1], ids[first:last], no_id[first:last])
        for k, (score, doc, missing) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), k, dtype=np.int32)), pa.array(score), pa.array(doc, mask=missing)],
                    names=["item_no", "score", "doc_id"],
                )

    def _item(self, best, grid, present, most, cols, weights, ids, no_id):
        """``best`` (scores, ids, which are missing) after the documents of one block."""
        bits = np.packbits(present[:, cols], axis=1)
        rows = np.nonzero(bits.any(axis=1))[0]
        if not len(rows):
            return best
        masks, group = np.unique(bits[rows].view(f"V{bits.shape[1]}").ravel(), return_inverse=True)
        held = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, count=len(cols))
        bound = held.astype(np.int64) @ (weights * most[cols])
        falling = np.argsort(-bound, kind="stable")
        place = np.empty(len(masks), dtype=np.int64)
        place[falling] = np.arange(len(masks))
        by_mask = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(masks)))
        done, docs, step = 0, 0, 4
        while done < len(masks):
            # A group whose bound equals the last score may hold a smaller id.
            least = best[0][-1] if len(best[0]) == TOP else 1
            until = min(done + step, len(masks))
            while until > done and bound[falling[until - 1]] < least:
                until -= 1
            if until == done:
                break
            chosen = rows[by_mask[docs : ends[until - 1]]]
            score = grid[np.ix_(chosen, cols)].astype(np.int64) @ weights
            good = score >= least
            score, chosen = score[good], chosen[good]
            every = [np.concatenate(pair) for pair in zip(best, (score, ids[chosen], no_id[chosen]), strict=True)]
            order = np.lexsort((every[1], every[2], -every[0]))[:TOP]
            best = tuple(x[order] for x in every)
            docs, done, step = ends[until - 1], until, 2 * step
        return best


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents for each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out, some = fresh_path(spark, "ranked"), False
    for block in _blocks(items):
        vocabulary: dict[bytes, int] = {}
        for _, counts in block:
            for term in counts:
                vocabulary.setdefault(term, len(vocabulary))
        found = postings(docs, vocabulary)
        n, total, df = statistics(found, len(vocabulary))
        if not n:
            break
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
        search = _Search([{vocabulary[t]: c for t, c in counts.items()} for _, counts in block], weights, n, total)
        sent = spark.sparkContext.broadcast(search)
        tops = found.mapInArrow(lambda batches, sent=sent: sent.value.run(batches), "item_no int, score long, doc_id long")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(block)], f"item_no int, item_id {kind}")
        tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).join(F.broadcast(names), "item_no").select(
            "item_id", "rank", "doc_id", "score"
        ).write.mode("append").parquet(out)
        sent.unpersist()
        some = True
    return spark.read.schema(schema).parquet(out) if some else spark.createDataFrame([], schema)
