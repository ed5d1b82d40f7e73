"""Documents linked by the Jaccard similarity of their five-word shingles, by signature trees.

A set is a document's distinct shingles (64-bit hashes), known by a 64-bit hash of them; equal sets are one.

1. Prefix groups bring every pair to be linked together without a loss: of two sets of similarity 0.8, the first
   ``n - ceil(0.8 n) + 1`` shingles in any common order share one. The order puts shingles that many documents share last. Groups
   fall apart where sizes and places rule out all pairs. Groups with the same first member form one larger group (``rep``).
2. In small groups, signature trees (see ``sigtree``) of bitmaps alone find what can be similar; only that goes on.
3. A group that is small is one block. A large one is dealt to blocks by size class and hash; every block also has the rep.
   In a block, all sets are compared with the rep, then a tree is traversed against itself, with exact comparisons at the leaves.
4. In a large group, the sets that are not linked to the rep visit the other blocks of like size: tree against tree. The
   linked ones need not, as the rep connects them.
5. Verified links, a spanning forest per block, are joined to connected components.

Pairs are never listed: links within a block leave as a forest. The shingles that count as frequent are MAX_HOT at most, so they are
broadcast; the choice only orders, it never decides a link. Counts leave out what is rare in a batch, for the same reason.

Defined cases: null and empty texts, or texts without words, have no shingles and are linked with nothing: their component is their own
doc_id. Repeated rows are linked like copies; each keeps its row. A null doc_id is never a component's id while
any other is there. Long texts go whole. No rows: an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm import sigtree
from trafficlens.llm.components import components
from trafficlens.llm.tables import shuffle_width, store

SHINGLE = 5
PERCENT = sigtree.PERCENT
#: A shingle in as many documents may be listed as frequent; the list has the most frequent ones.
MIN_HOT = 16
MAX_HOT = 1 << 18
#: A block has about as many sets or shingles at most.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 20
# Fixed odd multipliers of the shingle hash.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: The word hash's value for each byte, from a fixed rule; longer words are hashed on their own.
LETTERS = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) for b in range(256)], dtype=np.uint64)
LONG_WORD = 64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bits of the filter of texts; when it is full it lets all pass, which costs time only.
FILTER_BITS = 1 << 26


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xA24BAED4963EE407
_tables = [_powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word. With running sums of byte * base^place, a word's hash is a difference, moved back to place 0."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) > len(_tables[0]):
        _tables[:] = _powers(_BASE, 2 * len(data)), _powers(pow(_BASE, -1, 1 << 64), 2 * len(data))
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[data] * _tables[0][: len(data)], out=sums[1:])
    out = _mixed((sums[ends] - sums[starts]) * _tables[1][starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; ASCII letters count in lower case."""
    words = word_hashes(text.encode().lower())
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * STEP + words[k : k + n]
    return np.unique(_mixed(out))


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, sid, thash) of every row as a stored table, and the frequent shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            sets = [shingles(t) for t in texts]
            seen, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            often = n >= 3
            seen, n = seen[often], n[often]
            none, rows = len(seen), len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch["doc_id"].cast(pa.int64()), pa.nulls(none, pa.int64())]),
                    pa.array([len(s) for s in sets] + [None] * none, pa.int64()),
                    pa.array([set_id(s) for s in sets] + [None] * none, pa.int64()),
                    pa.array([text_hash(t) for t in texts] + [None] * none, pa.int64()),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), _signed(seen)]),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(n, pa.int64())]),
                ],
                ["doc_id", "n_shingles", "sid", "thash", "shingle", "n"],
            )

    found = store(_texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_shingles long, sid long, thash long, shingle long, n long"), "shingle-survey")
    members = found.where("sid is not null").select("doc_id", "n_shingles", "sid", "thash")
    counted = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_HOT)
    hot = store(counted, "frequent-shingles")
    # Classes of counts, the largest first, while they fit: no task and no driver sorts them all.
    rank = F.floor(8 * F.log2("n")).cast("int")
    room, least = MAX_HOT, 1 << 30
    for of_class, size in sorted(hot.groupBy(rank.alias("rank")).count().collect(), reverse=True):
        if size > room:
            break
        room, least = room - size, of_class
    listed = hot.where(rank >= least).select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64)  # at most MAX_HOT
    return members, np.sort(listed.view(np.uint64))


def prefix(own: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, frequent ones last, and which of them are frequent."""
    length = len(own) - (-(-percent * len(own) // 100)) + 1
    place = np.searchsorted(hot, own)
    frequent = np.zeros(len(own), dtype=bool)
    inside = place < len(hot)
    frequent[inside] = hot[place[inside]] == own[inside]
    ordered = np.concatenate([own[~frequent], own[frequent]])[:length]
    return ordered, np.arange(length) >= int((~frequent).sum())


def prefix_rows(docs: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """key, hot, sid, n and reach: a row per shingle of each set's prefix, as a stored table; a task lists a set once.

    ``reach``: the largest size of a set that can be similar if this shingle is the first that both prefixes have.
    """
    table = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for text in batch["text"].to_pylist():
                own = shingles(text)
                sid = set_id(own)
                if not len(own) or sid in seen:
                    continue
                seen.add(sid)
                key, frequent = prefix(own, table.value, percent)
                n, place = np.full(len(key), len(own), dtype=np.int64), np.arange(len(key))
                out.append((key, frequent, np.full(len(key), sid, dtype=np.int64), n, (n - place) * (100 + percent) // percent - n))
            if out:
                keys, *columns = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([_signed(keys), *map(pa.array, columns)], ["key", "hot", "sid", "n", "reach"])

    return store(_texts(docs).mapInArrow(run, "key long, hot boolean, sid long, n long, reach long"), "prefixes")


def prefix_groups(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rep, sid and n: the members (rep included) of every group of two sets or more, as a stored table.

    In order of size, the sets of a rare shingle form runs: a new one begins where no smaller set reaches the next size, as then
    no pair across can be similar. A frequent shingle's group may hold a share of all sets: it is cut by size classes (a set
    is also in the next class if it reaches there), and its rep comes from a map-side aggregate and is broadcast (at most two rows
    per class and one of MAX_HOT shingles).
    """
    by_size = Window.partitionBy("key").orderBy("n", "sid")
    smaller = by_size.rowsBetween(Window.unboundedPreceding, -1)
    rare = rows.where(~F.col("hot")).withColumn("starts", ~F.coalesce(F.max("reach").over(smaller) >= F.col("n"), F.lit(False)))
    so_far = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = rare.select(
        "sid", "n", F.last(F.when(F.col("starts"), F.col("sid")), ignorenulls=True).over(so_far).alias("rep"),
        (F.col("starts") & F.coalesce(F.lead("starts").over(by_size), F.lit(True))).alias("single"),
    )
    step = F.log(F.lit(100 / percent))
    own, reached = F.floor(F.log("n") / step), F.floor(F.log("reach") / step)
    classes = F.when(reached > own, F.array(own, own + 1)).otherwise(F.array(own))
    frequent = rows.where("hot").select("key", "sid", "n", F.explode(classes).alias("class"))
    reps = frequent.groupBy("key", "class").agg(F.min("sid").alias("rep"), F.max("sid").alias("top")).where("rep < top")
    frequent = frequent.join(F.broadcast(reps), ["key", "class"])
    both = rare.where(~F.col("single")).select("rep", "sid", "n").union(frequent.select("rep", "sid", "n"))
    return store(both.distinct(), "prefix-groups")


def member_sets(docs: DataFrame, members: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
    """sid and value of every set in ``members``, as a stored table; the value is the text (``whole``) or the signature.

    ``known``: sid and thash of all texts. One text per set is wanted; a filter of FILTER_BITS bits drops most others before
    any work is done on them.
    """
    wanted = store(known.join(members.select("sid").distinct(), "sid").groupBy("sid").agg(F.min("thash").alias("thash")), "wanted")
    place = F.pmod("thash", F.lit(FILTER_BITS))
    words = wanted.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(thash, {FILTER_BITS}) & 63 as int))")).alias("bits"))
    found = words.toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            marks = np.array([text_hash(t) for t in texts], dtype=np.int64)
            places = marks % FILTER_BITS
            passed = np.flatnonzero(table.value[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).tolist()
            kept = [texts[i] for i in passed]
            values = pa.array(kept, pa.string()) if whole else pa.array([sigtree.signature(shingles(t)) for t in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(marks[passed]), values], ["mark", "value"])

    found = _texts(docs).mapInArrow(run, f"mark long, value {'string' if whole else 'binary'}")
    matched = found.join(wanted, F.col("mark") == F.col("thash")).groupBy("thash", "sid")
    return store(matched.agg(F.min("value").alias("value")).drop("thash"), "member-sets")


def sift(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``members`` without the sets that no signature tree finds a candidate for, as a stored table.

    Trees of signatures are traversed in the small groups; what hangs together there is a group of its own, of
    which the texts are looked at later. Large groups stay as they are.
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    is_large = (F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)
    marked = members.join(sizes.select("rep", is_large.alias("large")), "rep")
    small = marked.where(~F.col("large")).select("rep", "sid", "n").join(sets, "sid")

    def work(block: list[dict]) -> Iterator[tuple]:
        n = np.array([r["n"] for r in block], dtype=np.int64)
        roots = sigtree.candidates([r["value"] for r in block], n, percent).roots()
        for root, count in zip(*np.unique(roots, return_counts=True)):
            if count > 1:
                own = [block[i] for i in np.flatnonzero(roots == root).tolist()]
                rep = min(r["sid"] for r in own)
                yield from ((rep, r["sid"], r["n"]) for r in own)

    kept = _by_block(small, ["rep"], work, "rep long, sid long, n long")
    return store(kept.union(marked.where("large").select("rep", "sid", "n")).distinct(), "candidates")


def blocks(members: DataFrame) -> DataFrame:
    """rep, sid, n, large, class and block. Members of small groups share block 0; class -1."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    large = sizes.where((F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)).select("rep", F.lit(True).alias("large"))
    marked = members.join(large, "rep", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    # Sets of similarity 0.8 are in the same or in neighbouring classes.
    marked = marked.withColumn("class", F.when(F.col("large"), F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))).otherwise(-1))
    dealt = _salted(marked.where("large"), "salts")
    small = marked.where(~F.col("large")).withColumn("block", F.lit("0"))
    return store(small.unionByName(dealt), "blocks")


def _salted(rows: DataFrame, name: str) -> DataFrame:
    """A block per (rep, class) and salt, with as many salts as its sets and shingles need."""
    counts = rows.groupBy("rep", "class").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias(name)
    )
    dealt = rows.join(counts, ["rep", "class"])
    return dealt.withColumn("block", F.concat_ws("-", "class", F.pmod(F.xxhash64("sid"), F.col(name)))).drop(name)


def _by_block(rows: DataFrame, keys: list[str], work: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each block, which come together and one block at a time."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    yield from batch.slice(at, 64).to_pylist()

        out: list[tuple] = []
        for _, block in groupby(each(), key=lambda r: tuple(r[k] for k in keys)):
            out += work(list(block))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], target)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], target)

    target = pa.schema([(name, pa.int64()) for name in names])
    dealt = rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _sets(block: list[dict]) -> tuple[list[int], list[np.ndarray]]:
    sids = [r["sid"] for r in block]
    return sids, [shingles(r.pop("text")) for r in block]


def _forest(sids: list[int], links: sigtree.Links) -> Iterator[tuple[int, int]]:
    for i, root in enumerate(links.roots().tolist()):
        if i != root:
            yield sids[i], sids[root]


def inner_links(dealt: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, rep: links within blocks (rep null); for sets of large groups not linked to their rep: a the set, b null, rep."""
    reps = dealt.where("large").select("rep", "block").distinct().select("rep", F.col("rep").alias("sid"), F.lit(True).alias("large"), "block")
    rows = dealt.select("rep", "sid", "large", "block").union(reps).distinct().join(texts, "sid")

    def work(block: list[dict]) -> Iterator[tuple]:
        sids, sets = _sets(block)
        rep = block[0]["rep"]
        first = sids.index(rep)
        links = sigtree.link_all(sets, first, percent)
        for a, b in _forest(sids, links):
            yield a, b, None
        if block[0]["large"]:
            roots = links.roots()
            for i in np.flatnonzero(roots != roots[first]).tolist():
                yield sids[i], None, rep

    return store(_by_block(rows, ["rep", "block"], work, "a long, b long, rep long"), "inner-links")


def outer_links(dealt: DataFrame, apart: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links between a set that is not linked to its rep (``apart``: rep, sid) and sets of other blocks of the group."""
    visiting = dealt.where("large").join(apart, ["rep", "sid"]).select("rep", "sid", "n", "class", F.col("block").alias("own"))
    visiting = store(_salted(visiting, "visits").withColumnRenamed("block", "visit"), "visitors")
    hosts = dealt.where("large").select("rep", "class", "block").distinct()
    visits = visiting.select("rep", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), "visit").distinct()
    pairs = store(hosts.join(visits, ["rep", "class"]).select("rep", "block", "visit"), "block-pairs")
    at_home = dealt.where("large").select("rep", "sid", "block").join(pairs, ["rep", "block"])
    guests = visiting.select("rep", "sid", "visit", "own").join(pairs, ["rep", "visit"]).where("own <> block")
    rows = (
        at_home.select("rep", "block", "visit", "sid", F.lit(False).alias("guest"))
        .union(guests.select("rep", "block", "visit", "sid", F.lit(True)))
        .join(texts, "sid")
    )

    def work(block: list[dict]) -> Iterator[tuple]:
        guest = np.array([r["guest"] for r in block])
        sids, sets = _sets(block)
        links = sigtree.link_between(sets, np.flatnonzero(~guest), np.flatnonzero(guest), percent)
        # A guest may also be at home here only if it was excluded above, so every place is another set.
        yield from _forest(sids, links)

    return store(_by_block(rows, ["rep", "block", "visit"], work, "a long, b long"), "outer-links")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    members, hot = survey(docs)
    groups = prefix_groups(prefix_rows(docs, hot, percent), percent)
    known = members.select("sid", "thash")
    dealt = blocks(sift(groups, member_sets(docs, groups, known, False), percent))
    texts = member_sets(docs, dealt, known, True).withColumnRenamed("value", "text")
    inner = inner_links(dealt, texts, percent)
    edges = inner.where("b is not null").select("a", "b")
    apart = inner.where("b is null").select("rep", F.col("a").alias("sid")).distinct()
    if not apart.isEmpty():
        edges = edges.union(outer_links(dealt, apart, texts, percent))
    labels = components(edges)
    # By set first, so that the joins on a component or a set that many documents have meet one row per set.
    by_set = members.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    labelled = by_set.join(labels, by_set["sid"] == labels["node"], "left").select("sid", "first", F.coalesce("label", "sid").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    component = labelled.join(smallest, "label").select("sid", "component_id")
    linked = members.where("n_shingles > 0").join(component, "sid").select("doc_id", "n_shingles", "component_id")
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)
