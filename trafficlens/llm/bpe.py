"""BPE encoding with content-defined chunks that documents share, and decoding.

1. Texts are cut where a rolling hash of the last 16 bytes has its top bits zero (then on to just after the next white space, if
   one is near), so equal passages have equal chunks wherever they stand. Chunk hashes are counted over all documents.
2. The chunks in two documents or more that save most are encoded once. They are chosen by classes of saving,
   largest first, while their texts and keys fit SHARED_BYTES together, so the table of their ids has a bounded size and is
   broadcast, as sorted arrays. All other chunks are encoded where they stand, their words once per worker.
3. A document's ids are put together from its chunks. At every join a window of words on both sides is encoded again and must
   begin and end with the ids that the chunks have there; until it does, the window doubles. What has been put together
   thus always equals the encoding of the text so far.

The joined ids equal the tokenizer's for any text, whatever is shared; SHARED_BYTES only decides how much work is saved.

Defined cases: a null or empty text has no ids. Repeated rows and null ids are rows like all others. Texts with one of the four
controls at which Python splits and the tokenizer does not are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import tokens
from trafficlens.llm.tables import store

CUT_BITS = 9
SNAP = 48
SHARED_BYTES = 16 << 20
#: What a shared chunk takes beside its text.
KEY_BYTES = 48
#: Characters of the texts that are put together at once.
BLOCK_CHARS = 2_000_000
#: The rolling hash's value for each byte, from a fixed rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(raw: np.ndarray) -> list[int]:
    """Where the chunks of a text (UTF-8 bytes) begin, but for the first; the same passages are cut alike."""
    if len(raw) < 2:
        return []
    rolled = GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = rolled[:-step] << np.uint32(step) if len(rolled) > step else rolled[:0]
        rolled = rolled.copy()
        rolled[step:] += shifted
    marks = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1
    found, last = [], 0
    for at in marks.tolist():
        if at <= last:
            continue
        near = np.flatnonzero(SPACE[raw[at : at + SNAP]])
        if len(near):
            at += int(near[0]) + 1
        else:
            while at < len(raw) and raw[at] & 0xC0 == 0x80:  # not inside a character
                at += 1
        if at < len(raw):
            found.append(at)
            last = at
    return found


def chunks(text: str) -> list[bytes]:
    raw = text.encode()
    edges = [0, *cuts(np.frombuffer(raw, dtype=np.uint8)), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """key, size (bytes) and n_docs of every chunk; a document counts once for each of its chunks."""

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for text in batch["text"]:
                own = {key(c): len(c) for c in chunks(text.as_py())}
                keys += own
                sizes += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["key", "size"])

    listed = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(list_chunks, "key binary, size long")
    return listed.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n_docs"))


def shared_chunks(docs: DataFrame, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """key of the chunks to be encoded once: classes of (n_docs - 1) * size, largest first, of ``shared_bytes`` together."""
    counted = store(chunk_counts(docs).where("n_docs > 1 and size > 0"), "chunk-counts")
    saving = F.floor(4 * F.log2((F.col("n_docs") - 1) * F.col("size"))).cast("int")
    classes = counted.groupBy(saving.alias("saving")).agg(F.sum(F.col("size") + KEY_BYTES).alias("bytes")).collect()  # at most 256 rows
    room, least = shared_bytes, 1 << 30
    for saving_class, size in sorted(classes, reverse=True):
        if size > room:
            break
        room, least = room - size, saving_class
    return counted.where(saving >= least).select("key")


class Shared:
    """Chunks by their keys, with the ids of each: sorted arrays, which take little more than the ids."""

    def __init__(self, keys: list[bytes], ids: list[bytes] | None = None):
        pairs = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.first, self.second = pairs[order, 0], pairs[order, 1]
        own = [ids[k] for k in order] if ids else []
        self.ends = np.cumsum([0, *map(len, own)])
        self.flat = b"".join(own)

    def __len__(self) -> int:
        return len(self.first)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Where each key stands, -1 for those that are not here. (Of keys with the same first half one is found, the others are as good as unshared.)"""
        if not len(self) or not keys:
            return np.full(len(keys), -1)
        pairs = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.first, pairs[:, 0]), len(self) - 1)
        return np.where((self.first[at] == pairs[:, 0]) & (self.second[at] == pairs[:, 1]), at, -1)

    def ids(self, place: int) -> bytes:
        return self.flat[self.ends[place] : self.ends[place + 1]]

    def values(self) -> list[bytes]:
        return [self.ids(k) for k in range(len(self))]


def shared_ids(docs: DataFrame, vocabulary: str, shared_bytes: int = SHARED_BYTES) -> Shared:
    """Ids of the shared chunks, each encoded once; the bound on their texts and keys bounds this table."""
    keys = [bytes(row["key"]) for row in shared_chunks(docs, shared_bytes).collect()]
    if not keys:
        return Shared([], [])
    chosen = docs.sparkSession.sparkContext.broadcast(Shared(keys))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(chosen.value), dtype=bool)
        for batch in batches:
            for text in batch["text"]:
                own = chunks(text.as_py())
                names = [key(c) for c in own]
                found = []
                for k, place in enumerate(chosen.value.places(names).tolist()):
                    if place >= 0 and not seen[place]:
                        seen[place] = True
                        found.append(k)
                if found:
                    columns = [pa.array([names[k] for k in found], pa.binary()), pa.array([own[k] for k in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(tokens.encoder(vocabulary).encode(c.decode() for c in batch["chunk"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, pa.binary())], ["key", "ids"])

    picked = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pick, "key binary, chunk binary")
    once = picked.groupBy("key").agg(F.min("chunk").alias("chunk"))
    rows = [(bytes(row["key"]), bytes(row["ids"])) for row in once.mapInArrow(encode, "key binary, ids binary").toLocalIterator()]
    return Shared([k for k, _ in rows], [x for _, x in rows])


def _left_start(raw: bytes, stop: int, words: int) -> int:
    """Where the last ``words`` words before ``stop`` begin."""
    at = stop
    for _ in range(words):
        while at and SPACE[raw[at - 1]]:
            at -= 1
        while at and not SPACE[raw[at - 1]]:
            at -= 1
    return at


def _right_end(raw: bytes, start: int, stop: int, words: int) -> int:
    at = start
    for _ in range(words):
        while at < stop and SPACE[raw[at]]:
            at += 1
        while at < stop and not SPACE[raw[at]]:
            at += 1
    return at


def _words_at_joins(own: list[bytes]) -> Iterator[str]:
    """The words on both sides of the joins, which are encoded again."""
    for left, right in zip(own, own[1:]):
        both = left[_left_start(left, len(left), 2) :] + right[: _right_end(right, 0, len(right), 2)]
        yield from both.decode().split()


def join(encoder: tokens.WordEncoder, raw: bytes, parts: list[tuple[int, bytes]]) -> bytes:
    """Ids of ``raw`` from (start, ids) of its chunks."""

    def encode(a: int, b: int) -> bytes:
        return encoder.short(raw[a:b].decode())

    out = bytearray(parts[0][1]) if parts else bytearray()
    stops = [start for start, _ in parts[1:]] + [len(raw)]
    for (at, ids), stop in zip(parts[1:], stops[1:]):
        words = 2
        while True:
            a, b = _left_start(raw, at, words), _right_end(raw, at, stop, words)
            left, right, window = encode(a, at), encode(at, b), encode(a, b)
            first, last = encode(a, min(at, _right_end(raw, a, at, 1))), encode(max(at, _left_start(raw, b, 1)), b)
            agrees = out.endswith(left) and ids.startswith(right)
            agrees = agrees and (a == 0 or window.startswith(first)) and (b == stop or window.endswith(last))
            if agrees:
                del out[len(out) - len(left) :]
                out += window
                out += ids[len(right) :]
                break
            if a == 0 and b == stop:
                out[:] = encode(0, stop)
                break
            words *= 2
    return bytes(out)


def encode(docs: DataFrame, vocabulary: str | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every row."""
    return _encoded(docs, vocabulary or tokens.vocabulary(), shared_bytes, lambda batch: batch, "doc_id long, ids binary")


def report(docs: DataFrame, vocabulary: str | None = None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``digests`` of what ``encode`` gives, taken where the ids are made, so no second worker holds them."""
    vocabulary = vocabulary or tokens.vocabulary()
    return _encoded(docs, vocabulary, shared_bytes, lambda batch: _digest(batch, vocabulary), DIGESTS)


def _encoded(docs: DataFrame, vocabulary: str, shared_bytes: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(shared_ids(docs, vocabulary, shared_bytes))

    def encode_block(encoder: tokens.WordEncoder, texts: list[str]) -> Iterator[bytes]:
        cut = [None if tokens.ODD_SPACE.search(t) else chunks(t) for t in texts]
        places = iter(table.value.places([key(c) for own in cut for c in own or ()]).tolist())
        known = [[next(places) for _ in own or ()] for own in cut]
        encoder.prepare(word for own in cut for word in _words_at_joins(own or []))
        fresh = encoder.encode(c.decode() for own, at in zip(cut, known) for c, k in zip(own or (), at) if k < 0)
        for text, own, at in zip(texts, cut, known):
            if own is None:
                yield encoder.whole(text)
                continue
            starts = np.cumsum([0, *map(len, own)]).tolist()
            parts = [(start, next(fresh) if k < 0 else table.value.ids(k)) for start, k in zip(starts, at)]
            yield join(encoder, b"".join(own), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False))
            # Texts whose characters fall into the same block go together.
            edges = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_CHARS)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                ids = list(encode_block(encoder, part["text"].to_pylist()))
                yield finish(pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"]))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


_surfaces: dict[str, np.ndarray] = {}


def decode(ids: bytes, vocabulary: str) -> str:
    """As the library decodes without a decoder and without skipping special tokens: the tokens, a blank between two."""
    if vocabulary not in _surfaces:
        tokenizer = tokens.encoder(vocabulary).tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        _surfaces[vocabulary] = np.array([tokenizer.id_to_token(i) or "" for i in range(size)], dtype=object)
    return " ".join(_surfaces[vocabulary][np.frombuffer(ids, dtype="<u4")].tolist())


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(batch: pa.RecordBatch, vocabulary: str) -> pa.RecordBatch:
    ids = batch["ids"].to_pylist()
    columns = [
        batch["doc_id"],
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(decode(x, vocabulary).encode()).hexdigest() for x in ids], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode``'s rows."""
    vocabulary = vocabulary or tokens.vocabulary()
    return encoded.mapInArrow(lambda batches: (_digest(batch, vocabulary) for batch in batches), DIGESTS)
