"""Token ids in seekable zstandard files.

A file holds documents in ascending doc_id order. Each document is one or more independent zstandard frames of at most
FRAME_IDS little-endian unsigned 32-bit ids. After them come two skippable frames: the index (for each document
its id and its number of ids) and, last, the public seek table: compressed size, decompressed size and checksum (the low 32 bits of
XXH64 of the decompressed bytes) of every frame, then the number of frames, a flag byte and a magic number. A reader fetches
the tail, then only the byte ranges of the documents it wants.

Tasks write under names of their own and report them; the stored list of files is what counts, so a file left by a
failed attempt is never read. Files are written and read by ranges through Arrow's file systems, which take the shared
folder's address as it is.

Defined cases: a null or empty text has only the end id. Repeated rows are written each, in order of their text.
A null doc_id comes first and is read back as null (the smallest long stands for it in the index). No rows: no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm import tokens
from trafficlens.llm.tables import fresh_path, shuffle_width, store

END_ID = 2
FRAME_IDS = 1 << 20
#: A file is closed once it holds as many ids.
FILE_IDS = 1 << 26
LEVEL = 3
# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NULL_ID = -(1 << 63)


class Writer:
    def __init__(self, stream):
        self.stream = stream
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.n_ids = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for at in range(0, max(len(ids), 1), 4 * FRAME_IDS):
            raw = ids[at : at + 4 * FRAME_IDS]
            frame = self.compressor.compress(raw)
            self.stream.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.docs, dtype="<i8").reshape(-1, 2).tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((8 + len(index), 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table)
        self.stream.write(struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC))
        self.stream.close()


class Reader:
    """``stream`` needs seek, read and size()."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        n, flag, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        table_at = size - 9 - 12 * n
        self.frames = np.frombuffer(self._bytes(table_at, 12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        index = self._bytes(int(self.starts[n - 1]) + 8, int(self.frames[n - 1, 0]) - 8)
        self.docs = np.frombuffer(index, dtype="<i8").reshape(-1, 2)
        n_frames = np.maximum(1, -(-self.docs[:, 1] // FRAME_IDS))
        self.first_frame = np.concatenate([[0], np.cumsum(n_frames)]).astype(np.int64)

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document; only its own frames are fetched and decompressed."""
        decompressor, out = zstandard.ZstdDecompressor(), []
        for k in range(self.first_frame[i], self.first_frame[i + 1]):
            packed, size, checksum = self.frames[k].tolist()
            raw = decompressor.decompress(self._bytes(int(self.starts[k]), packed), max_output_size=max(size, 1))
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} is damaged")
            out.append(raw)
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        lo, hi = np.searchsorted(self.docs[:, 0], [doc_id, doc_id], side="left"), np.searchsorted(self.docs[:, 0], doc_id, side="right")
        return list(range(int(lo[0]), int(hi)))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` to files in ``folder``; the list of files: part, seq, path, n_docs, n_ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        writer, done = None, []

        def finish() -> None:
            writer.close()
            done.append((part, len(done), name, len(writer.docs), writer.n_ids))

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(map(str, batch["text"]))):
                if writer is None:
                    name = f"{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(system.open_output_stream(f"{root}/{name}", compression=None))
                writer.add(doc_id, ids + end)
                if writer.n_ids >= FILE_IDS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "seq", "path", "n_docs", "n_ids"), row)) for row in done],
            pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(write_part, "part long, seq long, path string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the listed files."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                with system.open_input_file(f"{root}/{path}") as stream:
                    reader = Reader(stream)
                    crc = [zlib.crc32(reader.ids(i)) for i in range(len(reader.docs))]
                    lengths = reader.docs[:, 1]
                    doc_id = reader.docs[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_id, pa.int64(), mask=doc_id == NULL_ID),
                            pa.array(base + np.cumsum(lengths) - lengths, pa.int64()),
                            pa.array(lengths, pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    dealt = listed.select("path", "base").repartition(shuffle_width(files.sparkSession), "path")
    return dealt.mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, vocabulary or tokens.vocabulary()), folder)
