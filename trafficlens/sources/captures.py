"""Capture files to packet tables: a Spark data source named ``captures``.

    register(spark)
    spark.read.format("captures").load(folder)          # packets, one task walks a file from end to end
    spark.readStream.format("captures").load(folder)    # packets of files that are moved into the folder
    CaptureFolder(spark, folder).packets()              # the same, large files cut into segments first

Files of all sizes take the same way: byte ranges are read through Arrow's file systems and decoded by arrays of positions, batch by
batch, so neither a file nor a segment becomes a row. Files above the segment size are first walked in parallel: every segment finds the
starts that look right and how far they lead (``framing.split_walks``), the walks are stitched together file by file, and what no guess
has hit is walked again from where the segment before ends. The result is that of one walk through the file, record for record, while no
task reads more than some segments. The stitched list of pieces is stored and names each piece's first packet number.

A broken file does not stop the others. It gives its good packets and a status row.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)
from pyspark.sql.pandas.types import from_arrow_schema

from trafficlens.functions.expressions import admitted, file_name, path_below
from trafficlens.session import fresh_path, store
from trafficlens.settings import CAPTURE_EXTENSIONS
from trafficlens.sources import framing
from trafficlens.sources.decode import PACKETS, packets
from trafficlens.sources.framing import CaptureError, Run, State, Walker

SEGMENT_BYTES = 64 * 1024 * 1024
#: Small files are put together until a task has so many bytes.
TASK_BYTES = 64 * 1024 * 1024
OPEN_BYTES = 4 * 1024 * 1024
LEAST_TASKS = 32
ROWS_PER_BATCH = 20_000
WALKS_PER_BATCH = 500
GLOB = "*.[pP][cC][aA][pP]*"

_LONG, _TEXT = pa.int64(), pa.string()
WALKS = pa.schema(
    [("path", _TEXT), ("length", _LONG), ("begin", _LONG), ("stop", _LONG), ("start", _LONG), ("end", _LONG), ("packets", _LONG)]
    + [("entry", _TEXT), ("order", _TEXT), ("resets", pa.bool_()), ("interfaces", _TEXT), ("needs", _LONG), ("problem", _TEXT), ("state", _TEXT)]
    + [("entries", pa.binary())]
)
PIECES = pa.schema(
    [("path", _TEXT), ("length", _LONG), ("begin", _LONG), ("start", _LONG), ("end", _LONG), ("first_no", _LONG), ("packets", _LONG)]
    + [("state", _TEXT), ("error", _TEXT)]
)
COUNTS = pa.schema([("path", _TEXT), ("packets", _LONG), ("error", _TEXT)])


def list_captures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the capture files; their bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True).load(folder)
    return files.where(admitted(F.col("path"), CAPTURE_EXTENSIONS)).select("path", "length", "modificationTime")


@lru_cache(maxsize=64)
def file_system(folder: str):
    """Arrow's file system for an address, and the path on it."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if colon and not rest.startswith("//"):
        rest = f"//{rest}"
    address = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest
    system, inner = fs.FileSystem.from_uri(address)
    return system, inner.rstrip("/")


@dataclass
class CaptureFile:
    path: str  # below the folder
    length: int
    changed: int


def files_of(folder: str) -> list[CaptureFile]:
    """The capture files of a folder and of those in it, as Spark lists files: hidden ones do not count."""
    from pyarrow import fs

    system, inner = file_system(folder)
    if system.get_file_info(inner).type == fs.FileType.File:
        found, inner = [system.get_file_info(inner)], inner.rpartition("/")[0]
    else:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    out = []
    for f in found:
        below = f.path[len(inner) :].lstrip("/")
        hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
        if f.is_file and not hidden and f.extension.lower() in CAPTURE_EXTENSIONS:
            out.append(CaptureFile(below, f.size, f.mtime_ns))
    return sorted(out, key=lambda f: f.path)


def open_file(folder: str, below: str):
    system, inner = file_system(folder)
    path = inner if inner.endswith(f"/{below}") and system.get_file_info(inner).is_file else f"{inner}/{below}"
    return io.BufferedReader(system.open_input_file(path), 1 << 16)


@dataclass
class Piece:
    """A run of records that one task reads; without an end it is the rest of the file."""

    path: str
    length: int
    start: int | None = None
    end: int | None = None
    first_no: int = 0
    packets: int | None = None
    state: str | None = None

    def bytes(self) -> int:
        return self.length if self.end is None else self.end - self.start


def read_piece(stream, piece: Piece, capture: str) -> Iterator[pa.RecordBatch]:
    """Packets of a piece, up to where a broken file can be read."""
    if piece.start is None:
        try:
            state, start = framing.open_state(stream)
        except CaptureError:
            return
    else:
        state, start = State.from_json(piece.state), piece.start
    walker = Walker(stream, piece.length, state, start)
    number = piece.first_no
    for run in walker.runs(piece.length if piece.end is None else piece.end):
        for at in range(0, len(run.heads), ROWS_PER_BATCH):
            part = Run(run.data, run.base, run.heads[at : at + ROWS_PER_BATCH], run.state)
            yield packets(part, capture, number)
            number += len(part.heads)


class Task(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def joined(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces in turn, those that follow on one another in a file put together: the walk of the first leads through the others."""
    chains: list[list[Piece]] = []
    for piece in pieces:
        last = chains[-1][-1] if chains else None
        if last is not None and last.path == piece.path and last.end is not None and last.end == piece.start:
            chains[-1].append(piece)
        else:
            chains.append([piece])
    return chains


def _whole(chain: list[Piece]) -> Piece:
    first, last = chain[0], chain[-1]
    counts = [piece.packets for piece in chain]
    return Piece(first.path, first.length, first.start, last.end, first.first_no, None if None in counts else sum(counts), first.state)


def tasks_of(pieces: list[Piece]) -> list[Task]:
    """Pieces in turn, to tasks of even size; opening a file counts as some bytes, and a small folder still gives some tasks.

    Pieces that follow on one another become one in a task, so that pieces of any size are read at the same cost.
    """
    chains = joined(pieces)
    total = sum(OPEN_BYTES + sum(piece.bytes() for piece in chain) for chain in chains)
    most = min(TASK_BYTES, max(OPEN_BYTES, total // LEAST_TASKS))
    tasks, size = [], most
    for chain in chains:
        left: list[Piece] = []
        for piece in chain:
            more = piece.bytes() + (0 if left else OPEN_BYTES)
            # What a task has opened it may as well read for some bytes.
            if size + more > most + (OPEN_BYTES if left else 0):
                if left:
                    tasks[-1].pieces.append(_whole(left))
                tasks.append(Task([]))
                left, size, more = [], 0, OPEN_BYTES + piece.bytes()
            size += more
            left.append(piece)
        tasks[-1].pieces.append(_whole(left))
    return tasks or [Task([])]


class _Packets:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        for piece in task.pieces:
            with open_file(self.folder, piece.path) as stream:
                yield from read_piece(stream, piece, piece.path)


class CaptureReader(_Packets, DataSourceReader):
    """Packets of all files, or of the pieces in the table named by the option ``pieces``."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.pieces_at = options.get("pieces")
        self.names: list = []
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the file's name leave out files; those on the packet number leave out pieces, and are looked at again by Spark."""
        for f in filters:
            named = getattr(f, "attribute", None) == ("capture_file",)
            if named and isinstance(f, EqualTo):
                self.names.append(lambda name, value=f.value: name == value)
            elif named and isinstance(f, In):
                self.names.append(lambda name, values=frozenset(f.value): name in values)
            elif named and isinstance(f, StringStartsWith):
                self.names.append(lambda name, value=f.value: name.startswith(value))
            else:
                if getattr(f, "attribute", None) == ("packet_no",):
                    self._number(f)
                yield f

    def _number(self, f: Filter) -> None:
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = f.value if self.high is None else min(self.high, f.value)

    def partitions(self) -> list[Task]:
        pieces = [Piece(f.path, f.length) for f in files_of(self.folder)] if self.pieces_at is None else _stored_pieces(self.pieces_at)
        kept = [
            p
            for p in pieces
            if all(fits(p.path) for fits in self.names)
            and (self.high is None or p.first_no <= self.high)
            and (p.packets is None or p.first_no + p.packets > self.low)
        ]
        return tasks_of(kept)


class CaptureStream(_Packets, DataSourceStreamReader):
    """Packets of files as they arrive. A file must be complete when it gets its name, and carry a time of change not before those before it."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.changed, f.path) for f in files_of(self.folder)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        after, until = (start["changed"], start["path"]), (end["changed"], end["path"])
        return tasks_of([Piece(f.path, f.length) for f in files_of(self.folder) if after < (f.changed, f.path) <= until])

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self):
        return from_arrow_schema(PACKETS)

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)


def register(spark: SparkSession) -> None:
    """Make ``captures`` known to the session, with filters pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def _stored_pieces(folder: str) -> list[Piece]:
    import pyarrow.dataset as ds

    system, inner = file_system(folder)
    table = ds.dataset(inner, filesystem=system, format="parquet").to_table(filter=ds.field("packets").is_null() | (ds.field("packets") > 0))
    table = table.sort_by([("path", "ascending"), ("start", "ascending")])
    return [Piece(*row.values()) for row in table.select(["path", "length", "start", "end", "first_no", "packets", "state"]).to_pylist()]


# Split walk of large files.


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches, whatever the number of files or segments that they come from."""
    while part := list(islice(rows, WALKS_PER_BATCH)):
        yield _batch(part, schema)


def _dealt(spark: SparkSession, pieces: list[Piece]) -> DataFrame:
    """One row and one partition for each task of ``tasks_of``: its pieces as (path, length, begin, stop)."""
    rows = [([(p.path, p.length, p.start or 0, p.length if p.end is None else p.end) for p in task.pieces],) for task in tasks_of(pieces)]
    schema = "pieces array<struct<path string, length bigint, begin bigint, stop bigint>>"
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)


def _pieces_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for row in _rows_of(batches):
        yield from row["pieces"]


def _guessed_walks(folder: str, segment_bytes: int):
    """Walks of the segments of the pieces; a file is opened, and its header read, once for all segments in a piece."""

    def walks_in(piece: dict) -> Iterator[dict]:
        length, state, broken = piece["length"], None, None
        with open_file(folder, piece["path"]) as stream:
            try:
                sight = framing.Sight(stream, length)
                state = sight.state.to_json()
            except CaptureError as error:
                broken = framing.Walk(0, 0, 0, "<", "<", False, "[]", 0, str(error))
            for begin in range(piece["begin"], max(piece["stop"], 1), segment_bytes):
                segment = {"path": piece["path"], "length": length, "begin": begin, "stop": min(begin + segment_bytes, length)}
                walks = [broken] if broken else list(framing.split_walks(stream, length, begin, segment["stop"], sight))
                # A segment without a good guess is a segment all the same.
                yield from [{**segment, "state": state, **vars(w)} for w in walks] or [segment]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for piece in _pieces_in(batches) for row in walks_in(piece)), WALKS)

    return run


def _known_walks(folder: str, n_segments: int, segment_bytes: int):
    """Walks from where a file's pieces ended, through some segments at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left in _rows_of(batches):
            path, length, begin, at = (left[c] for c in ("path", "length", "begin", "start"))
            state, rows = State.from_json(left["state"]), []
            with open_file(folder, path) as stream:
                while begin < length and len(rows) < n_segments:
                    stop = min(begin + segment_bytes, length)
                    if at < stop:
                        walk = framing.walk_segment(stream, length, state, at, stop, known=True)
                        rows.append({"path": path, "length": length, "begin": begin, "stop": stop, **vars(walk)})
                        if walk.problem:
                            break
                        at = walk.end
                    begin = stop
            yield _batch(rows, WALKS)

    return run


def _through(walks: list[dict], at: int, order: str) -> tuple[dict | None, int]:
    """The walk of a segment that starts at ``at``, or else one that passes there, with the number of its packets before."""
    walks = [w for w in walks if w["entry"] == order]
    for walk in reversed(walks):
        if walk["start"] == at:
            return walk, 0
    for walk in walks:
        places = np.frombuffer(walk["entries"] or b"", dtype=np.uint32)
        k = int(np.searchsorted(places, at - walk["begin"]))
        if k < len(places) and places[k] == at - walk["begin"]:
            return walk, k
    return None, 0


def _stitch(walks: pa.Table) -> pa.Table:
    """The pieces of one file as far as walks lead from its start; a last row without a count where they lead no further."""
    found = walks.sort_by([("begin", "ascending"), ("start", "ascending")]).to_pylist()
    path, length, first = found[0]["path"], found[0]["length"], found[0]
    if first["state"] is None:
        broken = dict(path=path, length=length, begin=0, start=0, end=0, first_no=0, packets=0, error=first["problem"])
        return pa.Table.from_pylist([broken], schema=PIECES)
    state, at, number, rows = State.from_json(first["state"]), first["start"], 0, []
    by_segment: dict[tuple[int, int], list[dict]] = {}
    for w in found:
        by_segment.setdefault((w["begin"], w["stop"]), []).append(w)
    for (begin, stop), walks in sorted(by_segment.items()):
        if at >= stop or at >= length:
            continue
        walk, ahead = _through(walks, at, state.order)
        known = dict(path=path, length=length, begin=begin, start=at, first_no=number, state=state.to_json())
        if walk is None or walk["needs"] > len(state.interfaces):
            rows.append({**known, "end": stop})
            break
        rows.append({**known, "end": walk["end"], "packets": walk["packets"] - ahead, "error": walk["problem"]})
        if walk["problem"]:
            break
        fresh = json.loads(walk["interfaces"])
        state.order, state.interfaces = walk["order"], fresh if walk["resets"] else state.interfaces + fresh
        at, number = walk["end"], number + walk["packets"] - ahead
    # A file without records is a file all the same.
    rows = rows or [dict(path=path, length=length, begin=0, start=at, end=at, first_no=0, packets=0, state=state.to_json())]
    return pa.Table.from_pylist(rows, schema=PIECES)


def cut_into_pieces(spark: SparkSession, folder: str, files: list[CaptureFile], segment_bytes: int) -> DataFrame:
    """Stored pieces (see PIECES) of the files, none much longer than a segment, numbered as one walk through each file would."""
    segments = [
        Piece(f.path, f.length, begin, min(begin + segment_bytes, f.length)) for f in files for begin in range(0, max(f.length, 1), segment_bytes)
    ]
    walks = store(_dealt(spark, segments).mapInArrow(_guessed_walks(folder, segment_bytes), from_arrow_schema(WALKS)), "walks")
    n_segments, finished = 1, None
    while True:
        pieces = store(walks.groupBy("path").applyInArrow(_stitch, from_arrow_schema(PIECES)), "pieces")
        open_ends = pieces.where("packets is null")
        left = open_ends.count()
        if not left:
            return pieces if finished is None else finished.unionByName(pieces)
        # Files that are done are not stitched again.
        paths = open_ends.select("path")
        done = pieces.join(paths, "path", "left_anti")
        finished = done if finished is None else finished.unionByName(done)
        # Nearly always the guesses suffice. Where they keep failing, walks get longer, so that the rounds stay few.
        tasks = min(left, max(LEAST_TASKS, left * (OPEN_BYTES + n_segments * segment_bytes) // TASK_BYTES))
        again = open_ends.repartition(tasks).mapInArrow(_known_walks(folder, n_segments, segment_bytes), from_arrow_schema(WALKS))
        known = store(again, "walks")
        places = known.select("path", "begin").distinct()
        # A walk from a known place replaces the guesses for its segment, but for the file's header.
        kept = walks.join(paths, "path", "left_semi").join(places.where("begin > 0"), ["path", "begin"], "left_anti")
        walks = store(kept.unionByName(known), "walks")
        n_segments *= 2


class CaptureFolder:
    """The captures of a folder: ``packets()`` and ``status()``."""

    def __init__(self, spark: SparkSession, folder: str, segment_bytes: int = SEGMENT_BYTES):
        register(spark)
        self.spark, self.folder = spark, folder
        files = files_of(folder)
        # A file of one segment needs no pieces: its walk starts at its start.
        self.small = [f for f in files if f.length <= segment_bytes]
        large = [f for f in files if f.length > segment_bytes]
        self.cut = cut_into_pieces(spark, folder, large, segment_bytes) if large else None
        self.pieces_at = None
        if large:
            whole = spark.createDataFrame([(f.path, f.length, 0) for f in self.small], "path string, length bigint, first_no bigint")
            self.pieces_at = fresh_path(spark, "pieces")
            self.cut.unionByName(whole, allowMissingColumns=True).write.parquet(self.pieces_at)

    def packets(self) -> DataFrame:
        reader = self.spark.read.format("captures")
        if self.pieces_at is not None:
            reader = reader.option("pieces", self.pieces_at)
        return reader.load(self.folder)

    def status(self) -> DataFrame:
        """One row per capture: packets read, ``ok`` or ``error``, and the message."""
        folder = self.folder

        def count(piece: dict) -> dict:
            with open_file(folder, piece["path"]) as stream:
                n, problem = framing.count(stream, piece["length"])
            return {"path": piece["path"], "packets": n, "error": problem}

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches((count(piece) for piece in _pieces_in(batches)), COUNTS)

        listed = _dealt(self.spark, [Piece(f.path, f.length) for f in self.small])
        found = listed.mapInArrow(walk, from_arrow_schema(COUNTS))
        if self.cut is not None:
            found = found.unionByName(self.cut.select("path", "packets", "error"))
        return status_of_pieces(found, F.col("path"))


# Captures that are held in a column.


def packets_of_contents(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Packets of captures in the columns (path, content), each of which is small enough for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["capture_file"].to_pylist(), batch["content"], strict=True):
                stream = pa.BufferReader(content.as_buffer()) if content.is_valid else pa.BufferReader(b"")
                yield from read_piece(stream, Piece(name, stream.size()), name)

    return files.select(capture_name(depth).alias("capture_file"), "content").mapInArrow(run, from_arrow_schema(PACKETS))


def pieces_of_contents(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            content = row["content"] or b""
            n, problem = framing.count(io.BytesIO(content), len(content))
            yield _batch([{"path": row["path"], "packets": n, "error": problem}], COUNTS)

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(COUNTS))


def capture_name(depth: int | None) -> Column:
    """The capture's path below a folder of ``depth`` parts; without a folder its file name."""
    return file_name(F.col("path")) if depth is None else path_below(F.col("path"), depth)


def status_of_pieces(found: DataFrame, name: Column | None = None) -> DataFrame:
    """One row per capture: packets read, ``ok`` or ``error``, and the message."""
    return (
        found.groupBy((capture_name(None) if name is None else name).alias("capture_file"))
        .agg(F.sum("packets").alias("packets"), F.max("error").alias("error"))
        .select(
            "capture_file",
            F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
            "packets",
            "error",
        )
    )


def read_captures(spark: SparkSession, folder: str, label: str | None = None) -> DataFrame:
    """Packet table of all captures of a folder, optionally with one label."""
    found = CaptureFolder(spark, folder).packets()
    return found if label is None else found.withColumn("label", F.lit(label))
