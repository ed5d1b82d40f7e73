"""WARC archives: a writer that replaces repeated payloads by revisit records, and a reader that splits files anywhere.

Every record is a gzip member of its own. The reader cuts each file into byte ranges. A task looks for the gzip magic in
its range, and takes a place for the start of a member if what follows decompresses to the beginning of a WARC
record; it owns the records that start inside its range and reads past its end to finish the last one. Where a member
ends, the next one starts or the search goes on. Members are decompressed in pieces, so a task holds one block of file and
one payload block at a time, whatever the length of a record.

Payloads of at least MIN_BYTES that equal an earlier page's (smallest page_id) become revisits, which carry the payload's
digest and, in their HTTP headers, its length. Tasks write under names of their own and report them; only reported files are read.

Defined cases: a null html is an empty payload; a null url is left out. Rows with a null page_id are written and read with a null page_id,
and never serve as the original. Repeated rows of a page_id are written each; all refer to the smallest id.
Control characters and spaces in urls are percent-encoded. No rows: no files, and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.tables import fresh_path, shuffle_width, store

MIN_BYTES = 0
#: A file is closed once it has as many bytes; a range of a split has as many at most.
FILE_BYTES = 1 << 30
SPLIT_BYTES = 4 << 20
BLOCK = 1 << 18
LEVEL = 6
# Fixed values of the public formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
MAX_HEAD = 1 << 20

RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(sha1: hashlib._Hash) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _page_uri(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Length", len(block)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~<>{}|^`\"\\")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_uri(refers_to))]
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + HEAD_END
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


class Member:
    """The gzip member that may start at ``at``; ``row`` once it was read to its end."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at
        self.unpacker = zlib.decompressobj(31)

    def _more(self) -> bytes:
        """The next decompressed bytes, at most BLOCK; nothing at the end of the member."""
        while not self.unpacker.eof:
            packed = self.unpacker.unconsumed_tail
            if not packed:
                self.stream.seek(self.at)
                packed = self.stream.read(BLOCK)
                if not packed:
                    raise zlib.error("the member is cut off")
                self.at += len(packed)
            out = self.unpacker.decompress(packed, BLOCK)
            if out:
                return out
        return b""

    def _until(self, held: bytes) -> tuple[bytes, bytes]:
        while HEAD_END not in held:
            more = self._more()
            if not more or len(held) > MAX_HEAD:
                raise zlib.error("no end of headers")
            held += more
        head, _, rest = held.partition(HEAD_END)
        return head, rest

    def begins_record(self) -> bytes | None:
        """The first bytes if they are those of a WARC record."""
        try:
            held = b""
            while len(held) < 7 and (more := self._more()):
                held += more
        except zlib.error:
            return None
        return held if held.startswith(b"WARC/1.") else None

    def row(self, held: bytes) -> tuple | None:
        """(page_id, payload bytes, digest, type, refers_to); None for records of other types."""
        head, rest = self._until(held)
        warc = _headers(head)
        kind, left = warc.get("warc-type"), int(warc["content-length"])
        length, sha1 = 0, hashlib.sha1()
        if kind in ("response", "revisit"):
            http, payload = self._until(rest)
            left -= len(http) + len(HEAD_END)
            declared = int(_headers(http)["content-length"])
            while left > 0:
                part = payload[:left]
                sha1.update(part)
                length += len(part)
                left -= len(part)
                if left > 0 and not (payload := self._more()):
                    raise zlib.error("the payload is cut off")
        while self._more():
            pass
        if kind not in ("response", "revisit"):
            return None
        stated = warc["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (stated != digest_of(sha1) or length != declared):
            raise ValueError(f"damaged payload of {warc['warc-record-id']}")
        return _page_of(warc["warc-record-id"]), declared, stated, kind, _page_of(warc.get("warc-refers-to"))

    def end(self) -> int:
        return self.at - len(self.unpacker.unused_data)


def read_range(stream, start: int, stop: int) -> Iterator[tuple]:
    """Rows of the records that start in ``[start, stop)``."""
    at, window, window_at = start, b"", start
    while at < stop:
        if not window_at <= at < window_at + len(window):
            stream.seek(at)
            window, window_at = stream.read(min(BLOCK, stop - at) + len(GZIP_MAGIC) - 1), at
        place = window.find(GZIP_MAGIC, at - window_at)
        if place < 0 or window_at + place >= stop:
            # The last bytes may begin a magic, so the next window starts with them.
            following = window_at + len(window) - len(GZIP_MAGIC) + 1
            if following >= stop or following <= at:
                return
            at, window = following, b""
            continue
        at = window_at + place
        member = Member(stream, at)
        first = member.begins_record()
        if first is None:
            at += 1
            continue
        found = member.row(first)
        if found:
            yield found
        at = member.end()


def originals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html and refers_to (the smallest page_id with an equal payload, null for that page itself).

    Only ids, lengths and digests are grouped, with map-side combining; the payloads are shuffled once, by id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marks = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1")).where("page_id is not null")
    first = marks.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    repeated = first.where("first < last").select("sha1", "size", "first")
    again = marks.join(repeated, ["sha1", "size"]).where("page_id > first")
    again = again.groupBy(F.col("page_id").alias("again_id"), "sha1").agg(F.min("first").alias("refers_to"))
    texts = pages.select("page_id", "url", "html")
    same = (F.col("page_id") == F.col("again_id")) & (F.sha1(payload) == F.col("sha1"))
    return texts.join(again, same, "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to files in ``folder``; the list of files: path, bytes."""

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        stream, size, done = None, 0, []
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refers_to in zip(*columns):
                if stream is None:
                    name, size = f"{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode()
                size += stream.write(record(page_id, url, payload, digest_of(hashlib.sha1(payload)), refers_to))
                if size >= FILE_BYTES:
                    stream.close()
                    done.append({"path": name, "bytes": size})
                    stream = None
        if stream is not None:
            stream.close()
            done.append({"path": name, "bytes": size})
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return store(originals(pages, min_bytes).mapInArrow(write_part, "path string, bytes long"), "warc-files")


def read(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RESULT of every response and revisit record in the listed files."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "bytes", starts.alias("start")).select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("stop"))

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop"))):
                with system.open_input_file(f"{root}/{path}") as stream:
                    rows = list(read_range(stream, start, stop))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], list(names))

    dealt = ranges.repartition(shuffle_width(files.sparkSession), "path", "start")
    return dealt.mapInArrow(read_part, RESULT)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)
