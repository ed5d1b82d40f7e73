from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from trafficlens.llm import warc
from trafficlens.llm.tables import fresh_path


class Stream(io.BytesIO):
    pass


PAYLOADS = [
    b"", b"<p>plain</p>", b"x" * 700_000, bytes(range(256)) * 300,
    # Something that looks like a member, and a whole one, inside a payload that does not compress.
    warc.GZIP_MAGIC * 50, gzip.compress(b"WARC no record") + hashlib.sha512(b"1").digest() * 3,
]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("split", [7, 100, 4096, 1 << 20])
def test_each_record_is_read_once_whatever_the_ranges(split):
    records = [(k, f"http://host/{k} \r\né", p, digest(p), None) for k, p in enumerate(PAYLOADS)]
    records += [(100 + k, None, p, digest(p), k) for k, p in enumerate(PAYLOADS)]
    raw = b"".join(warc.record(*r) for r in records)
    if split == 7:
        raw = b"".join(warc.record(*r) for r in records if len(r[2]) < 1000)
        records = [r for r in records if len(r[2]) < 1000]
    rows = [row for at in range(0, len(raw), split) for row in warc.read_range(Stream(raw), at, min(at + split, len(raw)))]
    want = [(k, len(p), d, "response" if old is None else "revisit", old) for k, _, p, d, old in records]
    assert sorted(rows) == sorted(want)


def test_the_archive_is_plain_gzip():
    raw = warc.record(5, "http://a/b c", b"<p>", digest(b"<p>"), None) + warc.record(6, None, b"<p>", digest(b"<p>"), 5)
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a/b%20c\r\n" in text
    assert "WARC-Refers-To: <urn:page:5>" in text and text.count("<p>\r\n\r\n") == 1


def test_damage_is_noticed():
    raw = bytearray(warc.record(5, None, b"some payload " * 50, digest(b"other"), None))
    with pytest.raises(ValueError):
        list(warc.read_range(Stream(bytes(raw)), 0, len(raw)))


def test_round_trip(spark, monkeypatch):
    pages = [(3, "u", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (9, "v", "same"), (4, "w", "é😀" * 50_000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, refers_to string, size string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in pages:
        raw, old = (html or "").encode(), first.get(html or "")
        again = i is not None and old != i
        want.append((i, len(raw), digest(raw), "revisit" if again else "response", old if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_short_payloads_are_not_revisited_and_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    df = spark.range(60).selectExpr("id as page_id", "'u' as url", "repeat(cast(id % 3 as string), cast(id % 3 * 5 as int)) as html")
    folder = fresh_path(spark, "rolled")
    files = warc.write(df, folder, min_bytes=6)
    assert files.count() > 8
    rows = {r.page_id: r for r in warc.read(files, folder, split_bytes=300).collect()}
    assert len(rows) == 60 and all((r.record_type == "revisit") == (i % 3 == 2 and i > 2) for i, r in rows.items())
    assert all(r.refers_to == 2 for r in rows.values() if r.record_type == "revisit")
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    assert len(system.get_file_info(fs.FileSelector(root))) == files.count()
