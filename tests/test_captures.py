"""Capture files made byte by byte, decoded and compared with what was put in."""

from __future__ import annotations

import io
import random
import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from trafficlens.sources import captures as source
from trafficlens.sources import framing
from trafficlens.sources.captures import CaptureFolder, CaptureReader, list_captures, read_captures, register
from trafficlens.sources.decode import packets

START = 1_700_000_000


def ip4(protocol, body, src="10.0.0.1", dst="192.168.7.9", ttl=64, fragment=0, options=b""):
    words = 5 + len(options) // 4
    head = struct.pack(">BBHHHBBH", 0x40 | words, 0, 20 + len(body), 0, fragment, ttl, protocol, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + options + body


def tcp(src=1234, dst=80, flags=0x12, window=4096, payload=b"", options=b""):
    words = 5 + len(options) // 4
    return struct.pack(">HHIIHHHH", src, dst, 0, 0, words << 12 | flags, window, 0, 0) + options + payload


def udp(src=5353, dst=53, payload=b""):
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload


def dns(name):
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) if name else b""
    return struct.pack(">HHHHHH", 7, 0x100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", 1, 1)


def ether(kind, body, tags=()):
    return b"\1" * 12 + b"".join(struct.pack(">HH", t, 5) for t in tags) + struct.pack(">H", kind) + body


def ip6(protocol, body):
    return struct.pack(">IHBB", 6 << 28, len(body), protocol, 64) + b"\0" * 32 + body


FRAMES = [
    (ether(0x0800, ip4(6, tcp(payload=b"GET /index HTTP/1.1\r\n"))),
     dict(ip_src="10.0.0.1", ip_dst="192.168.7.9", src_port=1234, dst_port=80, protocol=6, ttl=64, tcp_flags="0x0012",
          tcp_window_size=4096, http_method="GET")),
    (ether(0x0800, ip4(6, tcp(flags=0x002, options=b"\2\4\5\xb4", payload=b"OPTIONS * HTTP/1.1"), options=b"\1" * 8)),
     dict(protocol=6, tcp_flags="0x0002", http_method="OPTIONS", src_port=1234)),
    (ether(0x0800, ip4(6, tcp(payload=b"GETTING closer"))), dict(http_method=None, tcp_flags="0x0012")),
    (ether(0x0800, ip4(17, udp(payload=dns("www.example.org")))),
     dict(protocol=17, src_port=5353, dst_port=53, udp_length=8 + 33, dns_query="www.example.org", tcp_flags=None)),
    (ether(0x0800, ip4(17, udp(dst=999, payload=b"x"))), dict(dns_query=None, dst_port=999, udp_length=9)),
    (ether(0x0800, ip4(6, tcp(dst=53, payload=b"\0\x1c" + dns("a.b")))), dict(dns_query="a.b", dst_port=53)),
    (ether(0x0800, ip4(1, b"\x08\0\0\0", ttl=3)), dict(protocol=1, icmp_type=8, ttl=3, src_port=None)),
    (ether(0x0806, b"\0" * 28), dict(protocol=None, ip_src=None, ttl=None, src_port=None)),
    (ether(0x0800, ip4(6, tcp()), tags=(0x8100,)), dict(protocol=6, dst_port=80)),
    (ether(0x0800, ip4(6, tcp()), tags=(0x88A8, 0x8100)), dict(protocol=6, dst_port=80)),
    (ether(0x86DD, ip6(6, tcp(dst=443))), dict(protocol=None, ip_src=None, dst_port=443, tcp_flags="0x0012")),
    (ether(0x0800, ip4(17, b"\1\2\3\4\5\6\7\x08", fragment=100)), dict(protocol=17, src_port=None, udp_length=None)),
    (ether(0x0800, ip4(6, b"\4\xd2")), dict(protocol=6, src_port=1234, dst_port=None, tcp_flags=None)),
]


def classic(frames, order="<", nanos=False, link=1, cut=0):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)]
    for i, frame in enumerate(frames):
        fraction = (i * 10 + 3) * (1000 if nanos else 1)
        out.append(struct.pack(order + "IIII", START + i, fraction, len(frame), len(frame) + 100) + frame)
    data = b"".join(out)
    return data[: len(data) - cut]


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def ng(frames, order="<", resolution=None):
    out = [block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))]
    option = b"" if resolution is None else struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0)
    out.append(block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + option))
    out.append(block(order, 5, b"statistics  "))
    units = 10 ** (6 if resolution is None else resolution)
    for i, frame in enumerate(frames):
        stamp = (START + i) * units + (i * 10 + 3) * units // 10**6
        head = struct.pack(order + "IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(frame), len(frame) + 100)
        out.append(block(order, 6, head + frame))
    return b"".join(out)


BYTES = [f for f, _ in FRAMES]


@pytest.fixture()
def folder(tmp_path):
    files = {
        "little.pcap": classic(BYTES),
        "big.PCAP": classic(BYTES, ">"),
        "nanos.pcap": classic(BYTES, nanos=True),
        "ng.pcapng": ng(BYTES),
        "ng_big_nanos.pcapng": ng(BYTES, ">", 9),
        "cut.pcap": classic(BYTES, cut=5),
        "empty.pcap": classic([]),
        "broken.pcap": b"this is no capture",
        "notes.txt": b"not looked at",
        "other.pcapx": b"not looked at",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path.as_uri()


GOOD = ("little.pcap", "big.PCAP", "nanos.pcap", "ng.pcapng", "ng_big_nanos.pcapng")


@pytest.mark.parametrize("segment", [1 << 20, 300])
def test_decode(spark, folder, segment):
    """Whole files, and files cut in pieces of about 300 bytes."""
    captures = CaptureFolder(spark, folder, segment_bytes=segment)
    rows: dict = {}
    for r in captures.packets().collect():
        rows.setdefault(r["capture_file"], {})[r["packet_no"]] = r
    for name in GOOD:
        assert sorted(rows[name]) == list(range(len(FRAMES)))
        for i, (frame, want) in enumerate(FRAMES):
            row = rows[name][i]
            assert row["packet_length"] == len(frame) + 100
            assert row["ts_us"] == (START + i) * 1_000_000 + i * 10 + 3
            for column, value in want.items():
                assert row[column] == value, (name, i, column)
    assert len(rows["cut.pcap"]) == len(FRAMES) - 1
    assert set(rows) == {*GOOD, "cut.pcap"}
    status = {r["capture_file"]: (r["status"], r["packets"]) for r in captures.status().collect()}
    assert status == {
        **{name: ("ok", len(FRAMES)) for name in GOOD},
        "cut.pcap": ("error", len(FRAMES) - 1), "empty.pcap": ("ok", 0), "broken.pcap": ("error", 0),
    }


def test_list_and_label(spark, folder):
    names = {r["path"].rsplit("/", 1)[1] for r in list_captures(spark, folder).collect()}
    assert names == {*GOOD, "cut.pcap", "empty.pcap", "broken.pcap"}
    labels = read_captures(spark, folder, "ddos").select("label").distinct().collect()
    assert [r["label"] for r in labels] == ["ddos"]


def sequential(data):
    """Positions of all packet records by one walk, and what is wrong with the file."""
    stream = io.BytesIO(data)
    state, start = framing.open_state(stream)
    walker = framing.Walker(stream, len(data), state, start)
    return [run.base + int(h) for run in walker.runs(len(data)) for h in run.heads], walker.problem


def split(data, segment):
    """The pieces as the Spark jobs make them, in this process; with the number of rounds."""
    stream, rows, n = io.BytesIO(data), [], len(data)
    for begin in range(0, n, segment):
        stop = min(begin + segment, n)
        walks = list(framing.split_walks(stream, n, begin, stop))
        base = {"path": "x", "length": n, "begin": begin, "stop": stop, "state": framing.open_state(stream)[0].to_json()}
        rows += [{**base, **vars(w)} for w in walks] or [base]
    for rounds in range(100):
        pieces = source._stitch(pa.Table.from_pylist(rows, schema=source.WALKS)).to_pylist()
        left = [p for p in pieces if p["packets"] is None]
        if not left:
            return pieces, rounds
        begin, at, state = left[0]["begin"], left[0]["start"], framing.State.from_json(left[0]["state"])
        stop = min(begin + segment, n)
        walk = framing.walk_segment(stream, n, state, at, stop, known=True)
        rows = [r for r in rows if r["begin"] != begin or begin == 0]
        rows.append({"path": "x", "length": n, "begin": begin, "stop": stop, **vars(walk)})
    raise AssertionError("no end")


def same_as_sequential(data, segment):
    heads, problem = sequential(data)
    pieces, rounds = split(data, segment)
    assert [p["first_no"] for p in pieces] == [sum(q["packets"] for q in pieces[:k]) for k in range(len(pieces))]
    found, stream = [], io.BytesIO(data)
    for p in pieces:
        if p["packets"]:
            walker = framing.Walker(stream, len(data), framing.State.from_json(p["state"]), p["start"])
            own = [(run.base + int(h), run.state) for run in walker.runs(p["end"]) for h in run.heads]
            assert len(own) == p["packets"]
            found += own
    assert [h for h, _ in found] == heads and pieces[-1]["error"] == problem
    stream = io.BytesIO(data)
    state, start = framing.open_state(stream)
    states = [run.state for run in framing.Walker(stream, len(data), state, start).runs(len(data)) for _ in run.heads]
    assert [s for _, s in found] == states
    return rounds


@pytest.mark.parametrize("data", [classic(BYTES), classic(BYTES, ">", True), ng(BYTES), ng(BYTES, ">", 9), classic(BYTES, cut=5), classic([])])
def test_pieces_cover_the_file(data):
    for size in (30, 100, 500, 10_000):
        same_as_sequential(data, size)


def random_frames(rng, n):
    """Frames of many sizes, some of which carry capture files, runs of zeros or single headers."""
    inner = classic(BYTES * 3)[24:]
    kinds = (lambda: rng.randbytes(rng.randrange(1, 400)), lambda: bytes(rng.randrange(1, 900)), lambda: inner[rng.randrange(200) :],
             lambda: struct.pack("<IIII", START, 5, 8, 8) * rng.randrange(1, 40), lambda: ng(BYTES * 2)[rng.randrange(0, 64, 4) :])
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_payloads_like_headers(seed):
    rng = random.Random(seed)
    frames = random_frames(rng, 150)
    for data in (classic(frames), classic(frames, ">"), ng(frames), ng(frames, ">", 9), classic(frames, cut=40), ng(frames)[:-30]):
        for size in (700, 5_000, 1 << 20):
            same_as_sequential(data, size)


def test_guesses_lead_on_from_decoys():
    """Payloads of records that end with their frame, whose walks run into the true one, need no second round; nor do short wire lengths."""
    rng = random.Random(3)
    decoys = struct.pack("<IIII", START, 0, 8, 8) + b"\xab" * 8
    frames = [b"\1" * 42 + decoys * 20 if rng.random() < 0.4 else rng.randbytes(rng.randrange(50, 90)) for _ in range(400)]
    data = bytearray(classic(frames))
    assert same_as_sequential(bytes(data), 1 << 10) == 0
    at = 24
    for frame in frames:
        struct.pack_into("<I", data, at + 12, 60)  # on the wire
        at += 16 + len(frame)
    assert same_as_sequential(bytes(data), 1 << 10) == 0


def test_segments_are_read_once():
    """Walking segment by segment reads about the file's size, not a block or the reach of a guess for each of them."""

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    data = classic([b"\1" * 100] * 20_000)
    stream = Counting(data)
    sight = framing.Sight(stream, len(data))
    for begin in range(0, len(data), 1 << 13):
        assert list(framing.split_walks(stream, len(data), begin, min(begin + (1 << 13), len(data)), sight))
    assert stream.taken < 6 * len(data)


def test_pieces_that_follow_are_one_to_a_task():
    pieces = [source.Piece("a", 100 << 20, k << 13, k + 1 << 13, k, 1, "s") for k in range(12_800)] + [source.Piece("b", 10)]
    tasks = source.tasks_of(pieces)
    assert len(tasks) <= 2 * source.LEAST_TASKS
    found = [p for t in tasks for p in t.pieces]
    assert len(found) <= len(tasks) + 1 and found[-1].path == "b"
    assert [p.start for p in found[1:-1]] == [p.end for p in found[:-2]] and sum(p.packets for p in found[:-1]) == 12_800
    assert all(p.first_no == p.start >> 13 for p in found[:-1])


def test_many_files_are_few_tasks(spark, tmp_path):
    """Status and guesses deal files and segments out by bytes, not one to a task."""
    for k in range(200):
        (tmp_path / f"{k:03d}.pcap").write_bytes(classic(BYTES))
    captures = CaptureFolder(spark, tmp_path.as_uri())
    plans = []
    found = source._dealt(spark, [source.Piece(f.path, f.length) for f in captures.small])
    plans.append(found.rdd.getNumPartitions())
    segments = [source.Piece(f.path, f.length, at, min(at + 100, f.length)) for f in captures.small for at in range(0, f.length, 100)]
    plans.append(source._dealt(spark, segments).rdd.getNumPartitions())
    assert all(source.LEAST_TASKS <= n <= source.LEAST_TASKS + 8 for n in plans)
    assert {(r["status"], r["packets"]) for r in captures.status().collect()} == {("ok", len(FRAMES))}
    assert captures.status().count() == 200


def test_interfaces_and_sections_in_the_middle():
    """Interfaces declared between packets, and sections of the other byte order."""
    rng = random.Random(8)
    out = b""
    for order in ("<", ">", "<"):
        part = ng(random_frames(rng, 25), order)
        more = [block(order, 1, struct.pack(order + "HHI", 101, 0, 0)), block(order, 77, b"private!")]
        for k in range(25):
            frame = random_frames(rng, 1)[0]
            more.append(block(order, 6, struct.pack(order + "IIIII", k % 2, 5, 6, len(frame), len(frame)) + frame))
            more.append(block(order, 3, struct.pack(order + "I", len(frame)) + frame))
        out += part + b"".join(more)
    for data in (out, out + block("<", 6, struct.pack("<IIIII", 9, 5, 6, 0, 0)) + out):
        for size in (400, 3_000):
            same_as_sequential(data, size)


def test_a_record_longer_than_a_block(monkeypatch):
    frames = [b"a" * 50, b"b" * 5_000, b"c" * 70_000, b"d"]
    for data in (classic(frames), ng(frames)):
        stream = io.BytesIO(data)
        state, start = framing.open_state(stream)
        walker = framing.Walker(stream, len(data), state, start, block=64)
        assert sum(len(r.heads) for r in walker.runs(len(data))) == 4 and walker.problem is None


def decoded(frames):
    stream = io.BytesIO(classic(frames))
    state, start = framing.open_state(stream)
    (run,) = framing.Walker(stream, len(stream.getvalue()), state, start).runs(1 << 40)
    return packets(run, "x", 0).to_pylist()


def test_odd_names():
    def query(raw, questions=1):
        return ether(0x0800, ip4(17, udp(payload=struct.pack(">HHHHHH", 7, 0x100, questions, 0, 0, 0) + raw)))

    cases = [
        (query(b"\3www\2\xe9\xff\0"), "www.\xe9\xff"),
        (query(b"\3www\0", 0), None),
        (query(b"\0"), None),
        (query(b"\5ab"), "ab"),
        (query(b"\3abc\x05d"), "abc.d"),
        (query(b"\3abc\xc0\x0c"), "abc"),
        (query(b"\1a" * 200), ".".join("a" * 127)),
        (query(b""), None),
    ]
    assert [r["dns_query"] for r in decoded([f for f, _ in cases])] == [want for _, want in cases]


def test_frames_cut_anywhere():
    """Whatever the length at which a frame is cut, the fields it still has are there."""
    whole = FRAMES[0][0]
    rows = decoded([whole[:k] for k in range(1, len(whole) + 1)])
    for k, row in enumerate(rows, 1):
        assert (row["src_port"] == 1234) == (k >= 36) and (row["tcp_flags"] == "0x0012") == (k >= 48) and (row["ttl"] == 64) == (k >= 23)
        assert (row["http_method"] == "GET") == (k >= 58)


def test_reader_takes_conditions(folder):
    def kept(*filters, **options):
        reader = CaptureReader({"path": folder, **options})
        rest = list(reader.pushFilters(list(filters)))
        return sorted(p.path for t in reader.partitions() for p in t.pieces), rest

    name = ("capture_file",)
    assert kept(EqualTo(name, "ng.pcapng")) == (["ng.pcapng"], [])
    assert kept(In(name, ("ng.pcapng", "cut.pcap", "none"))) == (["cut.pcap", "ng.pcapng"], [])
    assert kept(StringStartsWith(name, "ng")) == (["ng.pcapng", "ng_big_nanos.pcapng"], [])
    low = GreaterThanOrEqual(("packet_no",), 3)
    assert kept(StringStartsWith(name, "big"), low) == (["big.PCAP"], [low])


def test_pieces_are_left_out_by_number(spark, folder):
    captures = CaptureFolder(spark, folder, segment_bytes=300)
    reader = CaptureReader({"path": folder, "pieces": captures.pieces_at})
    low, high = GreaterThanOrEqual(("packet_no",), 5), LessThan(("packet_no",), 7)
    assert list(reader.pushFilters([low, high])) == [low, high]
    pieces = [p for t in reader.partitions() for p in t.pieces]
    assert pieces and all(p.first_no <= 7 and p.first_no + p.packets > 5 for p in pieces if p.packets is not None)
    found = captures.packets().where("packet_no >= 5 and packet_no < 7").groupBy("capture_file").count().collect()
    assert {(r["capture_file"], r["count"]) for r in found} == {(name, 2) for name in (*GOOD, "cut.pcap")}


def test_stream_of_files(spark, tmp_path):
    """Files that are moved in between two runs of a stream are read once each."""
    register(spark)
    landing, out = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()

    def run():
        stream = spark.readStream.format("captures").load(landing.as_uri())
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(
            availableNow=True
        ).start().awaitTermination()
        return {(r["capture_file"], r["count"]) for r in spark.read.parquet(str(out)).groupBy("capture_file").count().collect()}

    (landing / "a.pcap").write_bytes(classic(BYTES))
    assert run() == {("a.pcap", len(BYTES))}
    (landing / "sub").mkdir()
    (landing / "sub" / "a.pcapng").write_bytes(ng(BYTES))
    (landing / "broken.pcap").write_bytes(b"no capture")
    assert run() == {("a.pcap", len(BYTES)), ("sub/a.pcapng", len(BYTES))}


def test_raw_link_types(spark, tmp_path):
    raw = ip4(6, tcp(dst=8080))
    (tmp_path / "raw.pcap").write_bytes(classic([raw], link=101))
    (tmp_path / "null.pcap").write_bytes(classic([b"\2\0\0\0" + raw], link=0))
    (tmp_path / "sll.pcap").write_bytes(classic([b"\0" * 14 + b"\x08\0" + raw], link=113))
    rows = read_captures(spark, tmp_path.as_uri()).collect()
    assert [(r["dst_port"], r["ip_src"]) for r in rows] == [(8080, "10.0.0.1")] * 3


def test_batch_status_of_held_captures(spark, small):
    from trafficlens.catalog import learning_queries

    rows = {r["capture_file"]: r for r in learning_queries.batch_status(spark, small).collect()}
    days = {name: int(re.search(r"cap_(\d+)", name)[1]) for name in rows}
    assert {rows[n]["status"] for n, day in days.items() if day % 5 and day % 7} == {"ok"}
    assert {(rows[n]["status"], rows[n]["total_packets"]) for n, day in days.items() if not (day % 5 and day % 7)} == {("error", 0)}
    assert all(rows[n]["total_packets"] > 0 for n in rows if rows[n]["status"] == "ok")
