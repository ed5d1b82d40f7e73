"""Cut capture bytes into packet records (classic pcap and pcapng), from the start of a file or from any byte of it.

Only record headers are read here, as arrays of positions. What is inside a frame is decoded by ``decode``.

The formats have no sync marks, so a walk that starts in the middle of a file guesses: it takes every byte that could start a record and from
which a chain of plausible headers leads on. ``split_walks`` follows all such chains to the end of a segment. Whether a guess was
right is decided later, by ``stitch``: the walk of the segment before tells where the first record of the next one really starts.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import BinaryIO

import numpy as np

# Fixed values of the two file formats.
CLASSIC_MICROS = 0xA1B2C3D4
CLASSIC_NANOS = 0xA1B23C4D
NG_SECTION = 0x0A0D0D0A
NG_ORDER = 0x1A2B3C4D
NG_INTERFACE, NG_OLD_PACKET, NG_SIMPLE_PACKET, NG_ENHANCED_PACKET = 1, 2, 3, 6
NG_OPT_TSRESOL, NG_OPT_TSOFFSET = 9, 14

CUT = "the capture is cut short in the middle of a packet"
#: Bytes read at once.
BLOCK = 16 << 20
#: A guessed start needs so many plausible headers in a row, and is looked for in so many bytes of a segment.
CHAIN = 8
REACH = 1 << 20
#: Bytes read behind what a walk is asked for, as the last record may end there; more are read where it is longer.
SLACK = 1 << 12
#: A guessed walk tells which records it meets in so many bytes of its segment, as the first record may be any of them.
NEAR = 1 << 16
#: Chains of one segment that are followed to its end; if none of them is right, the segment is walked again.
MAX_CHAINS = 16
#: Frames are not longer than this where a file does not say so itself.
LONGEST = 1 << 18


class CaptureError(Exception):
    """The bytes are no capture, or end in the middle of a packet."""


@dataclass
class State:
    """All a reader must know to go on from a given offset."""

    ng: bool = False
    order: str = "<"
    units: int = 1_000_000  # classic: fractions of a second in a time stamp
    link: int = 1
    snap: int = 0  # classic: longest frame by the file header
    interfaces: list[list[int]] = field(default_factory=list)  # ng: link, units, offset seconds, snap length

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> State:
        return State(**json.loads(text))


@dataclass
class Run:
    """Packet records that share one list of interfaces: positions of their headers in ``data``."""

    data: bytes
    base: int
    heads: np.ndarray
    state: State


def open_state(stream: BinaryIO) -> tuple[State, int]:
    """The file header and where the records start; pcapng keeps its header in an ordinary block."""
    stream.seek(0)
    head = stream.read(24)
    if len(head) < 4:
        raise CaptureError("not a capture file: too short")
    if head[:4] == struct.pack("<I", NG_SECTION):
        return State(ng=True), 0
    for order in "<>":
        magic = struct.unpack(order + "I", head[:4])[0]
        if magic in (CLASSIC_MICROS, CLASSIC_NANOS):
            if len(head) < 24:
                raise CaptureError(CUT)
            snap, link = struct.unpack(order + "II", head[16:24])
            units = 1_000_000 if magic == CLASSIC_MICROS else 1_000_000_000
            return State(order=order, units=units, link=link & 0x0FFFFFFF, snap=snap), 24
    raise CaptureError("not a capture file: unknown magic number")


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, length = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + length]
        at += 4 + (length + 3) // 4 * 4


def _interface(body: bytes, order: str) -> list[int]:
    if len(body) < 8:
        raise CaptureError("broken interface block")
    link, _, snap = struct.unpack_from(order + "HHI", body)
    units, shift = 1_000_000, 0
    for code, value in _options(body[8:], order):
        if code == NG_OPT_TSRESOL and value:
            units = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == NG_OPT_TSOFFSET and len(value) == 8:
            shift = struct.unpack(order + "q", value)[0]
    return [link, units, shift, snap]


class Walker:
    """Follows the record headers of a file from ``at`` on; ``problem`` says why it could not go on."""

    def __init__(self, stream: BinaryIO, size: int, state: State, at: int, known: bool = True, block: int = BLOCK):
        self.stream, self.size, self.state, self.at, self.block = stream, size, state, at, block
        self.problem: str | None = None
        #: Whether the interfaces before ``at`` are known; else how many of them the packets seen so far need.
        self.known, self.needs, self.sections = known, 0, 0

    def runs(self, stop: int, strict: bool = False) -> Iterator[Run]:
        """Records that start before ``stop``. With ``strict`` an implausible header is a problem as well."""
        step = self._ng if self.state.ng else self._classic
        more = 0
        while self.problem is None and self.at < min(stop, self.size):
            base, before = self.at, self.at
            self.stream.seek(base)
            data = self.stream.read(min(min(self.block, stop - base + SLACK) + more, self.size - base))
            again = True
            while again:
                # One list of interfaces holds for a run, so a run ends before the next one is declared.
                heads, again = step(data, base, stop, strict)
                if heads:
                    yield Run(data, base, np.frombuffer(heads, dtype=np.int64) - base, State.from_json(self.state.to_json()))
            if self.at == before and self.problem is None:
                if base + len(data) >= self.size:
                    self.problem = CUT
                more = 2 * more + min(self.block, NEAR)  # a record longer than the block
            else:
                more = 0

    def _classic(self, data: bytes, base: int, stop: int, strict: bool) -> tuple[array, bool]:
        """Positions of the records that lie in ``data`` as a whole (of the last one in the file: that fit the file)."""
        heads, at, size, end = array("q"), self.at, self.size, base + len(data)
        unpack = struct.Struct(self.state.order + "IIII").unpack_from
        longest = max(self.state.snap, LONGEST)
        while at < stop and at + 16 <= end:
            _, fraction, stored, wire = unpack(data, at - base)
            if strict and (stored > longest or not wire or fraction >= self.state.units):
                self.problem = "implausible header"
                break
            after = at + 16 + stored
            if after > size:
                self.problem = CUT
                break
            if after > end:
                break
            heads.append(at)
            at = after
        if at < stop and at < size < at + 16:
            self.problem = CUT
        self.at = at
        return heads, False

    def _ng(self, data: bytes, base: int, stop: int, strict: bool) -> tuple[array, bool]:
        heads, at, end = array("q"), self.at, base + len(data)
        again = False
        try:
            while at < stop and at + 12 <= end:
                here = at - base
                if data[here : here + 4] == b"\x0a\x0d\x0d\x0a":  # reads the same in both byte orders
                    if heads:
                        again = True
                        break
                    at = self._section(data, here, at)
                    continue
                order = self.state.order
                kind, length = struct.unpack_from(order + "II", data, here)
                if length < 12 or length % 4:
                    raise CaptureError("broken block length")
                if at + length > self.size:
                    raise CaptureError(CUT)
                if at + length > end:
                    break
                if strict and data[here + length - 4 : here + length] != data[here + 4 : here + 8]:
                    raise CaptureError("implausible header")
                if kind == NG_INTERFACE:
                    if heads:
                        again = True
                        break
                    self.state.interfaces.append(_interface(data[here + 8 : here + length - 4], order))
                elif kind in (NG_ENHANCED_PACKET, NG_OLD_PACKET, NG_SIMPLE_PACKET):
                    self._check(data, here, kind, length)
                    heads.append(at)
                at += length
        except CaptureError as error:
            self.problem = str(error)
        if self.problem is None and at < stop and at < self.size < at + 12:
            self.problem = "the capture is cut short in the middle of a block"
        self.at = at
        return heads, again

    def _section(self, data: bytes, here: int, at: int) -> int:
        mark = data[here + 8 : here + 12]
        order = next((o for o in "<>" if struct.unpack(o + "I", mark)[0] == NG_ORDER), None)
        if order is None:
            raise CaptureError("broken section header")
        length = struct.unpack_from(order + "I", data, here + 4)[0]
        if length < 12 or length % 4:
            raise CaptureError("broken block length")
        if at + length > self.size:
            raise CaptureError(CUT)
        self.state.order, self.state.interfaces = order, []
        self.known, self.sections = True, self.sections + 1
        return at + length

    def _check(self, data: bytes, here: int, kind: int, length: int) -> None:
        order, fixed = self.state.order, 4 if kind == NG_SIMPLE_PACKET else 20
        if length < 12 + fixed:
            raise CaptureError("broken block length")
        index, stored = 0, 0
        if kind == NG_ENHANCED_PACKET:
            index, _, _, stored = struct.unpack_from(order + "IIII", data, here + 8)
        elif kind == NG_OLD_PACKET:
            index, _, _, _, stored = struct.unpack_from(order + "HHIII", data, here + 8)
        if stored > length - 12 - fixed:
            raise CaptureError(CUT)
        lacking = index + 1 - len(self.state.interfaces)
        if lacking > 0:
            if self.known:
                raise CaptureError("packet of an undeclared interface")
            self.needs = max(self.needs, lacking)


def count(stream: BinaryIO, size: int) -> tuple[int, str | None]:
    """Packets of a capture, and what is wrong with it."""
    try:
        state, start = open_state(stream)
    except CaptureError as error:
        return 0, str(error)
    walker = Walker(stream, size, state, start)
    return sum(len(run.heads) for run in walker.runs(size)), walker.problem


@dataclass
class Walk:
    """What a walk through one segment found: from ``start`` to ``end``, the first record start behind the segment."""

    start: int
    end: int
    packets: int
    entry: str  # byte order before the walk
    order: str  # and after it
    resets: bool  # ng: a new section began, so interfaces from before do not count any more
    interfaces: str  # ng: those declared since then, or since the start
    needs: int  # ng: interfaces that must be known before the start
    problem: str | None
    entries: bytes = b""  # places of its records (32 bits, from the segment's begin) as far as the interfaces are those at ``start``


def walk_segment(stream: BinaryIO, size: int, state: State, start: int, stop: int, known: bool, strict: bool = False) -> Walk:
    before, entry = len(state.interfaces), state.order
    walker = Walker(stream, size, state, start, known)
    packets = sum(len(run.heads) for run in walker.runs(stop, strict))
    state = walker.state
    fresh = state.interfaces if walker.sections else state.interfaces[before:]
    return Walk(start, walker.at, packets, entry, state.order, walker.sections > 0, json.dumps(fresh), walker.needs, walker.problem)


def _plausible(data: np.ndarray, state: State, order: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of ``data`` whether a record could start there, and where the next one would."""
    n = max(0, len(data) - 16)
    at = np.arange(n, dtype=np.int64)

    def number(shift: int) -> np.ndarray:
        # Overlapping words, one from each byte on.
        return np.ndarray((n,), f"{order}u4", data, shift, (1,)).astype(np.int64) if n else np.zeros(0, dtype=np.int64)

    if not state.ng:
        stored, wire = number(8), number(12)
        # A length on the wire below the stored one is odd, but there are writers of it.
        good = (stored <= max(state.snap, LONGEST)) & (wire > 0) & (number(4) < state.units)
        after = at + 16 + stored
    else:
        length = number(4)
        good = (length >= 12) & (length % 4 == 0) & (length <= 4 * LONGEST)
        after = at + length
        # A block repeats its length at its end, as far as that is in sight.
        end = np.where(good & (after <= len(data)), after - 4, 0)
        words = number(0)
        tail = np.where(end < n, words[np.minimum(end, max(n - 1, 0))] if n else 0, length)
        section = (data[:n] == 0x0A) & (data[1 : n + 1] == 0x0D) & (data[2 : n + 2] == 0x0D) & (data[3 : n + 3] == 0x0A)
        good &= (end == 0) | (tail == length) | section
    return good & (after <= room), after


class Sight:
    """The header of a file, and which bytes of a stretch of it could start a record; the stretch is kept for the segments that follow in it."""

    def __init__(self, stream: BinaryIO, size: int):
        self.stream, self.size = stream, size
        self.state, self.start = open_state(stream)
        self.base, self.data = 0, np.zeros(0, dtype=np.uint8)
        self.seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, begin: int, stop: int, order: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Where the stretch begins, and ``_plausible`` of it: from ``begin`` on it has the segment and what its records may lead to."""
        end = min(self.size, begin + min(REACH, stop - begin + LONGEST))
        if not self.base <= begin or end > self.base + len(self.data):
            self.stream.seek(begin)
            self.base, self.seen = begin, {}
            self.data = np.frombuffer(self.stream.read(min(REACH, self.size - begin)), dtype=np.uint8)
        if order not in self.seen:
            self.seen[order] = _plausible(self.data, self.state, order, self.size - self.base)
        return self.base, *self.seen[order]


def guesses(sight: Sight, begin: int, stop: int) -> Iterator[tuple[int, str]]:
    """Positions from ``begin`` on that could start a record, by the chain of headers behind them, with the byte order."""
    for order in "<>" if sight.state.ng else sight.state.order:
        base, good, after = sight.at(begin, stop, order)
        alive = begin - base + np.nonzero(good[begin - base : stop - base])[0]
        here = alive.copy()
        for _ in range(CHAIN):
            inside = here < len(good)  # what lies beyond is not looked at: the walk will tell
            fine = ~inside | good[np.minimum(here, max(len(good) - 1, 0))]
            alive, here, inside = alive[fine], here[fine], inside[fine]
            here = np.where(inside, after[np.minimum(here, max(len(good) - 1, 0))], here) if len(good) else here
        for at in alive:
            yield base + int(at), order


def split_walks(stream: BinaryIO, size: int, begin: int, stop: int, sight: Sight | None = None) -> Iterator[Walk]:
    """Walks through [begin, stop) from all starts that look right; from the file's start there is only one.

    Each walk tells the records that it meets near ``begin``. A guess on one of them is no other walk, and a walk that gets to one of them
    goes on as the walk before it. ``sight`` is kept from segment to segment.
    """
    sight = sight or Sight(stream, size)
    state, start = sight.state, sight.start
    if begin == 0:
        yield walk_segment(stream, size, State.from_json(state.to_json()), start, stop, known=True)
        return
    near = min(stop, begin + NEAR)
    met: dict[tuple[str, int], tuple[Walk | None, int]] = {}
    chains = 0
    for at, order in guesses(sight, begin, stop):
        if chains == MAX_CHAINS:
            break
        if (order, at) in met:
            continue
        chains += 1
        own = State.from_json(state.to_json())
        own.order = order
        walker, packets, places, joined = Walker(stream, size, own, at, known=False), 0, [], None
        for run in walker.runs(near, strict=True):
            heads = (run.base + run.heads).tolist()
            if not own.interfaces and not walker.sections:
                joined = next(((k, met[order, head]) for k, head in enumerate(heads) if (order, head) in met), None)
                places += heads if joined is None else heads[: joined[0]]
            packets += len(heads) if joined is None else joined[0]
            if joined is not None:
                break
        entries = (np.array(places, dtype=np.int64) - begin).astype(np.uint32).tobytes()
        walk = None
        if joined is not None:
            other, ahead = joined[1]
            if other is not None:
                needs = max(walker.needs, other.needs)
                walk = Walk(at, other.end, packets + other.packets - ahead, order, other.order, other.resets, other.interfaces, needs, None, entries)
        else:
            packets += sum(len(run.heads) for run in walker.runs(stop, strict=True))
            if walker.problem is None:
                walk = Walk(at, walker.at, packets, order, own.order, walker.sections > 0, json.dumps(own.interfaces), walker.needs, None, entries)
        met.update(((order, place), (walk, k)) for k, place in enumerate(places))
        if walk is not None:
            yield walk
