"""Capture files as a Spark data source: ``load(spark, "captures/*.pcap")``, or ``spark.read.format("pcap").load(...)``.

Reads classic captures (either byte order, micro- or nanoseconds) and pcapng (section, interface, enhanced and simple
packet blocks). Options: path (a file, a folder, a glob, or several by commas, local or by URI), mode (FAILFAST: a broken
tail is an error; PERMISSIVE: reading stops there), splitBytes (default 64 MiB), ids (order: packet_id is the record's
place in its file, plus 2^40 for each file before it in name order; offset: its byte offset instead, which orders
packets just the same).

Records carry no sync marks, so a file larger than splitBytes is cut where a record is known to begin. ``load`` finds
these places in a Spark job: a task for each stretch of a classic capture guesses its first record and hops from header
to header to the stretch's end; the driver puts the stretches together, and one whose guess is not where the stretch
before it ended is walked again from there. So no guess is ever believed, and every record is read once. pcapng files
are walked by one task each. The driver holds one entry a stretch. Without ``load`` the planner walks the large files.
"""

from __future__ import annotations

import fnmatch
import glob as globs
import json
import os
import struct
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packetlens.schema import RAW
from packetlens.session import importable

ETHERNET = 1
#: packet_id: bits for the place within a file.
FILE_BITS = 40
# Fixed values of the formats: magic numbers and block types.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
BYTE_ORDER = 0x1A2B3C4D
LARGEST = 1 << 28


class CaptureError(ValueError):
    """A file that is no capture, or breaks off."""


@dataclass
class State:
    """What a reader must know at a record's start: byte order, time unit or interfaces, link type."""

    kind: str = ""
    order: str = "<"
    divisor: int = 1
    linktype: int = ETHERNET
    #: pcapng: (link type, ticks a second, offset in seconds, snap length) of each interface of the section.
    interfaces: list[tuple[int, int, int, int]] = field(default_factory=list)

    def copy(self) -> State:
        return State(self.kind, self.order, self.divisor, self.linktype, list(self.interfaces))


def begin(f) -> State:
    """State after the file's header; the file stands at the first record."""
    magic = f.read(4)
    if magic in CLASSIC:
        order, divisor = CLASSIC[magic]
        rest = f.read(20)
        if len(rest) < 20:
            raise CaptureError("the file header breaks off")
        return State("pcap", order, divisor, struct.unpack(order + "I", rest[16:])[0] & 0xFFFF)
    if magic == struct.pack("<I", SECTION):
        f.seek(0)
        return State("pcapng")
    raise CaptureError("not a capture file")


def records(f, state: State, end: int | None = None, data: bool = True) -> Iterator[tuple[int, State, tuple | None]]:
    """(offset, state, (ts_us, caplen, wirelen, linktype, bytes)) of every packet that begins before ``end``."""
    while end is None or f.tell() < end:
        at = f.tell()
        if state.kind == "pcap":
            head = f.read(16)
            if not head:
                return
            if len(head) < 16:
                raise CaptureError("a record header breaks off")
            sec, frac, caplen, wirelen = struct.unpack(state.order + "IIII", head)
            if caplen > LARGEST:
                raise CaptureError("a record has an impossible length")
            body = f.read(caplen) if data else f.seek(caplen, 1) and b""
            if data and len(body) < caplen:
                raise CaptureError("a record breaks off")
            yield at, state, (sec * 1_000_000 + frac // state.divisor, caplen, wirelen, state.linktype, body)
            continue
        head = f.read(8)
        if not head:
            return
        if len(head) < 8:
            raise CaptureError("a block header breaks off")
        if head[:4] == struct.pack("<I", SECTION):
            mark = f.read(4)
            state = State("pcapng", "<" if mark == struct.pack("<I", BYTE_ORDER) else ">")
            f.seek(-4, 1)
        kind, size = struct.unpack(state.order + "II", head)
        if size < 12 or size % 4 or size > LARGEST:
            raise CaptureError("a block has an impossible length")
        if not data and kind not in (SECTION, INTERFACE):
            f.seek(size - 8, 1)
            if kind in (ENHANCED, SIMPLE):
                yield at, state, None
            continue
        body = f.read(size - 8)
        if len(body) < size - 8:
            raise CaptureError("a block breaks off")
        if kind == INTERFACE:
            state = state.copy()
            state.interfaces.append(_interface(state.order, body[:-4]))
        elif kind == ENHANCED:
            which, high, low, caplen, wirelen = struct.unpack(state.order + "IIIII", body[:20])
            if which >= len(state.interfaces):
                raise CaptureError("a packet names an unknown interface")
            link, ticks, shift, _ = state.interfaces[which]
            ts_us = ((high << 32) | low) * 1_000_000 // ticks + shift * 1_000_000
            yield at, state, (ts_us, caplen, wirelen, link, body[20 : 20 + caplen])
        elif kind == SIMPLE:
            if not state.interfaces:
                raise CaptureError("a packet comes before any interface")
            link, _, _, snap = state.interfaces[0]
            (wirelen,) = struct.unpack(state.order + "I", body[:4])
            caplen = min(wirelen, snap or wirelen, len(body) - 8)
            yield at, state, (0, caplen, wirelen, link, body[4 : 4 + caplen])


def _interface(order: str, body: bytes) -> tuple[int, int, int, int]:
    link, _, snap = struct.unpack(order + "HHI", body[:8])
    ticks, shift, at = 1_000_000, 0, 8
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "HH", body[at : at + 4])
        value = body[at + 4 : at + 4 + size]
        if code == 0:
            break
        if code == 9 and value:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == 14 and len(value) == 8:
            (shift,) = struct.unpack(order + "q", value)
        at += 4 + (size + 3) // 4 * 4
    return link, ticks, shift, snap


#: Headers in a row that must be plausible where a reader guesses a record's start in the middle of a file, and how far
#: it looks for them.
CHAIN, WINDOW = 12, 1 << 20


def guessed(f, state: State, at: int, size: int, first_second: int) -> int | None:
    """Offset at or soon after ``at`` where a chain of plausible headers begins that, unless the file ends in it, is
    CHAIN long: likely a record's start. Plausible: lengths within limits, fractions below a second, times within ten
    years of the first or zero; at most half of the chain's records are empty."""
    limit = 1_000_000 * state.divisor
    f.seek(at)
    data = f.read(2 * WINDOW)

    def chained(k: int) -> bool:
        empty = 0
        for _ in range(CHAIN):
            if at + k == size:
                return True
            if k + 16 > len(data):
                return False
            sec, frac, caplen, wirelen = struct.unpack_from(state.order + "IIII", data, k)
            if caplen > 262_144 or not caplen <= wirelen <= 1 << 24 or frac >= limit or (sec and first_second and abs(sec - first_second) >= 315_360_000):
                return False
            empty += not caplen
            k += 16 + caplen
        return 2 * empty <= CHAIN

    return next((at + k for k in range(min(WINDOW, max(0, len(data) - 15))) if chained(k)), None)


def walked(f, state: State, at: int, stop: int, size: int, every: int = 0) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """From the record at ``at`` by headers to the first one at or behind ``stop``: where that is, how many records were
    passed, whether the file breaks off there, and (offset, number) of the first record behind each ``every`` bytes."""
    n, base, data, cuts, due = 0, at, b"", [], at + every
    while at < stop:
        if not base <= at <= base + len(data) - 16:
            f.seek(at)
            base, data = at, f.read(WINDOW)
            if len(data) < 16:
                return at, n, bool(data), cuts
        (caplen,) = struct.unpack_from(state.order + "I", data, at - base + 8)
        if caplen > LARGEST or at + 16 + caplen > size:
            return at, n, True, cuts
        if every and at >= due:
            cuts.append((at, n))
            due = at + every
        at, n = at + 16 + caplen, n + 1
    return at, n, False, cuts


def opened(path: str):
    """A file to read, local or in a store that Arrow reaches by URI."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path.removeprefix("file://"), "rb")


def located(path: str) -> list[str]:
    """Files of a path with globs, folders and commas, in name order; a path that names nothing is an error."""
    found: list[str] = []
    for part in filter(None, (x.strip() for x in path.split(","))):
        if "://" in part and not part.startswith("file://"):
            hits = _stored(part)
        else:
            local = part.removeprefix("file://")
            if os.path.isdir(local):
                local = os.path.join(local, "*")
            hits = sorted(x for x in globs.glob(local) if os.path.isfile(x))
        if not hits:
            raise FileNotFoundError(f"no capture at {part}")
        found += hits
    return found


def _stored(uri: str) -> list[str]:
    """Files of a store's path: one file, those of a folder, or those that a glob in the last part of the path takes."""
    from pyarrow import fs

    folder, _, last = uri.rstrip("/").rpartition("/")
    pattern = last if any(x in last for x in "*?[") else ""
    store, name = fs.FileSystem.from_uri(folder if pattern else uri)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type != fs.FileType.Directory:
        return []
    inside = [x.base_name for x in store.get_file_info(fs.FileSelector(name)) if x.is_file]
    base = folder if pattern else uri.rstrip("/")
    return sorted(f"{base}/{x}" for x in inside if not pattern or fnmatch.fnmatchcase(x, pattern))


@dataclass
class Range(InputPartition):
    path: str
    first_id: int
    start: int | None = None
    end: int | None = None
    state: State | None = None
    #: packet_id is the record's offset.
    by_offset: bool = False


def warn_of_link(path: str, state: State) -> None:
    if state.kind == "pcap" and state.linktype != ETHERNET:
        warnings.warn(f"{path}: link type {state.linktype} is read as Ethernet", stacklevel=3)


def planned(path: str, first_id: int, split: int, strict: bool) -> list[Range]:
    """Ranges of a file, each beginning at a record."""
    with opened(path) as f:
        state = begin(f)
        warn_of_link(path, state)
        f.seek(0, 2)
        size = f.tell()
        if size <= split:
            return [Range(path, first_id)]
        cuts, _ = _cuts(f, state, size, split, strict)
    ends = [at for at, _, _ in cuts[1:]] + [None]
    return [Range(path, first_id + k, at, end, now) for (at, k, now), end in zip(cuts, ends)]


def _cuts(f, state: State, size: int, split: int, strict: bool) -> tuple[list[tuple[int, int, State]], int]:
    """(offset, number, state) of the first record and of the first one behind each ``split`` bytes, and how many there are."""
    if state.kind == "pcap":
        _, n, _, cuts = walked(f, state, 24, size, size, split)
        return [(24, 0, state), *((at, k, state) for at, k in cuts)], n
    f.seek(0)
    cuts, n, due = [], 0, 0
    try:
        for at, now, _ in records(f, state, size, data=False):
            if at >= due:
                cuts.append((at, n, now.copy()))
                due = at + split
            n += 1
    except CaptureError:
        if strict:
            raise
    return cuts, n


#: Rounds in which stretches are walked again, before the rest of a file is left to one task.
ROUNDS = 8


def indexed(spark: SparkSession, path: str, split: int = 64 << 20, strict: bool = True, counted: bool = False) -> list[tuple[Range, int]]:
    """Ranges of all files of a path, found by Spark jobs, each with how many records it holds.

    The number is -1 for files within ``split``, which are not walked, unless ``counted``.
    """
    files = located(path)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name in zip(b["k"], b["path"]):
                with opened(name) as f:
                    state = begin(f)
                    f.seek(0, 2)
                    size = f.tell()
                    cuts, n = None, -1
                    if size <= split and counted or state.kind != "pcap" and size > split:
                        cuts, n = _cuts(f, state, size, max(split, 1), strict)
                        cuts = json.dumps([(at, m, vars(now)) for at, m, now in cuts]) if size > split else None
                out.append((k, size, json.dumps(vars(state)), cuts, n))
            yield pd.DataFrame(out, columns=["k", "size", "state", "cuts", "n"])

    def spread(rows: list[tuple], schema: str) -> DataFrame:
        return importable(spark).createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    seen = spread(list(enumerate(files)), "k int, path string").mapInPandas(look, "k int, size long, state string, cuts string, n long").collect()
    out: dict[int, list[tuple[int, int, int | None, dict | None]]] = {}  # (start, records, end, state) by file
    stretches: dict[int, list[list]] = {}  # of a classic file: [from, to, (start, landing, records, broken) or None]
    sizes = {}
    for r in seen:
        state = json.loads(r.state)
        warn_of_link(files[r.k], State(**state))
        if r.cuts is not None:
            found = json.loads(r.cuts)
            marks = [at for at, _, _ in found[1:]] + [None]
            numbers = [m for _, m, _ in found[1:]] + [r.n]
            out[r.k] = [(at, after - m, end, now) for (at, m, now), end, after in zip(found, marks, numbers)]
        elif r.size <= split:
            out[r.k] = [(-1, r.n, None, None)]
        else:
            cuts = [24, *range(split, r.size, split), r.size]
            stretches[r.k], sizes[r.k] = [[a, b, None] for a, b in zip(cuts, cuts[1:]) if a < b], r.size

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, i, name, a, to, start, size, last in b.itertuples(index=False):
                with opened(name) as f:
                    state = begin(f)
                    (first,) = struct.unpack(state.order + "I", f.read(4).ljust(4, b"\0"))
                    at = start if start >= 0 else guessed(f, state, a, size, first)
                    if at is None:
                        continue
                    landing, n, broken, cuts = walked(f, state, at, to, size, split if last else 0)
                    rows.append((k, i, at, landing, n, broken, json.dumps(cuts)))
            yield pd.DataFrame(rows, columns=["k", "i", "start", "landing", "n", "broken", "cuts"])

    # the first stretch's start is known, the others are guessed at
    todo = [(k, i, files[k], a, b, 24 if not i else -1, sizes[k], False) for k, parts in stretches.items() for i, (a, b, _) in enumerate(parts)]
    rounds = 0
    while todo:
        for r in spread(todo, "k int, i int, path string, a long, b long, start long, size long, last boolean").mapInPandas(walk, "k int, i int, start long, landing long, n long, broken boolean, cuts string").collect():
            if rounds > ROUNDS:  # the rest of the file in one walk: its cuts are the ranges
                marks = [(r.start, 0), *map(tuple, json.loads(r.cuts)), (None, r.n)]
                rest = [(at, after - m, end, None) for (at, m), (end, after) in zip(marks, marks[1:])]
                done, _, _ = _put_together(stretches.pop(r.k)[: r.i])
                out[r.k] = [*done[:-1], (*done[-1][:2], r.start, None), *rest]
            else:
                stretches[r.k][r.i][2] = (r.start, r.landing, r.n, r.broken)
        rounds += 1
        todo = []
        for k, parts in list(stretches.items()):
            ranges, missing, expected = _put_together(parts)
            if missing is None:
                out[k] = ranges
                stretches.pop(k)
            else:
                last = rounds > ROUNDS
                todo.append((k, missing, files[k], parts[missing][0], sizes[k] if last else parts[missing][1], expected, sizes[k], last))
    listed = []
    for k, name in enumerate(files):
        number = k << FILE_BITS
        for start, n, end, state in out[k]:
            listed.append((Range(name, number, start if start >= 0 else None, end, State(**state) if state else None), n))
            number += max(0, n)
    return listed


def _put_together(parts: list[list]) -> tuple[list[tuple], int | None, int]:
    """Ranges of a file's stretches as far as each begins where the one before it ended; the first one that does not, and where it should."""
    ranges, expected, missing = [], 24, None
    for i, (_, to, found) in enumerate(parts):
        if expected >= to:
            continue  # a record reaches over the whole stretch
        if found is None or found[0] != expected:
            missing = i
            break
        start, expected, n, broken = found
        ranges.append((start, n))
        if broken:
            break
    ends = [start for start, _ in ranges[1:]] + [None]
    return [(start, n, end, None) for (start, n), end in zip(ranges, ends)], missing, expected


class PcapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.by_offset = options.get("ids", "order").lower() == "offset"
        self.cuts = options.get("cuts", "")

    def partitions(self) -> list[Range]:
        if self.cuts:
            found = [Range(p, n, a, b, State(**s) if s else None) for p, n, a, b, s in json.loads(self.cuts)]
        else:
            found = [r for k, p in enumerate(located(self.path)) for r in planned(p, k << FILE_BITS, self.split, self.strict)]
        for r in found:
            if self.by_offset:
                r.first_id, r.by_offset = r.first_id >> FILE_BITS << FILE_BITS, True
        return found

    def read(self, part: Range) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("packet_id", pa.int64()), ("ts_us", pa.int64()), ("ts", pa.float64()), ("caplen", pa.int32()), ("wirelen", pa.int32()), ("linktype", pa.int32()), ("data", pa.binary())])
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

        with opened(part.path) as f:
            state = begin(f)
            if part.start is not None:
                f.seek(part.start)
                state = part.state or state
            n = part.first_id
            try:
                for at, _, (us, caplen, wirelen, link, body) in records(f, state, part.end):
                    rows.append((part.first_id + at if part.by_offset else n, us, us // 1_000_000 + us % 1_000_000 / 1e6, caplen, wirelen & 0x7FFFFFFF, link, body))
                    n, held = n + 1, held + caplen
                    if len(rows) >= 8192 or held > 16 << 20:
                        yield batch()
                        rows, held = [], 0
            except CaptureError:
                if self.strict:
                    raise
        if rows:
            yield batch()


class PcapSource(DataSource):
    """The data source "pcap"."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> PcapReader:
        return PcapReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session."""
    importable(spark).dataSource.register(PcapSource)
    return spark


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Raw packets of a path. Files larger than splitBytes are cut by tasks of a Spark job."""
    given = {k.lower(): v for k, v in options.items()}
    ranges = indexed(spark, path, int(given.get("splitbytes", 64 << 20)), given.get("mode", "FAILFAST").upper() != "PERMISSIVE")
    cuts = json.dumps([(r.path, r.first_id, r.start, r.end, vars(r.state) if r.state else None) for r, _ in ranges])
    return register(spark).read.format("pcap").options(**options).option("cuts", cuts).load(path)


def count_packets(spark: SparkSession, path: str, split: int = 64 << 20) -> int:
    """Packets of all files of a path, by record headers only, before any filter; tasks walk them."""
    return sum(n for _, n in indexed(spark, path, split, strict=False, counted=True))


def save(raw: DataFrame, folder: str) -> str:
    """Writes raw packets, in the order of packet_id, as classic captures in ``folder``, a file a task; returns its path.

    A file is written aside and moved, so that a task that runs again does no harm.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.pcap"
        aside = f"_{uuid.uuid4().hex}.part"
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        n = 0
        with store.open_output_stream(f"{base}/{aside}") as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LARGEST, ETHERNET))
            for b in batches:
                n += len(b)
                f.write(b"".join(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(x), w) + x for us, w, x in zip(b["ts_us"], b["wirelen"], b["data"])))
        store.move(f"{base}/{aside}", f"{base}/{name}")
        yield pd.DataFrame({"file": [name], "n": [n]})

    rows = importable(raw.sparkSession) and raw.select("packet_id", "ts_us", "wirelen", "data")
    parts = max(1, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "packet_id").sortWithinPartitions("packet_id").mapInPandas(stream, "file string, n long").collect()
    return f"{folder}/*.pcap"


def store_of(folder: str):
    """File system and path of a folder, local or by URI."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file://"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file://").removeprefix("file:")
