"""WARC archives in seekable Zstandard bundles.

Each partition writes bundles of its own. Records are grouped in frames that are compressed independently; behind the
last frame a skippable frame holds the seek table (each frame's compressed and plain size), as in the Zstandard
seekable format, so a plain Zstandard reader reads a bundle as one file. The index maps every record to its bundle,
its frame and its offset in the plain frame: reading one record takes the table, one frame and a slice.

Records with equal payloads: the one with the smallest page_id is the response, the others are revisits of it, which
hold its id and the HTTP header (with the payload's length) but not the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import durable, shared_dir

#: Plain bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME, BUNDLE = 1 << 18, 1 << 27
# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Record id and bytes of a response, or of a revisit of page ``refers_to``."""
    digest = digest_of(payload)
    name = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}",
        ]
    block = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


class Bundle:
    """Writer of one bundle to an open binary file."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer, self.frames, self.size = out, zstandard.ZstdCompressor(level=level), [], 0
        self.pending: list[bytes] = []
        self.plain = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame of what is added."""
        if self.plain and self.plain + len(data) > FRAME:
            self.flush()
        at = (len(self.frames), self.plain)
        self.pending.append(data)
        self.plain += len(data)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.plain))
            self.size += len(packed)
            self.pending, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the frames of a bundle; keeps the frame last read."""

    def __init__(self, source, size: int):
        self.source, self.last = source, (-1, b"")
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        sizes = [x for x, _ in struct.iter_unpack("<II", source.read(8 * count))]
        self.sizes, self.starts = sizes, [0]
        for x in sizes:
            self.starts.append(self.starts[-1] + x)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(self.starts[k])
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.source.read(self.sizes[k])))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def opened(uri: str):
    """File system and path of a folder all executors reach: file:, or a store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def written(pages: DataFrame, folder: str, revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index, read from the shared folder.

    Payloads of at least ``revisit_bytes`` are stored once. A file's name holds the task's attempt: where a lost task
    runs again, the index names the files of the attempt that counts, and others are never read. Null html is an empty
    payload. Rows with a null page_id are always responses and never referred to; rows that repeat the smallest
    page_id of a payload are all responses. An empty table gives an empty index and no files.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = durable(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("page_id").isNotNull()))
    firsts = slim.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # an id that comes with several payloads refers by payload
    again = durable(slim.join(durable(firsts), ["digest", "size"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct())
    if again.count():
        keyed = rows.withColumn("digest", F.sha1("payload"))
        rows = keyed.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        task = TaskContext.get()
        stem, n, bundle, name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, ""
        for batch in batches:
            out = []
            ids, refs = batch["page_id"].astype("Int64"), batch["refers_to"].astype("Int64")
            for page, url, data, ref in zip(ids, batch["url"], batch["payload"], refs):
                if bundle is None:
                    name = f"{stem}-{n}.warc.zst"
                    bundle, n = Bundle(fs.open_output_stream(f"{root}/{name}", compression=None)), n + 1
                page, ref = (None if x is pd.NA else int(x) for x in (page, ref))
                rid, raw = record(page, url, bytes(data), ref)
                frame, offset = bundle.add(raw)
                out.append((page, rid, name, frame, offset, len(raw)))
                if bundle.size >= BUNDLE:
                    bundle.close()
                    bundle = None
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64"})
        if bundle is not None:
            bundle.close()

    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    return durable(rows.mapInPandas(write, INDEX))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """The records of ``index``, read by frame from their bundles: columns of RECORD.

    Digests of responses are computed from the payload read; a difference from the header is an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        name, reader = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.bundle != name:
                    if reader is not None:
                        reader.source.close()
                    source = fs.open_input_file(f"{root}/{r.bundle}")
                    name, reader = r.bundle, Reader(source, source.size())
                head, http, payload = parsed(reader.record(r.frame, r.offset, r.length))
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != size):
                    raise ValueError(f"{r.bundle}: payload of {r.record_id} differs from its digest")
                page, ref = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                out.append((page and int(page), size, digest, head["WARC-Type"], ref and int(ref), head["WARC-Target-URI"]))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(read, RECORD)


def archived(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to bundles in ``folder`` (default: a new one in the shared folder) and reads them back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_back(written(pages, folder, revisit_bytes), folder)


def oracle() -> str:
    """DuckDB SQL for what reading back ``archived`` pages must give: base32 from the hex digest, five bits a letter."""
    letter = " + ".join(f"{16 >> k} * bits[5 * i + {k + 1}]::int" for k in range(5))
    return f"""
with p as (select page_id, coalesce(html, '') html from pages),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', sha1(html)[i]) - 1), 4, '0')), '') bits from p),
d as (select *, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + {letter}]), '') digest, min(page_id) over (partition by html) f from b)
select page_id, octet_length(encode(html))::bigint payload_bytes, digest payload_digest, case when page_id = f then 'response' else 'revisit' end record_type,
  case when page_id <> f then f end refers_to from d"""
