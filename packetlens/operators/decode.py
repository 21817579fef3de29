"""Frames to columns: Ethernet, VLAN, IPv4, IPv6, ARP, TCP, UDP, ICMP, and the protocols above by port.

Headers are read by numpy over whole Arrow batches of frames, in one pass that also walks the variable parts (DNS names,
TLS extensions, DHCP options) of the few payloads whose ports call for it. Addresses as text, HTTP and credentials are
expressions over what that pass returns. Missing values are '', 0 or false, not null, but for ``payload``.
"""

from __future__ import annotations

import functools
import socket
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import columns as c

VLAN = (0x8100, 0x88A8)
IP4, IP6, ARP, RARP = 0x0800, 0x86DD, 0x0806, 0x8035
EXTENSIONS = (0, 43, 44, 60, 51)
#: Extension headers that are followed.
EXTENSION_STEPS = 10
#: Ports and the decoders they choose, for TCP payloads and for UDP, first match first.
TCP_APPS = (("dns", (53,)), ("http", (80, 8080)), ("tls", (443,)), ("smtp", (25, 587)), ("ftp", (21,)))
UDP_APPS = (("dns", (53,)), ("dhcp", (67, 68)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a row generator of one row: filters on its columns are not rewritten into its expressions.

    Decoding stacks expressions that each use the ones below several times; a filter pushed through all of them would
    repeat them exponentially.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


class Frames:
    """A batch of frames as one run of bytes; reads numbers at a place in each frame, 0 where ``ok`` is false."""

    def __init__(self, data: pa.Array):
        wide = pa.types.is_large_binary(data.type)
        _, offsets, values = data.buffers()
        at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        self.bytes = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(1, dtype=np.uint8)
        self.start, self.n = at[:-1], np.diff(at)

    def number(self, at: np.ndarray, width: int, ok: np.ndarray) -> np.ndarray:
        place = np.where(ok, self.start + at, 0)
        last, out = len(self.bytes) - 1, np.zeros(len(place), dtype=np.int64)
        for k in range(width):
            out = out << 8 | self.bytes[np.minimum(place + k, last)]
        return np.where(ok, out, 0)

    def pieces(self, at: np.ndarray, size: np.ndarray, ok: np.ndarray) -> pa.Array:
        """``size`` bytes from ``at`` of each frame, fewer at its end; null where not ``ok``."""
        at = np.minimum(at, self.n)
        size = np.where(ok, np.clip(size, 0, self.n - at), 0)
        ends = np.cumsum(size)
        # the byte at place k of the result comes from its piece's start and its place in the piece
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start + at - (ends - size), size)
        offsets = np.concatenate([[0], ends])
        narrow = offsets[-1] < 1 << 31
        valid = pa.py_buffer(np.packbits(ok, bitorder="little").tobytes())
        buffers = [valid, pa.py_buffer(offsets.astype(np.int32 if narrow else np.int64).tobytes()), pa.py_buffer(self.bytes[source].tobytes())]
        return pa.Array.from_buffers(pa.binary() if narrow else pa.large_binary(), len(size), buffers)

    def ethertypes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ethertype behind all tags, where its payload begins, and whether the frame is too short or a tag breaks off."""
        bad = self.n < 14
        kind = self.number(np.full(len(self.n), 12), 2, ~bad)
        off = np.where(bad, 0, 14)
        while True:
            tagged = np.isin(kind, VLAN) & ~bad
            bad = bad | (tagged & (off + 4 > self.n))
            on = tagged & ~bad
            if not on.any():
                return kind, off, bad
            kind = np.where(on, self.number(off + 2, 2, on), kind)
            off = np.where(on, off + 4, off)


@functools.lru_cache(maxsize=1 << 16)
def _inet6(address: bytes) -> str:
    return socket.inet_ntop(socket.AF_INET6, address)


def _text6(addresses: pa.Array) -> pa.Array:
    if addresses.null_count == len(addresses):
        return pa.nulls(len(addresses), pa.string())
    return pa.array([None if a is None else _inet6(a) for a in addresses.to_pylist()], pa.string())


def _pick(*choices: tuple[np.ndarray, object]) -> Callable[[object], np.ndarray]:
    return lambda rest: np.select([x for x, _ in choices], [y for _, y in choices], rest)


def parsed(data: pa.Array, late_tcp: bool = False) -> dict[str, pa.Array]:
    """Columns of FIELDS for a batch of frames."""
    f = Frames(data)
    n = f.n
    kind, off, bad = f.ethertypes()
    good = ~bad
    # network
    v4 = good & (kind == IP4) & (off + 20 <= n)
    head, total = f.number(off, 1, v4), f.number(off + 2, 2, v4)
    hlen = (head & 15) * 4
    v4 &= (head >> 4 == 4) & (hlen >= 20) & (off + hlen <= n) & (total >= hlen)
    v6 = good & (kind == IP6) & (off + 40 <= n)
    v6 &= f.number(off, 1, v6) >> 4 == 6
    arp = good & np.isin(kind, (ARP, RARP)) & (off + 28 <= n)
    nxt, place, end = f.number(off + 6, 1, v6), off + 40, np.zeros(len(n), dtype=np.int8)
    for _ in range(EXTENSION_STEPS):
        more = v6 & np.isin(nxt, EXTENSIONS) & (end == 0)
        if not more.any():
            break
        cut = more & (place + 2 > n)
        on = more & ~cut
        after = place + 8 + f.number(place + 1, 1, on) * 8
        nxt = np.where(on, f.number(place, 1, on), nxt)
        end = np.select([cut, on & (after > n)], [1, 2], end)
        place = np.where(on, after, place)
    whole6 = v6 & (end == 0)
    proto = _pick((v4, f.number(off + 9, 1, v4)), (whole6, nxt))(-1)
    l4 = _pick((np.isin(proto, (c.TCP, c.UDP)), proto), (v4 & (proto == c.ICMP), c.ICMP), (whole6 & (proto == c.ICMPV6), c.ICMPV6))(c.OTHER)
    at = _pick((v4, off + hlen), (v6 & (end == 2), off + 40), (v6, place))(off)
    rest = np.maximum(np.where(v4, np.minimum(off + total, n), n) - at, 0)
    # transport
    tcp_head, udp_head = (l4 == c.TCP) & (at + 20 <= n), (l4 == c.UDP) & (at + 8 <= n)
    icmp = np.isin(l4, (c.ICMP, c.ICMPV6))
    icmp_head, ports = icmp & (at + 4 <= n), tcp_head | udp_head
    thl, size = (f.number(at + 12, 1, tcp_head) >> 4) * 4, f.number(at + 4, 2, udp_head)
    tcp_ok, udp_ok = tcp_head & (thl >= 20) & (at + thl <= n), udp_head & (size >= 8)
    begin = _pick((tcp_ok, at + thl), (udp_ok, at + 8))(at)
    has = ~((icmp & ~icmp_head) | (arp & ~tcp_ok & ~udp_ok & ~icmp))
    length = np.where(has, _pick((tcp_ok, n - at - thl), (udp_ok, np.minimum(size - 8, n - at - 8)), (icmp, n - at))(rest), 0)
    src_port, dst_port, flags = f.number(at, 2, ports), f.number(at + 2, 2, ports), f.number(at + 13, 1, tcp_ok)
    payload = f.pieces(begin, length, has)
    app = np.full(len(n), "", dtype="U4")
    for on, apps in ((tcp_ok & (length > 0), TCP_APPS), (udp_ok, UDP_APPS)):
        for name, wanted in reversed(apps):
            app[on & (np.isin(src_port, wanted) | np.isin(dst_port, wanted))] = name
    none = np.zeros(len(n), dtype=np.int64)

    def walked(rows: np.ndarray, fn: Callable[[bytes, bool], tuple | None], kind: pa.DataType) -> pa.Array:
        """``fn`` of the payloads in ``rows``; null for the others and where it finds nothing."""
        if not rows.any():
            return pa.nulls(len(n), kind)
        out: list[dict | None] = [None] * len(n)
        names = [x.name for x in kind]
        for i in np.nonzero(rows)[0]:
            if (found := fn(payload[i].as_py(), bool(tcp_ok[i]))) is not None:
                out[i] = dict(zip(names, found))
        return pa.array(out, kind)

    def dns(m: bytes, over_tcp: bool) -> tuple | None:
        return dns_message(m[2:], 2 if late_tcp else 0) if over_tcp else dns_message(m)

    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    made = {
        "is_ipv4": pa.array(v4), "is_ipv6": pa.array(v6), "is_arp": pa.array(arp | (good & (kind == RARP))),
        "src_ip4": pa.array(f.number(off + 12, 4, v4), mask=~v4), "dst_ip4": pa.array(f.number(off + 16, 4, v4), mask=~v4),
        "src_ip6": _text6(f.pieces(off + 8, none + 16, v6)), "dst_ip6": _text6(f.pieces(off + 24, none + 16, v6)), "arp_op": i32(f.number(off + 6, 2, arp)), "arp_ends": f.pieces(off + 8, none + 20, arp),
        "l4": i32(l4), "src_port": i32(src_port), "dst_port": i32(dst_port), "flags": i32(flags),
        "seq": pa.array(f.number(at + 4, 4, tcp_head)), "ack_num": pa.array(f.number(at + 8, 4, tcp_head)),
        "icmp_type": i32(f.number(at, 1, icmp_head)), "icmp_code": i32(f.number(at + 1, 1, icmp_head)),
        "payload": payload, "payload_off": i32(np.where(has, begin, 0)), "payload_len": i32(length), "app": pa.array(app.tolist(), pa.string()),
        "dns": walked(app == "dns", dns, DNS), "tls": walked(app == "tls", lambda m, _: client_hello(m), TLS), "dhcp": walked(app == "dhcp", lambda m, _: dhcp_message(m), DHCP),
    }
    return made


DNS = pa.struct([("asked", pa.int32()), ("answered", pa.int32()), ("queries", pa.list_(pa.string())), ("answers", pa.list_(pa.string()))])
TLS = pa.struct([("version", pa.int32()), ("sni", pa.string()), ("alpn", pa.list_(pa.string())), ("ciphers", pa.list_(pa.int32())), ("ja3", pa.string())])
DHCP = pa.struct([("op", pa.int32()), ("client", pa.binary()), ("your", pa.binary()), ("mac", pa.binary()), ("host", pa.string())])
FIELDS = (
    "is_ipv4 boolean, is_ipv6 boolean, is_arp boolean, src_ip4 long, dst_ip4 long, src_ip6 string, dst_ip6 string, arp_op int, arp_ends binary, l4 int, src_port int, dst_port int, "
    "flags int, seq long, ack_num long, icmp_type int, icmp_code int, payload binary, payload_off int, payload_len int, app string, "
    "dns struct<asked: int, answered: int, queries: array<string>, answers: array<string>>, "
    "tls struct<version: int, sni: string, alpn: array<string>, ciphers: array<int>, ja3: string>, "
    "dhcp struct<op: int, client: binary, your: binary, mac: binary, host: string>"
)


def _parsed_frames(raw: DataFrame, parse: Callable[[pa.Array], dict[str, pa.Array]], fields: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of raw packets, and ``fields`` of their frames."""
    columns = list(dict.fromkeys([*keep, "data"]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = dict(zip(b.schema.names, b.columns))
            made = {**{k: of[k] for k in keep}, **parse(of["data"])}
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    kinds = ", ".join(f"{k} {raw.schema[k].dataType.simpleString()}" for k in keep)
    return raw.select(*columns).mapInArrow(stream, f"{kinds}, {fields}")


# --- HTTP and credentials: expressions over Latin-1 text

METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS")


def _http(df: DataFrame) -> DataFrame:
    df = df.withColumn("h", F.when((F.col("app") == "http") & (F.col("payload_len") >= 10), c.latin1(c.bytes_at("payload", 0, 4096))))
    h = F.col("h")
    request = F.coalesce(F.greatest(*(F.startswith(h, F.lit(m)) for m in METHODS)), F.lit(False))
    response = F.coalesce(F.startswith(h, F.lit("HTTP/")), F.lit(False))
    df = df.withColumn("request", request).withColumn("response", response & ~request)
    df = df.withColumn("is_http", F.col("request") | F.col("response"))
    line_end = F.instr(h, "\r\n")
    line = F.substring(h, F.lit(1), line_end - 1)
    space, last = F.instr(line, " "), F.length(line) - F.instr(F.reverse(line), " ") + 1
    split = F.col("request") & (line_end > 0) & (space > 0) & (space < last)
    # the status lies between the text's first two spaces, wherever they are
    words = F.split(h, " ", 3)
    number = F.regexp_extract(F.get(words, F.lit(1)), "^[ \\t\\n\\x0B\\f\\r]*([+-]?[0-9]+)", 1).try_cast("int")
    status = F.when(F.col("response") & (line_end > 0) & (F.size(words) == 3), number)
    lines = F.split(h, "\r\n")
    body_at = F.instr(h, "\r\n\r\n")
    blank = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "")
    count = F.when(body_at > 0, blank.cast("int") - 1).otherwise(F.greatest(F.size(lines) - 2, F.lit(0)))
    fields = F.when(F.col("is_http"), F.filter(F.slice(lines, F.lit(2), count), lambda x: x.contains(":")))
    df = df.withColumn("fields", fields)

    def header(name: str) -> Column:
        found = F.filter("fields", lambda x: c.ascii_lower(F.substring_index(x, ":", 1)) == name)
        value = F.get(found, F.size(found) - 1)
        return F.coalesce(F.when(F.size(found) > 0, c.trim_blank(F.substring(value, F.instr(value, ":") + 1, F.length(value)))), F.lit(""))

    offset = F.when(F.col("is_http") & (body_at > 0), body_at + 3).otherwise(0)
    out = (
        df.withColumn("http_method", F.coalesce(F.when(split, F.substring(line, F.lit(1), space - 1)), F.lit("")))
        .withColumn("http_uri", F.coalesce(F.when(split, F.substring(line, space + 1, last - space - 1)), F.lit("")))
        .withColumn("http_status_code", F.coalesce(status, F.lit(0)))
        .withColumn("http_host", header("host")).withColumn("http_user_agent", header("user-agent")).withColumn("http_content_type", header("content-type"))
        .withColumn("http_body_offset", offset.cast("int"))
        .withColumn("http_body_len", F.when((offset > 0) & (offset < F.col("payload_len")), F.col("payload_len") - offset).otherwise(0).cast("int"))
    )
    return out.drop("h", "request", "response", "fields")


def _credentials(df: DataFrame, auth_plain: bool = False) -> DataFrame:
    """``auth_plain`` also takes the token that stands right behind AUTH PLAIN."""
    text = F.when(F.col("app").isin("smtp", "ftp") & (F.col("payload_len") >= 4), c.latin1(c.bytes_at("payload", 0, 512)))

    def step(acc: Column, line: Column) -> Column:
        low = c.ascii_lower(line)
        long = F.length(line) > 5
        user, secret = F.startswith(low, F.lit("user ")) & long, F.startswith(low, F.lit("pass ")) & long
        login = ~user & ~secret & low.contains("auth login")
        space = F.call_function("locate", F.lit(" "), line, F.instr(low, "auth plain") + 10 if auth_plain else F.lit(12))
        plain = ~user & ~secret & ~login & low.contains("auth plain") & (space > 0) & (space < F.length(line))
        value = c.trim_blank(F.substring(line, F.lit(6), F.length(line)))
        return F.struct(
            F.when(user, value).otherwise(acc["user"]).alias("user"),
            F.when(secret, value).when(plain, F.substring(line, space + 1, F.length(line))).otherwise(acc["secret"]).alias("secret"),
            F.when(login, "smtp_auth_login").when(plain, "smtp_auth_plain").otherwise(acc["proto"]).alias("proto"),
        )

    start = F.struct(F.lit("").alias("user"), F.lit("").alias("secret"), F.col("app").alias("proto"))
    df = df.withColumn("cred", F.when(text.isNotNull(), F.aggregate(F.split(text, "\r\n"), start, step)))
    named = {"user": "cred_username", "secret": "cred_password", "proto": "cred_protocol"}
    return df.withColumns({v: F.coalesce(F.col(f"cred.{k}"), F.lit("")) for k, v in named.items()}).drop("cred")


# --- DNS, TLS, DHCP: loops


def dns_name(m: bytes, at: int, depth: int = 0) -> tuple[str, int]:
    """Name at ``at`` in lower case, and where reading stopped. '' where it is broken or points too deep."""
    if depth > 10 or at >= len(m):
        return "", at
    labels = []
    while at < len(m):
        size = m[at]
        if not size:
            at += 1
            break
        if size >= 0xC0:
            if at + 1 >= len(m):
                return "", at
            rest, _ = dns_name(m, (size & 0x3F) << 8 | m[at + 1], depth + 1)
            return "".join(x + "." for x in labels) + rest, at + 2
        if at + 1 + size > len(m):
            return "", at
        labels.append(m[at + 1 : at + 1 + size].decode("latin-1").translate(_FOLD))
        at += 1 + size
    return ".".join(labels), at


_FOLD = {ord(a): b for a, b in zip(c.UPPER, c.LOWER)}


def dns_message(m: bytes, late: int = 0) -> tuple[int, int, list[str], list[str]] | None:
    """Question and answer counts, question names, and A and AAAA answers.

    ``late``: bytes by which every question is read too late, to compare with readers that do so.
    """
    if len(m) < 12:
        return None
    asked, answered = struct.unpack(">HH", m[4:8])
    at, queries, answers = 12, [], []
    for _ in range(asked):
        if at >= len(m):
            break
        name, at = dns_name(m, at + late)
        if name:
            queries.append(name)
        at += 4
    for _ in range(answered):
        if at >= len(m):
            break
        _, at = dns_name(m, at)
        if at + 10 > len(m):
            break
        kind, _, _, size = struct.unpack(">HHIH", m[at : at + 10])
        at += 10
        if (kind, size) in ((1, 4), (28, 16)) and at + size <= len(m):
            answers.append(socket.inet_ntop(socket.AF_INET if size == 4 else socket.AF_INET6, m[at : at + size]))
        at += size
    return asked, answered, queries, answers


def _u16(m: bytes, at: int) -> int:
    return m[at] << 8 | m[at + 1]


def _known(values: list[int]) -> list[int]:
    """Without the reserved values that clients mix in: those whose low nibbles are both A."""
    return [x for x in values if x & 0x0F0F != 0x0A0A]


def client_hello(m: bytes) -> tuple[int, str, list[str], list[int], str | None] | None:
    """(version, server name, protocols, ciphers, fingerprint text or null if the hello breaks off before it)."""
    n = len(m)
    if n < 10 or m[0] != 22 or _u16(m, 3) + 5 > n or m[5] != 1:
        return None
    version, name, protocols, ciphers = _u16(m, 9), "", [], []
    cut = lambda: (version, name, protocols, ciphers, None)
    at = 43
    if at >= n:
        return cut()
    at += 1 + m[at]
    if at + 2 > n:
        return cut()
    size = _u16(m, at)
    at += 2
    if at + size > n:
        return cut()
    ciphers = _known([_u16(m, k) for k in range(at, at + size - 1, 2)])
    at += size
    if at >= n:
        return cut()
    at += 1 + m[at]
    if at + 2 > n:
        return cut()
    end = at + 2 + _u16(m, at)
    at += 2
    kinds, curves, formats = [], [], []
    while at + 4 <= min(end, n):
        kind, size = _u16(m, at), _u16(m, at + 2)
        at += 4
        if at + size > n:
            break
        kinds.append(kind)
        x = m[at : at + size]
        if kind == 0 and size >= 5 and x[2] == 0 and at + 5 + _u16(x, 3) <= n:
            name = m[at + 5 : at + 5 + _u16(x, 3)].decode("latin-1")
        elif kind == 16 and size >= 2:
            k = at + 2
            while k < min(at + size, n):
                length = m[k]
                if k + 1 + length <= n:
                    protocols.append(m[k + 1 : k + 1 + length].decode("latin-1"))
                k += 1 + length
        elif kind == 10 and size >= 2:
            curves += _known([_u16(x, k) for k in range(2, min(size, _u16(x, 0) + 2) - 1, 2)])
        elif kind == 11 and size >= 1:
            formats += x[1 : 1 + x[0]]
        at += size
    joined = ("-".join(map(str, v)) for v in (ciphers, _known(kinds), curves, formats))
    return version, name, protocols, ciphers, ",".join((str(version), *joined))


def dhcp_message(m: bytes) -> tuple[int, bytes, bytes, bytes, str] | None:
    """Operation, client and offered address, hardware address, host name."""
    if len(m) < 240:
        return None
    at, host = (244 if m[240:244] == b"\x63\x82\x53\x63" else 240), ""
    while at + 2 <= len(m) and m[at] != 255:
        if m[at] == 0:
            at += 1
            continue
        size = m[at + 1]
        if at + 2 + size > len(m):
            break
        if m[at] == 12 and size:
            host = m[at + 2 : at + 2 + size].decode("latin-1")
        at += 2 + size
    return m[0], m[12:16], m[16:20], m[28:34], host


def _messages(df: DataFrame) -> DataFrame:
    """Columns of the DNS, TLS and DHCP messages."""
    strings = F.array().cast("array<string>")
    or_else = lambda x, rest: F.coalesce(F.col(x), rest if isinstance(rest, Column) else F.lit(rest))
    seen = lambda x: F.col("dhcp").isNotNull() & F.col(x).isNotNull()
    text = lambda x: F.when(seen(x), c.ip4_text(c.u32(x, 0))).otherwise("")
    return df.withColumns({
        "is_dns": F.col("dns").isNotNull(), "dns_queries": or_else("dns.queries", strings), "dns_answers": or_else("dns.answers", strings),
        "dns_qname_lower": F.coalesce(F.get("dns.queries", F.lit(0)), F.lit("")), "dns_query_count": or_else("dns.asked", 0), "dns_answer_count": or_else("dns.answered", 0),
        "is_tls": F.col("tls").isNotNull(), "tls_version": or_else("tls.version", 0), "tls_sni": or_else("tls.sni", ""), "tls_alpn": or_else("tls.alpn", strings),
        "tls_cipher_suites": or_else("tls.ciphers", F.array().cast("array<int>")), "tls_ja3": F.coalesce(F.md5(F.col("tls.ja3").cast("binary")), F.lit("")),
        "is_dhcp": F.col("dhcp").isNotNull(), "dhcp_op": or_else("dhcp.op", 0), "dhcp_hostname": or_else("dhcp.host", ""),
        "dhcp_client_ip": text("dhcp.client"), "dhcp_your_ip": text("dhcp.your"), "dhcp_client_mac": F.when(seen("dhcp.mac"), c.mac_text("dhcp.mac")).otherwise(""),
    })


PACKETS = (
    "packet_id", "ts_us", "ts", "caplen", "wirelen", "raw_len", "is_ipv4", "is_ipv6", "is_arp", "src_ip", "dst_ip", "src_ip4", "dst_ip4",
    "l4", "src_port", "dst_port", "payload", "payload_off", "payload_len", "tcp", "icmp_type", "icmp_code",
    "is_dns", "dns_qname_lower", "dns_queries", "dns_answers", "dns_query_count", "dns_answer_count",
    "is_http", "http_method", "http_uri", "http_host", "http_user_agent", "http_content_type", "http_status_code", "http_body_offset", "http_body_len",
    "is_tls", "tls_version", "tls_sni", "tls_alpn", "tls_cipher_suites", "tls_ja3",
    "is_dhcp", "dhcp_op", "dhcp_hostname", "dhcp_client_ip", "dhcp_your_ip", "dhcp_client_mac",
    "arp_op", "arp_sender_ip", "arp_target_ip", "arp_sender_mac", "arp_target_mac",
    "cred_username", "cred_password", "cred_protocol",
)


def _ends(df: DataFrame) -> DataFrame:
    """Addresses as text, and the TCP fields as one column."""
    side = lambda k: F.when(F.col("is_ipv4"), c.ip4_text(f"{k}_ip4")).otherwise(F.coalesce(f"{k}_ip6", F.lit("")))
    arp = lambda x: F.when(F.col("arp_ends").isNotNull(), x).otherwise("")
    mac, ip = (lambda k: arp(c.mac_text(c.bytes_at("arp_ends", k, 6)))), (lambda k: arp(c.ip4_text(c.u32("arp_ends", k))))
    bit = lambda k: F.col("flags").bitwiseAND(F.lit(k)) != 0
    return df.withColumns({
        "src_ip": side("src"), "dst_ip": side("dst"),
        "arp_sender_mac": mac(0), "arp_sender_ip": ip(6), "arp_target_mac": mac(10), "arp_target_ip": ip(16),
        "tcp": F.struct(bit(2).alias("syn"), bit(16).alias("ack"), bit(1).alias("fin"), bit(4).alias("rst"), bit(8).alias("psh"), "seq", "ack_num"),
    })


def headers(raw: DataFrame) -> DataFrame:
    """Columns of FIELDS and addresses as text, without HTTP and credentials."""
    keep = ["packet_id", "ts_us", "ts", "caplen", "wirelen"]
    return _ends(_parsed_frames(raw, parsed, FIELDS, keep).withColumn("raw_len", F.col("caplen")))


def decoded(raw: DataFrame, late_dns_tcp: bool = False, auth_plain: bool = False, keep_data: bool = False) -> DataFrame:
    """All packet columns. Every frame gives one row, however broken.

    ``late_dns_tcp`` reads questions over TCP two bytes late; ``keep_data`` keeps the frames in column data.
    """
    keep = ["packet_id", "ts_us", "ts", "caplen", "wirelen", *(["data"] if keep_data else [])]
    df = _parsed_frames(raw, functools.partial(parsed, late_tcp=late_dns_tcp), FIELDS, keep).withColumn("raw_len", F.col("caplen"))
    df = _messages(_ends(settled(_credentials(_http(df), auth_plain))))
    return df.select(*PACKETS, *(["data"] if keep_data else []))


#: Defaults of packet columns, as SQL; '' for those not named.
DEFAULTS = {
    "caplen": "raw_len", "wirelen": "raw_len", "is_ipv4": "true", "is_ipv6": "false", "is_arp": "false", "payload": "cast(null as binary)", "payload_off": "0",
    "tcp": "named_struct('syn', false, 'ack', false, 'fin', false, 'rst', false, 'psh', false, 'seq', 0L, 'ack_num', 0L)", "icmp_type": "0", "icmp_code": "0",
    "is_dns": "false", "dns_queries": "cast(array() as array<string>)", "dns_answers": "cast(array() as array<string>)", "dns_query_count": "0", "dns_answer_count": "0",
    "is_http": "false", "http_status_code": "0", "http_body_offset": "0", "http_body_len": "0", "is_tls": "false", "tls_version": "0",
    "tls_alpn": "cast(array() as array<string>)", "tls_cipher_suites": "cast(array() as array<int>)", "is_dhcp": "false", "dhcp_op": "0", "arp_op": "0",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """All packet columns: those of ``df``, and defaults for the rest."""
    return df.select(*(F.col(k) if k in df.columns else F.expr(DEFAULTS.get(k, "''")).alias(k) for k in PACKETS))


def question_name(m: bytes) -> str:
    """Name of a message's first question in lower case, or '': uncompressed, whole, and of 253 characters at most."""
    if len(m) < 12 or not _u16(m, 4):
        return ""
    at, labels, size = 12, [], 0
    while at < len(m):
        n = m[at]
        if not n:
            return ".".join(labels) if at + 5 <= len(m) else ""
        if n & 0xC0 or at + 1 + n > len(m):
            return ""
        labels.append(m[at + 1 : at + 1 + n].decode("latin-1").translate(_FOLD))
        size += n + 1
        at += 1 + n
        if size > 253:
            return ""
    return ""


def parsed_legacy(data: pa.Array) -> dict[str, pa.Array]:
    """Columns of LEGACY_FIELDS for a batch of frames."""
    f = Frames(data)
    n = f.n
    kind, off, bad = f.ethertypes()
    v4 = ~bad & (kind == IP4) & (off + 20 <= n)
    head, total = f.number(off, 1, v4), f.number(off + 2, 2, v4)
    v4 &= head >> 4 == 4
    hlen = (head & 15) * 4
    whole = v4 & (hlen >= 20) & (off + hlen <= n) & (total >= hlen)
    at, size = np.where(whole, off + hlen, off), np.where(whole, np.minimum(total, n - off) - hlen, n - off)
    proto = np.where(whole, f.number(off + 9, 1, whole), -1)
    tcp, udp = (proto == c.TCP) & (size >= 20), (proto == c.UDP) & (size >= 8)
    thl, length = (f.number(at + 12, 1, tcp) >> 4) * 4, f.number(at + 4, 2, udp)
    tcp_ok, udp_ok = tcp & (thl >= 20) & (size >= thl), udp & (length >= 8)
    skip = _pick((tcp_ok, thl), (udp, 8))(0)
    size = np.where(udp_ok, np.minimum(length, size) - 8, size - skip)
    src_port, dst_port = f.number(at, 2, tcp | udp), f.number(at + 2, 2, tcp | udp)
    payload = f.pieces(at + skip, size, np.ones(len(n), dtype=bool))
    asked, names = (tcp_ok | udp_ok) & ((src_port == 53) | (dst_port == 53)), [""] * len(n)
    for i in np.nonzero(asked)[0]:
        m = payload[i].as_py()
        if tcp[i]:
            m = m[2 : 2 + _u16(m, 0)] if len(m) >= 2 and _u16(m, 0) + 2 <= size[i] else b""
        names[i] = question_name(m)
    i32 = lambda x: pa.array(x.astype(np.int32))
    return {
        "is_ipv4": pa.array(v4), "src_ip4": pa.array(f.number(off + 12, 4, whole)), "dst_ip4": pa.array(f.number(off + 16, 4, whole)),
        "l4": i32(_pick((tcp, c.TCP), (udp, c.UDP), (proto == c.ICMP, c.ICMP))(c.OTHER)), "src_port": i32(src_port), "dst_port": i32(dst_port),
        "payload": payload, "payload_off": i32(at + skip), "payload_len": i32(size), "dns_qname_lower": pa.array(names, pa.string()),
    }


LEGACY_FIELDS = "is_ipv4 boolean, src_ip4 long, dst_ip4 long, l4 int, src_port int, dst_port int, payload binary, payload_off int, payload_len int, dns_qname_lower string"


def legacy(raw: DataFrame) -> DataFrame:
    """Packet columns of the legacy profile: IPv4 only, all bounded by the IP length, and the first DNS question.

    A broken IPv4 header still counts as IPv4, from and to 0.0.0.0; a transport header that is cut counts as other.
    """
    df = _parsed_frames(raw, parsed_legacy, LEGACY_FIELDS, ["packet_id", "ts_us", "ts", "caplen", "wirelen"])
    return with_defaults(df.withColumns({f"{x}_ip": c.ip4_text(f"{x}_ip4") for x in ("src", "dst")}).withColumn("raw_len", F.col("caplen")))
