"""Builders of frames and capture files for tests."""

from __future__ import annotations

import socket
import struct


def eth(payload: bytes, kind: int = 0x0800, tags: tuple[int, ...] = ()) -> bytes:
    out = bytes(range(12))
    for t in tags:
        out += struct.pack(">HH", 0x8100, t)
    return out + struct.pack(">H", kind) + payload


def ip4(payload: bytes, proto: int = 6, src: str = "10.0.0.1", dst: str = "8.8.8.8", total: int | None = None, options: bytes = b"", frag: int = 0) -> bytes:
    size = 20 + len(options) + len(payload) if total is None else total
    return struct.pack(">BBHHHBBH4s4s", 0x45 + len(options) // 4, 0, size, 0, frag, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + options + payload


def ip6(payload: bytes, next_header: int = 6, src: str = "2001:db8::1", dst: str = "2001:db8::2") -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), next_header, 64) + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + payload


def tcp(payload: bytes = b"", sport: int = 40000, dport: int = 80, flags: int = 0x18, offset: int = 5, seq: int = 1, ack: int = 2) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, offset << 4, flags, 8192, 0, 0) + payload


def udp(payload: bytes = b"", sport: int = 40000, dport: int = 53, length: int | None = None) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if length is None else length, 0) + payload


def name(host: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in host.split(".")) + b"\0"


def dns(*hosts: str, answers: bytes = b"", count: int = 0) -> bytes:
    return struct.pack(">HHHHHH", 7, 0x100, len(hosts), count, 0, 0) + b"".join(name(h) + struct.pack(">HH", 1, 1) for h in hosts) + answers


def answer(kind: int, data: bytes, owner: bytes = b"\xc0\x0c") -> bytes:
    return owner + struct.pack(">HHIH", kind, 1, 60, len(data)) + data


def extension(kind: int, data: bytes) -> bytes:
    return struct.pack(">HH", kind, len(data)) + data


def hello(host: str = "www.example.com", alpn: tuple[str, ...] = ("h2", "http/1.1"), ciphers: tuple[int, ...] = (0x1301, 0x0A0A, 0xC02F), curves: tuple[int, ...] = (29, 0x1A1A, 23), formats: tuple[int, ...] = (0,), bare: bool = False) -> bytes:
    ext = b""
    if not bare:
        sni = struct.pack(">BH", 0, len(host)) + host.encode()
        ext += extension(0x2A2A, b"") + extension(0, struct.pack(">H", len(sni)) + sni)
        ext += extension(10, struct.pack(">H", 2 * len(curves)) + b"".join(struct.pack(">H", x) for x in curves))
        ext += extension(11, bytes([len(formats), *formats]))
        listed = b"".join(bytes([len(p)]) + p.encode() for p in alpn)
        ext += extension(16, struct.pack(">H", len(listed)) + listed)
        ext = struct.pack(">H", len(ext)) + ext
    body = struct.pack(">H", 0x0303) + b"r" * 32 + b"\0" + struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", x) for x in ciphers) + b"\x01\0" + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def dhcp(host: str = "box", cookie: bool = True) -> bytes:
    head = bytes([1, 1, 6, 0]) + b"\0" * 8 + socket.inet_aton("10.0.0.9") + socket.inet_aton("10.0.0.10") + b"\0" * 8 + bytes.fromhex("aabbccddeeff")
    head = head.ljust(240, b"\0")
    return head + (b"\x63\x82\x53\x63" if cookie else b"") + b"\0\0" + bytes([53, 1, 1, 12, len(host)]) + host.encode() + b"\xff"


def arp(op: int = 1) -> bytes:
    return struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + bytes.fromhex("aabbccddeeff") + socket.inet_aton("10.0.0.1") + b"\0" * 6 + socket.inet_aton("10.0.0.2")


def pcap(frames: list[tuple[int, bytes]], order: str = "<", nanos: bool = False, linktype: int = 1) -> bytes:
    """A classic capture of (ts_us, frame)."""
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 65535, linktype)
    for us, f in frames:
        out += struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000 * (1000 if nanos else 1) + (999 if nanos else 0), len(f), len(f)) + f
    return out


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body = body.ljust((len(body) + 3) // 4 * 4, b"\0")
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def pcapng(frames: list[tuple[int, bytes]], order: str = "<", resolution: int = 6, simple: bool = False) -> bytes:
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, resolution) + struct.pack(order + "HH", 0, 0), order)
    for us, f in frames:
        ticks = us * 10**resolution // 1_000_000
        body = struct.pack(order + "I", len(f)) + f if simple else struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f
        out += block(3 if simple else 6, body, order)
    return out
