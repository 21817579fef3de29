"""Capture filter expressions over raw packets, evaluated by numpy on whole Arrow batches of frames.

Understood: [src|dst|src or dst|src and dst] host, net (with /length or mask), port, portrange, with ids in brackets or
carried on to the next bare id; tcp, udp, sctp, icmp, icmp6, igmp, ip, ip6, arp, rarp; [ip|ip6] proto N; ether proto N;
ether [src|dst|host] MAC; [ether|ip|ip6] broadcast and multicast; vlan [N]; less N, greater N; comparisons of numbers,
len, and bytes such as tcp[tcpflags] & tcp-syn != 0; and, or, not, &&, ||, !, parentheses. Anything else is an error.

``and`` and ``or`` bind alike, from left to right. Each vlan moves what follows it one tag further; without it, frames
that have a tag are not looked into. A test that reads beyond a frame's end is false. Ports are those of whole packets
and first fragments.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetlens.operators.decode import ARP, IP4, IP6, RARP, Frames

# Protocol numbers, well-known ports, and the names that byte tests know.
VLANS = (0x8100, 0x88A8, 0x9100)
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "icmp6": 58, "ospf": 89, "sctp": 132}
TYPES = {"ip": IP4, "ip6": IP6, "arp": ARP, "rarp": RARP}
PORTS = {
    "ftp-data": 20, "ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "bootps": 67, "bootpc": 68, "tftp": 69, "http": 80, "kerberos": 88,
    "pop3": 110, "sunrpc": 111, "ntp": 123, "imap": 143, "imap2": 143, "snmp": 161, "snmptrap": 162, "bgp": 179, "ldap": 389, "https": 443, "syslog": 514,
    "submission": 587, "ldaps": 636, "imaps": 993, "pop3s": 995, "mysql": 3306, "postgresql": 5432, "sip": 5060, "http-alt": 8080,
}
CONSTANTS = {
    "icmptype": 0, "icmpcode": 1, "icmp6type": 0, "icmp6code": 1, "tcpflags": 13,
    "tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32, "tcp-ece": 64, "tcp-cwr": 128,
    "icmp-echoreply": 0, "icmp-unreach": 3, "icmp-sourcequench": 4, "icmp-redirect": 5, "icmp-echo": 8, "icmp-routeradvert": 9, "icmp-routersolicit": 10,
    "icmp-timxceed": 11, "icmp-paramprob": 12, "icmp-tstamp": 13, "icmp-tstampreply": 14, "icmp-ireq": 15, "icmp-ireqreply": 16, "icmp-maskreq": 17, "icmp-maskreply": 18,
    "icmp6-echo": 128, "icmp6-echoreply": 129, "icmp6-routersolicit": 133, "icmp6-routeradvert": 134, "icmp6-neighborsolicit": 135, "icmp6-neighboradvert": 136,
}
_WORDS = (
    ("space", r"\s+"), ("range", r"\d+-\d+"), ("mac", r"[0-9A-Fa-f]{1,2}(?:[:-][0-9A-Fa-f]{1,2}){5}"), ("six", r"[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:/\d+)?"),
    ("four", r"\d+(?:\.\d+){1,3}(?:/\d+)?|\d+/\d+"), ("word", r"\\?[A-Za-z][A-Za-z0-9_]*(?:-[A-Za-z][A-Za-z0-9_]*)*"), ("number", r"0[xX][0-9A-Fa-f]+|\d+"),
    ("sign", r"&&|\|\||<<|>>|<=|>=|!=|==|[][()!<>=&|+*/%^:-]"),
)
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _WORDS))
#: Inside brackets, where signs are sums.
_INNER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _WORDS if k not in ("range", "mac", "six", "four")))
Test = Callable[["View"], np.ndarray]
Value = Callable[["View"], tuple[np.ndarray, np.ndarray]]


class FilterError(ValueError):
    """An expression that is not understood."""


class View(Frames):
    """Frames with what tests ask of them, by the number of tags that lie before."""

    def __init__(self, data: pa.Array, wirelen: np.ndarray):
        super().__init__(data)
        self.wirelen = wirelen

    def load(self, at: np.ndarray | int, width: int, ok: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, and where they could be read."""
        at = at + np.zeros(len(self.n), dtype=np.int64)
        ok = (at >= 0) & (at + width <= self.n) & ok
        return self.number(at, width, ok), ok

    def kind(self, depth: int) -> np.ndarray:
        return self.load(12 + 4 * depth, 2)[0]

    def of(self, depth: int, name: str) -> np.ndarray:
        return (self.kind(depth) == TYPES[name]) & (self.n >= 14 + 4 * depth)

    def protocol(self, depth: int, number: int, name: str | None = None) -> np.ndarray:
        """IPv4 protocol or IPv6 next header, the one that a fragment header names too."""
        off = 14 + 4 * depth
        four, ok4 = self.load(off + 9, 1, self.of(depth, "ip"))
        six, ok6 = self.load(off + 6, 1, self.of(depth, "ip6"))
        behind, cut = self.load(off + 40, 1, ok6 & (six == 44))
        out4, out6 = ok4 & (four == number), ok6 & ((six == number) | (cut & (behind == number)))
        return {"ip": out4, "ip6": out6}.get(name or "", out4 | out6)

    def transport(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the transport header begins, and for which frames there is one at hand."""
        off = 14 + 4 * depth
        head, ok4 = self.load(off, 1, self.of(depth, "ip"))
        fragment, seen = self.load(off + 6, 2, ok4)
        six = self.of(depth, "ip6") & (self.n >= off + 40)
        return np.where(six, off + 40, off + (head & 15) * 4), (ok4 & seen & (fragment & 0x1FFF == 0)) | six

    def port(self, depth: int, side: str, numbers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        at, ok = self.transport(depth)
        off, six = 14 + 4 * depth, self.of(depth, "ip6")
        proto = np.where(six, self.load(off + 6, 1, six)[0], self.load(off + 9, 1, ~six)[0])
        return self.load(at + (0 if side == "src" else 2), 2, ok & np.isin(proto, numbers))


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = inner = 0
        while at < len(text):
            m = (_INNER if inner else _TOKEN).match(text, at)
            if not m:
                raise FilterError(f"unexpected {text[at:].strip()!r}")
            before = self.tokens[-1][1].lower() if self.tokens else ""
            if m.lastgroup in ("range", "four") and not (m.lastgroup == "four" and "." in m[0]) and before not in ("portrange", "net", "or", "and", "(", "||", "&&"):
                m = _INNER.match(text, at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            inner += (m[0] == "[") - (m[0] == "]")
            at = m.end()
        self.at = self.depth = 0
        #: Protocol, sides and kind of the last qualified id, for the bare ids behind it.
        self.last: tuple[str | None, str, str] | None = None

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1].lower() if self.at + ahead < len(self.tokens) else ""

    def group(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise FilterError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def taken(self, *words: str) -> str:
        """The next word if it is one of these."""
        return self.take().lower() if self.peek() in words else ""

    def number(self, most: int) -> int:
        try:
            n = int(x := self.take(), 0)
        except ValueError:
            raise FilterError(f"{x!r} is no number") from None
        if not 0 <= n <= most:
            raise FilterError(f"{n} is out of range")
        return n

    def whole(self) -> Test:
        if not self.tokens:
            return lambda v: np.ones(len(v.n), dtype=bool)
        out = self.joined(self.one)
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def joined(self, part: Callable[[], Test]) -> Test:
        out = part()
        while word := self.taken("and", "or", "&&", "||"):
            a, b = out, part()
            out = (lambda v, a=a, b=b: a(v) & b(v)) if word in ("and", "&&") else (lambda v, a=a, b=b: a(v) | b(v))
        return out

    def one(self) -> Test:
        if self.taken("not", "!"):
            inner = self.one()
            return lambda v: ~inner(v)
        if (found := self.comparison()) is not None:
            return found
        if self.taken("("):
            return self.closed(self.joined(self.one))
        return self.primitive()

    def closed(self, inner):
        if self.take() != ")":
            raise FilterError("a parenthesis is not closed")
        return inner

    # --- comparisons

    def comparison(self) -> Test | None:
        """A comparison of two numbers, or nothing (and nothing taken) if there is none here."""
        word, begun = self.peek(), self.at
        if not (word in ("(", "-", "len") or self.group() == "number" or word in CONSTANTS or self.peek(1) == "["):
            return None
        try:
            left = self.sum()
            sign = self.taken("<", ">", "<=", ">=", "=", "==", "!=")
        except FilterError:
            if self.peek(begun - self.at + 1) == "[":
                raise
            sign = ""
        if not sign:
            self.at = begun
            return None
        right = self.sum()
        compare = {"<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "=": np.equal, "==": np.equal, "!=": np.not_equal}[sign]

        def test(v: View) -> np.ndarray:
            (a, ok), (b, too) = left(v), right(v)
            return compare(a, b) & ok & too

        return test

    LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))

    def sum(self, level: int = 0) -> Value:
        if level == len(self.LEVELS):
            return self.operand()
        out = self.sum(level + 1)
        while sign := self.taken(*self.LEVELS[level]):
            out = self.combined(sign, out, self.sum(level + 1))
        return out

    @staticmethod
    def combined(sign: str, left: Value, right: Value) -> Value:
        """32-bit unsigned arithmetic; a division by zero can't be read."""

        def value(v: View) -> tuple[np.ndarray, np.ndarray]:
            (a, ok), (b, too) = left(v), right(v)
            ok = ok & too & ((b != 0) if sign in "/%" else True)
            a, b = a.astype(np.uint64), np.where(ok, b, 1).astype(np.uint64)
            shift = np.minimum(b, np.uint64(32))
            out = {
                "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "<<": lambda: a << shift, ">>": lambda: a >> shift, "+": lambda: a + b,
                "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a // b, "%": lambda: a % b,
            }[sign]()
            return (out & np.uint64(0xFFFFFFFF)).astype(np.int64), ok

        return value

    def operand(self) -> Value:
        constant = lambda n: lambda v: (np.full(len(v.n), n & 0xFFFFFFFF), np.ones(len(v.n), dtype=bool))
        if self.taken("-"):
            return self.combined("-", constant(0), self.operand())
        if self.taken("("):
            return self.closed(self.sum())
        if self.group() == "number":
            return constant(self.number(0xFFFFFFFF))
        word = self.take().lower()
        if word == "len":
            return lambda v: (v.wirelen, np.ones(len(v.n), dtype=bool))
        if word in CONSTANTS:
            return constant(CONSTANTS[word])
        if word not in (*TYPES, *PROTOCOLS, "ether", "link") or self.take() != "[":
            raise FilterError(f"{word!r} is no number")
        place, width = self.sum(), 1
        if self.taken(":"):
            width = self.number(4)
            if width not in (1, 2, 4):
                raise FilterError("bytes are read by 1, 2 or 4")
        if self.take() != "]":
            raise FilterError("a bracket is not closed")
        depth = self.depth

        def read(v: View) -> tuple[np.ndarray, np.ndarray]:
            at, ok = place(v)
            if word in TYPES:
                at, ok = at + 14 + 4 * depth, ok & v.of(depth, word)
            elif word in PROTOCOLS:
                start, whole = v.transport(depth)
                at, ok = at + start, ok & whole & v.protocol(depth, PROTOCOLS[word], "ip6" if word == "icmp6" else "ip")
            return v.load(at, width, ok)

        return read

    # --- primitives

    def primitive(self) -> Test:
        depth = self.depth
        bare = self.group() in ("number", "four", "six", "mac", "range") or (self.peek() in PORTS and self.last and self.last[2] == "port")
        if bare and self.last:
            return self.id(*self.last)
        word = self.take().lower()
        if word == "vlan":
            tag = self.number(4095) if self.group() == "number" else None
            self.depth += 1

            def tagged(v: View) -> np.ndarray:
                value, ok = v.load(14 + 4 * depth, 2)
                return np.isin(v.kind(depth), VLANS) & (ok & (value & 0xFFF == tag) if tag is not None else True)

            return tagged
        if word in ("less", "greater"):
            n = self.number(1 << 31)
            return (lambda v: v.wirelen <= n) if word == "less" else (lambda v: v.wirelen >= n)
        if word in ("broadcast", "multicast"):
            return self.to_many("ether", word)
        protocol = word if word in (*TYPES, *PROTOCOLS, "ether") else None
        if protocol:
            if self.peek() in ("broadcast", "multicast") and protocol in ("ether", "ip", "ip6"):
                return self.to_many(protocol, self.take().lower())
            if self.peek() == "proto" and protocol in ("ether", "ip", "ip6"):
                self.take()
                return self.numbered(protocol)
            if self.peek() not in ("src", "dst", "host", "net", "port", "portrange"):
                if protocol == "ether":
                    raise FilterError("ether must be followed by what of it")
                return self.of(protocol)
            word = self.take().lower()
        if word == "proto":
            return self.numbered(None)
        sides = "either"
        if word in ("src", "dst"):
            sides = word
            if self.peek() in ("or", "and") and self.peek(1) in ("src", "dst") and self.peek(1) != word:
                sides = {"or": "either", "and": "both"}[self.take().lower()]
                self.take()
            word = self.take().lower() if self.peek() in ("host", "net", "port", "portrange") else "host"
        if word not in ("host", "net", "port", "portrange"):
            raise FilterError(f"unknown word {word!r}")
        self.last = (protocol, sides, word)
        if self.taken("("):
            return self.closed(self.joined(self.listed))
        return self.id(*self.last)

    def listed(self) -> Test:
        """An id in brackets, behind its qualifiers."""
        if self.taken("not", "!"):
            inner = self.listed()
            return lambda v: ~inner(v)
        if self.taken("("):
            return self.closed(self.joined(self.listed))
        return self.id(*self.last)

    def of(self, protocol: str) -> Test:
        depth = self.depth
        if protocol in TYPES:
            return lambda v: v.of(depth, protocol)
        name = {"icmp": "ip", "igmp": "ip", "icmp6": "ip6"}.get(protocol)
        return lambda v: v.protocol(depth, PROTOCOLS[protocol], name)

    def numbered(self, protocol: str | None) -> Test:
        depth, name = self.depth, self.peek().removeprefix("\\")
        if protocol == "ether":
            n = TYPES[name] if name in TYPES and self.take() else self.number(0xFFFF)
            return lambda v: (v.kind(depth) == n) & (v.n >= 14 + 4 * depth)
        n = PROTOCOLS[name] if name in PROTOCOLS and self.take() else self.number(255)
        return lambda v: v.protocol(depth, n, protocol)

    def to_many(self, protocol: str, word: str) -> Test:
        depth, off = self.depth, 14 + 4 * self.depth

        def test(v: View) -> np.ndarray:
            if protocol == "ether":
                high, ok = v.load(0, 2)
                low, _ = v.load(2, 4)
                return ok & ((high == 0xFFFF) & (low == 0xFFFFFFFF) if word == "broadcast" else high >> 8 & 1 == 1)
            first, ok = v.load(off + (16 if protocol == "ip" else 24), 4, v.of(depth, protocol))
            if word == "broadcast":
                return ok & np.isin(first, (0, 0xFFFFFFFF))
            return ok & (first >> 28 == 14 if protocol == "ip" else first >> 24 == 255)

        return test

    def id(self, protocol: str | None, sides: str, kind: str) -> Test:
        side = {"host": self.host, "net": self.net, "port": self.port, "portrange": self.portrange}[kind](protocol)
        if sides in ("src", "dst"):
            return lambda v: side(v, sides)
        return (lambda v: side(v, "src") & side(v, "dst")) if sides == "both" else (lambda v: side(v, "src") | side(v, "dst"))

    def host(self, protocol: str | None):
        value = self.take()
        if protocol == "ether":
            parts = re.split("[:-]", value)
            if len(parts) != 6 or not all(re.fullmatch("[0-9A-Fa-f]{1,2}", x) for x in parts):
                raise FilterError(f"{value!r} is no hardware address")
            mac = int("".join(x.zfill(2) for x in parts), 16)

            def hardware(v: View, side: str) -> np.ndarray:
                at = 6 if side == "src" else 0
                high, low = v.load(at, 2), v.load(at + 2, 4)
                return high[1] & low[1] & (high[0] << 32 | low[0] == mac)

            return hardware
        try:
            ip = ipaddress.ip_address(value)
        except ValueError:
            raise FilterError(f"{value!r} is no address") from None
        return self.within(protocol, ip.version, int(ip), ip.max_prefixlen)

    def net(self, protocol: str | None):
        value = self.take()
        if ":" not in value:
            first, slash, length = value.partition("/")
            parts = first.split(".")
            value = ".".join(parts + ["0"] * (4 - len(parts))) + "/" + (length if slash else str(8 * len(parts)))
            if self.taken("mask"):
                value = f"{value.partition('/')[0]}/{self.take()}"
        try:
            n = ipaddress.ip_network(value)
        except ValueError as e:
            raise FilterError(str(e)) from None
        return self.within(protocol, n.version, int(n.network_address), n.prefixlen)

    def within(self, protocol: str | None, version: int, address: int, length: int):
        """Addresses whose first ``length`` bits are those of ``address``."""
        depth, off = self.depth, 14 + 4 * self.depth

        def four(v: View, at: int, ok: np.ndarray) -> np.ndarray:
            value, ok = v.load(off + at, 4, ok)
            return ok & (value >> (32 - length) == address >> (32 - length))

        def test4(v: View, side: str) -> np.ndarray:
            src = side == "src"
            kinds = [protocol] if protocol in ("ip", "arp", "rarp") else ["ip"] if protocol else ["ip", "arp", "rarp"]
            out = np.zeros(len(v.n), dtype=bool)
            for name in kinds:
                out |= four(v, (12 if src else 16) if name == "ip" else (14 if src else 24), v.of(depth, name))
            return out & v.protocol(depth, PROTOCOLS[protocol]) if protocol in PROTOCOLS else out

        def test6(v: View, side: str) -> np.ndarray:
            out = v.of(depth, "ip6")
            for k in range(0, length, 32):
                value, ok = v.load(off + (8 if side == "src" else 24) + k // 8, 4, out)
                rest = max(0, 32 - (length - k))
                out = ok & (value >> rest == (address >> (96 - k) & 0xFFFFFFFF) >> rest)
            return out & v.protocol(depth, PROTOCOLS[protocol]) if protocol in PROTOCOLS else out

        if protocol == "ip6" and version == 4 or protocol in ("ip", "arp", "rarp") and version == 6:
            raise FilterError("an address of the other version")
        return test4 if version == 4 else test6

    def ports(self, protocol: str | None) -> tuple[int, ...]:
        if protocol not in (None, "ip", "ip6", "tcp", "udp", "sctp"):
            raise FilterError(f"{protocol} has no ports")
        return (PROTOCOLS[protocol],) if protocol in PROTOCOLS else (6, 17, 132)

    def port(self, protocol: str | None):
        return self.between(protocol, n := self._port(self.take()), n)

    def portrange(self, protocol: str | None):
        a, dash, b = self.take().partition("-")
        if not dash:
            raise FilterError(f"{a!r} is no range")
        return self.between(protocol, *sorted((self._port(a), self._port(b))))

    def between(self, protocol: str | None, lo: int, hi: int):
        depth, numbers = self.depth, self.ports(protocol)

        def test(v: View, side: str) -> np.ndarray:
            value, ok = v.port(depth, side, numbers)
            of = v.of(depth, protocol) if protocol in ("ip", "ip6") else True
            return ok & (value >= lo) & (value <= hi) & of

        return test

    @staticmethod
    def _port(value: str) -> int:
        if value.lower() in PORTS:
            return PORTS[value.lower()]
        if not value.isdigit() or int(value) > 65535:
            raise FilterError(f"{value!r} is no port")
        return int(value)


def where(raw: DataFrame, expression: str) -> DataFrame:
    """Raw packets that the expression selects, in one pass; the expression is read here, so that errors show at once."""
    _Parser(expression).whole()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _Parser(expression).whole()
        for b in batches:
            of = dict(zip(b.schema.names, b.columns))
            view = View(of["data"], of["wirelen"].to_numpy(zero_copy_only=False).astype(np.int64))
            yield b.filter(pa.array(test(view), pa.bool_()))

    return raw.mapInArrow(stream, raw.schema)
