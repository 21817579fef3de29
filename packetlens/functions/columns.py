"""Scalar functions over bytes, addresses and text, as Column expressions.

Payload bytes are read as Latin-1 text, one character a byte, so that lengths and places are byte counts; letter case
is folded for ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\r\n"
#: Last digest input and constant of the 11-bit port hash (fixed value).
GOLDEN = 0x9E3779B1
U32 = (1 << 32) - 1

TCP, UDP, ICMP, ICMPV6, OTHER = 6, 17, 1, 58, 0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ival(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def unsigned(data: Column | str, at: Column | int, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes (at most 7) at byte ``at`` (0-based); null past the end."""
    part = F.substring(col(data), ival(at) + 1, F.lit(width))
    whole = F.conv(F.hex(part), 16, 10).cast("long")
    return F.when(F.octet_length(part) == width, whole)


def u8(data: Column | str, at: Column | int) -> Column:
    return unsigned(data, at, 1).cast("int")


def u16(data: Column | str, at: Column | int) -> Column:
    return unsigned(data, at, 2).cast("int")


def u32(data: Column | str, at: Column | int) -> Column:
    return unsigned(data, at, 4)


def bytes_at(data: Column | str, at: Column | int, size: Column | int) -> Column:
    """``size`` bytes from byte ``at``, fewer at the end; no bytes for a size below one."""
    return F.substring(col(data), ival(at) + 1, F.greatest(ival(size), F.lit(0)))


def latin1(data: Column | str) -> Column:
    return F.decode(col(data), "ISO-8859-1")


def trim_blank(s: Column | str) -> Column:
    return F.trim(col(s), F.lit(BLANK))


def ascii_lower(s: Column | str) -> Column:
    return F.translate(col(s), UPPER, LOWER)


def starts_with(s: Column | str, prefix: str) -> Column:
    return F.startswith(col(s), F.lit(prefix))


def ip4_text(ip: Column | str) -> Column:
    """Dotted text of a host-order IPv4 number; '' for null."""
    x = col(ip)
    octet = lambda k: F.shiftright(x, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.when(x.isNull(), "").otherwise(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))


def parse_ip4(s: Column | str) -> Column:
    """Host-order number of strictly dotted text: four decimal parts of 0 to 255 without leading zeros; else null."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    pattern = f"^{part}\\.{part}\\.{part}\\.{part}$"
    text = col(s)
    # the pattern's end also matches before a final line feed
    sound = text.rlike(pattern) & ~text.contains("\n")
    nums = [F.regexp_extract(text, pattern, k).cast("long") for k in (1, 2, 3, 4)]
    return F.when(sound, nums[0] * (1 << 24) + nums[1] * (1 << 16) + nums[2] * 256 + nums[3])


def ip6_text(data: Column | str) -> Column:
    """RFC 5952 text of 16 bytes: the longest run of two or more zero groups, the first of equals, becomes '::'."""
    groups = F.concat_ws(":", *(ascii_lower(F.regexp_replace(F.hex(bytes_at(data, 2 * k, 2)), "^0{1,3}", "")) for k in range(8)))
    out = groups
    # from the longest run down; a run that is found is cut once and ends the search
    for n in range(2, 9):
        run = ":".join("0" * n)
        here = F.concat(F.lit(":"), groups, F.lit(":"))
        found = F.instr(here, f":{run}:")
        cut = F.concat(F.substring(here, F.lit(1), found - 1), F.lit("::"), F.substring(here, found + len(run) + 2, F.lit(64)))
        out = F.when(found > 0, F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")).otherwise(out)
    # inet_ntop writes IPv4-mapped and IPv4-compatible addresses with a dotted tail
    tail = ip4_text(u32(data, 12))
    zeros = F.hex(bytes_at(data, 0, 10)) == F.lit("00" * 10)
    mapped = zeros & (F.hex(bytes_at(data, 10, 2)) == "FFFF")
    compatible = zeros & (F.hex(bytes_at(data, 10, 2)) == "0000") & (u16(data, 12) != 0)
    return F.when(mapped, F.concat(F.lit("::ffff:"), tail)).when(compatible, F.concat(F.lit("::"), tail)).otherwise(out)


def mac_text(data: Column | str) -> Column:
    pairs = F.regexp_replace(ascii_lower(F.hex(col(data))), "(..)(?=.)", "$1:")
    return F.coalesce(pairs, F.lit(""))


def hex_preview(data: Column | str, size: int = 64) -> Column:
    return ascii_lower(F.hex(bytes_at(data, 0, size)))


def iso8601(ts_us: Column | str) -> Column:
    """UTC time to the second, whatever the session's zone."""
    days = F.floor(col(ts_us) / 86_400_000_000).cast("int")
    rest = F.pmod(F.floor(col(ts_us) / 1_000_000), F.lit(86_400)).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def epoch_double(ts_us: Column | str) -> Column:
    """Seconds and micros added in double precision."""
    us = col(ts_us)
    return F.floor(us / 1_000_000).cast("double") + F.pmod(us, F.lit(1_000_000)).cast("double") / 1e6


def json_escape(s: Column | str) -> Column:
    """The text between the quotes of its JSON string."""
    quoted = F.to_json(F.array(col(s)))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def entropy(s: Column | str) -> Column:
    """Shannon entropy in bits a character; terms are added by ascending character. 0 for empty text."""
    n = F.length(col(s)).cast("double")

    def term(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(col(s), c, F.lit("")))) / n
        return acc - p * F.log2(p)

    each = F.aggregate(F.sort_array(F.array_distinct(F.split(col(s), ""))), F.lit(0.0), term)
    return F.when(F.length(col(s)) > 0, each).otherwise(F.lit(0.0))


def redact(s: Column | str) -> Column:
    """All stars up to four characters; else two at either end stay."""
    x = col(s)
    n = F.length(x)
    long = F.concat(F.substring(x, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(x, n - 1, F.lit(2)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(long)


def extract_strings(data: Column | str, limit: int = 2048, least: int = 4) -> Column:
    """Trimmed printable runs of at least ``least`` bytes in the first ``limit`` bytes."""
    runs = F.regexp_extract_all(latin1(bytes_at(data, 0, limit)), F.lit(f"[\\x20-\\x7E\\t\\n\\r]{{{least},}}"), F.lit(0))
    return F.filter(F.transform(runs, trim_blank), lambda s: F.length(s) >= least)


def hash16(x: Column | str) -> Column:
    v = col(x).cast("long")
    v = v.bitwiseXOR(F.shiftright(v, 7))
    v = (v * GOLDEN).bitwiseAND(F.lit(U32))
    return v.bitwiseXOR(F.shiftright(v, 11))


def bucket(port: Column | str) -> Column:
    """Place of a port in the 2,048-bit sketch."""
    return hash16(port).bitwiseAND(F.lit(2047).cast("long")).cast("int")


def is_private(ip: Column | str) -> Column:
    """10/8, 172.16/12, 192.168/16 and 127/8 of a host-order number; false for null."""
    x = col(ip)
    inside = lambda bits, net: F.shiftright(x, 32 - bits) == F.lit(net)
    return F.coalesce(inside(8, 10) | inside(12, (172 << 4) + 1) | inside(16, (192 << 8) + 168) | inside(8, 127), F.lit(False))


def outbound(src: Column | str = "src_ip4", dst: Column | str = "dst_ip4") -> Column:
    """From a private to a public address."""
    return is_private(src) & ~is_private(dst)


def proto_name(l4: Column | str = "l4", other: str = "OTHER") -> Column:
    x = col(l4)
    return F.when(x == TCP, "TCP").when(x == UDP, "UDP").when(x == ICMP, "ICMP").when(x == ICMPV6, "ICMPv6").otherwise(other)


def alert_proto(l4: Column | str = "l4") -> Column:
    """Alerts tell TCP from all the rest."""
    return F.when(col(l4) == TCP, "TCP").otherwise("UDP")


#: Alert types (fixed values), two of them reserved.
ALERT_TYPES = (
    "blocklisted_ip", "blocklisted_domain", "keyword_match", "port_scan", "dns_tunnel", "beaconing", "exfiltration",
    "suspicious_tls", "arp_spoof", "sensitive_data",
)


def severity(kind: Column | str = "type") -> Column:
    x = col(kind)
    return (
        F.when(x.isin("blocklisted_ip", "blocklisted_domain", "exfiltration"), "critical")
        .when(x.isin("port_scan", "dns_tunnel", "beaconing"), "high")
        .when(x.isin("keyword_match", "sensitive_data"), "medium")
        .otherwise("low")
    )


def host_role(src_bytes: Column | str, dst_bytes: Column | str) -> Column:
    return F.when(col(src_bytes) > col(dst_bytes), "Client").otherwise("Server")


#: Carved files: extension by content type, then by leading bytes (fixed values).
BY_TYPE = (
    ("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/gif", ".gif"), ("text/html", ".html"),
    ("application/pdf", ".pdf"), ("application/zip", ".zip"), ("application/javascript", ".js"), ("text/css", ".css"),
)
BY_MAGIC = (
    ("FFD8FF", ".jpg"), ("89504E47", ".png"), ("474946", ".gif"), ("25504446", ".pdf"), ("504B0304", ".zip"),
    ("4D5A", ".exe"), ("7F454C46", ".elf"),
)


def file_extension(content_type: Column | str, body: Column | str) -> Column:
    head = F.hex(bytes_at(body, 0, 4))
    by_type = F.lit(".bin")
    for name, ext in reversed(BY_TYPE):
        by_type = F.when(col(content_type).contains(name), ext).otherwise(by_type)
    out = by_type
    for magic, ext in reversed(BY_MAGIC):
        out = F.when(F.startswith(head, F.lit(magic)), ext).otherwise(out)
    return F.when(F.octet_length(col(body)) >= 4, out).otherwise(by_type)
