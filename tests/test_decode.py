import hashlib
import random

import frames as fr
import pytest
from pyspark.sql import functions as F

from packetlens.operators import decode
from packetlens.plans.bpf import FilterError, where

HTTP = b"GET /a b HTTP/1.1\r\nHOST:  h.example:8080 \r\nhost: last.example\r\nUser-Agent: u\r\n\r\nbody"
REPLY = b"HTTP/1.1 204 No Content\r\nContent-Type: text/css\r\n\r\n" + b"z" * 20
CASES = {
    "short": b"\x01" * 9,
    "plain": fr.eth(fr.ip4(fr.tcp(b"hi", 1234, 9999, 0x12))),
    "tagged": fr.eth(fr.ip4(fr.udp(b"hey", 5, 6)), tags=(1, 2)),
    "cut tag": fr.eth(b"", 0x8100) + b"\0",
    "lldp": fr.eth(b"abc", 0x88CC),
    "arp": fr.eth(fr.arp(2), 0x0806),
    "short arp": fr.eth(fr.arp()[:20], 0x0806),
    "short rarp": fr.eth(fr.arp()[:20], 0x8035),
    "options": fr.eth(fr.ip4(fr.tcp(b"o"), options=b"\1\1\1\1")),
    "bad version": fr.eth(b"\x65" + fr.ip4(fr.tcp(b"o"))[1:]),
    "small total": fr.eth(fr.ip4(fr.tcp(b"o"), total=19)),
    "large total": fr.eth(fr.ip4(fr.udp(b"abc", 7, 8, 900), 17, total=999)),
    "padded": fr.eth(fr.ip4(fr.tcp(b"", 1, 2))) + b"\0" * 6,
    "bad offset": fr.eth(fr.ip4(fr.tcp(b"data", 11, 12, offset=2))) + b"pad",
    "bad udp": fr.eth(fr.ip4(fr.udp(b"data", 13, 14, 7), 17)) + b"pad",
    "icmp": fr.eth(fr.ip4(b"\x08\x01xyz", 1)),
    "short icmp": fr.eth(fr.ip4(b"\x08", 1)),
    "gre": fr.eth(fr.ip4(b"inner", 47)),
    "v6": fr.eth(fr.ip6(fr.tcp(b"six", 443, 50000)), 0x86DD),
    "v6 ext": fr.eth(fr.ip6(b"\x3c\0" + b"\0" * 6 + b"\x11\x01" + b"\0" * 14 + fr.udp(b"e", 1, 2), 0), 0x86DD),
    "v6 beyond": fr.eth(fr.ip6(b"\x06\xff" + b"\0" * 6, 0), 0x86DD),
    "v6 cut": fr.eth(fr.ip6(b"\x00", 43), 0x86DD),
    "icmp6": fr.eth(fr.ip6(b"\x80\x02abc", 58, "::", "::ffff:1.2.3.4"), 0x86DD),
    "dns": fr.eth(fr.ip4(fr.udp(fr.dns("WWW.Example.COM", "b.test", answers=fr.answer(1, b"\1\2\3\4") + fr.answer(5, b"xx") + fr.answer(28, b"\0" * 15 + b"\1"), count=3)), 17)),
    "dns tcp": fr.eth(fr.ip4(fr.tcp(b"\0\x20" + fr.dns("t.example"), 40000, 53))),
    "dns small": fr.eth(fr.ip4(fr.udp(b"\0" * 11), 17)),
    "dns loop": fr.eth(fr.ip4(fr.udp(fr.dns()[:4] + b"\0\1" + b"\0" * 6 + b"\xc0\x0c\0\1\0\1"), 17)),
    "http": fr.eth(fr.ip4(fr.tcp(HTTP, 40000, 8080))),
    "reply": fr.eth(fr.ip4(fr.tcp(REPLY, 80, 40000))),
    "patch": fr.eth(fr.ip4(fr.tcp(b"PATCH / HTTP/1.1\r\n\r\n"))),
    "tls": fr.eth(fr.ip4(fr.tcp(fr.hello(), 40000, 443))),
    "tls bare": fr.eth(fr.ip4(fr.tcp(fr.hello(bare=True), 40000, 443))),
    "tls cut": fr.eth(fr.ip4(fr.tcp(fr.hello()[:-1], 40000, 443))),
    "dhcp": fr.eth(fr.ip4(fr.udp(fr.dhcp(), 68, 67), 17)),
    "dhcp short": fr.eth(fr.ip4(fr.udp(fr.dhcp()[:239], 68, 67), 17)),
    "ftp": fr.eth(fr.ip4(fr.tcp(b"USER  bob \r\nPass s3cret\r\n", 40000, 21))),
    "auth login": fr.eth(fr.ip4(fr.tcp(b"AUTH LOGIN\r\n", 40000, 25))),
    "auth plain": fr.eth(fr.ip4(fr.tcp(b"AUTH PLAIN AGJvYg==\r\n", 40000, 587))),
}


@pytest.fixture(scope="module")
def packets(spark):
    rows = [(k, 0, 0.0, len(f), len(f), 1, bytearray(f)) for k, f in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, decode_schema())
    found = {n: r for n, r in zip(CASES, decode.decoded(df).orderBy("packet_id").collect())}
    assert len(found) == len(CASES)
    return found


def decode_schema():
    from packetlens.schema import RAW

    return RAW


def pick(r, *names):
    return tuple(r[n] for n in names)


def test_link_layer(packets):
    for name, size in (("short", 9), ("cut tag", 1), ("lldp", 3), ("short arp", 20), ("short rarp", 20)):
        assert pick(packets[name], "l4", "payload_len", "is_ipv4", "is_ipv6") == (0, size, False, False), name
    assert (packets["tagged"].l4, packets["tagged"].payload_len) == (6, 11)  # UDP bytes under a TCP number: too short a header
    assert packets["short rarp"].is_arp and not packets["short arp"].is_arp
    a = packets["arp"]
    assert pick(a, "is_arp", "arp_op", "arp_sender_ip", "arp_target_ip", "arp_sender_mac", "payload", "payload_len", "l4") == (True, 2, "10.0.0.1", "10.0.0.2", "aa:bb:cc:dd:ee:ff", None, 0, 0)


def test_network_layer(packets):
    assert pick(packets["plain"], "src_ip", "dst_ip", "src_ip4", "l4", "src_port", "dst_port") == ("10.0.0.1", "8.8.8.8", 10 << 24 | 1, 6, 1234, 9999)
    assert packets["plain"].tcp.asDict() == {"syn": True, "ack": True, "fin": False, "rst": False, "psh": False, "seq": 1, "ack_num": 2}
    assert bytes(packets["options"].payload) == b"o"
    for name in ("bad version", "small total"):
        assert pick(packets[name], "is_ipv4", "l4", "src_ip", "payload_len") == (False, 0, "", len(CASES[name]) - 14)
    assert bytes(packets["gre"].payload) == b"inner" and packets["gre"].l4 == 0
    assert pick(packets["v6"], "is_ipv6", "src_ip", "dst_ip", "l4", "src_port", "src_ip4") == (True, "2001:db8::1", "2001:db8::2", 6, 443, None)
    assert pick(packets["v6 ext"], "l4", "src_port", "dst_port") == (17, 1, 2) and bytes(packets["v6 ext"].payload) == b"e"
    assert pick(packets["v6 beyond"], "l4", "payload_len") == (0, 8) and pick(packets["v6 cut"], "l4", "payload_len") == (0, 1)
    assert pick(packets["icmp6"], "l4", "src_ip", "dst_ip", "icmp_type", "icmp_code") == (58, "::", "::ffff:1.2.3.4", 128, 2)


def test_transport_layer(packets):
    assert packets["padded"].payload_len == 6  # padding counts
    assert pick(packets["bad offset"], "src_port", "dst_port", "payload_len") == (11, 12, 24)  # up to the IP length
    assert pick(packets["bad udp"], "src_port", "payload_len") == (13, 12)
    assert bytes(packets["large total"].payload) != b"" and packets["large total"].payload_len == 3
    assert pick(packets["icmp"], "icmp_type", "icmp_code", "payload_len") == (8, 1, 5)
    assert pick(packets["short icmp"], "payload", "payload_len", "l4") == (None, 0, 1)


def test_dns(packets):
    d = packets["dns"]
    assert pick(d, "is_dns", "dns_qname_lower", "dns_queries", "dns_answers", "dns_query_count", "dns_answer_count") == (True, "www.example.com", ["www.example.com", "b.test"], ["1.2.3.4", "::1"], 2, 3)
    assert packets["dns tcp"].dns_queries == ["t.example"]
    assert not packets["dns small"].is_dns
    assert pick(packets["dns loop"], "is_dns", "dns_queries") == (True, [])
    assert decode.dns_name(b"\x03www\xc0\x00", 0)[1] == 6
    assert decode.dns_name(b"\x05ab", 0) == ("", 0)


def test_http(packets):
    h = packets["http"]
    assert pick(h, "is_http", "http_method", "http_uri", "http_host", "http_user_agent", "http_body_offset", "http_body_len") == (True, "GET", "/a b", "last.example", "u", len(HTTP) - 4, 4)
    assert pick(packets["reply"], "http_status_code", "http_content_type", "http_body_len", "http_method") == (204, "text/css", 20, "")
    assert not packets["patch"].is_http


def test_tls(packets):
    t = packets["tls"]
    assert pick(t, "is_tls", "tls_version", "tls_sni", "tls_alpn", "tls_cipher_suites") == (True, 771, "www.example.com", ["h2", "http/1.1"], [0x1301, 0xC02F])
    assert t.tls_ja3 == hashlib.md5(b"771,4865-49199,0-10-11-16,29-23,0").hexdigest()
    assert pick(packets["tls bare"], "is_tls", "tls_ja3") == (True, "")
    assert not packets["tls cut"].is_tls


def test_dhcp_and_credentials(packets):
    assert pick(packets["dhcp"], "is_dhcp", "dhcp_op", "dhcp_hostname", "dhcp_client_ip", "dhcp_your_ip", "dhcp_client_mac") == (True, 1, "box", "10.0.0.9", "10.0.0.10", "aa:bb:cc:dd:ee:ff")
    assert not packets["dhcp short"].is_dhcp
    assert pick(packets["ftp"], "cred_username", "cred_password", "cred_protocol") == ("bob", "s3cret", "ftp")
    assert pick(packets["auth login"], "cred_username", "cred_password", "cred_protocol") == ("", "", "smtp_auth_login")
    assert pick(packets["auth plain"], "cred_password", "cred_protocol") == ("", "smtp")


def test_random_frames_never_fail(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        f = bytearray(rng.choice(list(CASES.values())))
        for _ in range(rng.randint(0, 6)):
            if f:
                f[rng.randrange(len(f))] = rng.randrange(256)
        f = f[: rng.randint(0, len(f))]
        rows.append((k, 0, 0.0, len(f), len(f), 1, f))
    df = decode.decoded(spark.createDataFrame(rows, decode_schema()))
    assert df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.drop("payload").columns))))).first()[0] == 400


def test_filters(spark):
    rows = [(k, 0, 0.0, len(f), len(f), 1, bytearray(f)) for k, f in enumerate(CASES.values())]
    raw = spark.createDataFrame(rows, decode_schema())
    names = list(CASES)
    got = lambda e: {names[r.packet_id] for r in where(raw, e).select("packet_id").collect()}
    assert got("arp") == {"arp", "short arp"} and got("rarp") == {"short rarp"}
    assert got("tcp port 443") == {"v6", "tls", "tls bare", "tls cut"}
    assert got("udp and dst port 67") == {"dhcp", "dhcp short"}
    assert got("ip6 and host 2001:db8::1 and not tcp") == {"v6 ext", "v6 beyond", "v6 cut"}
    assert got("vlan 1") == {"tagged"} and got("less 13") == {"short"}
    assert got("ether proto 0x88cc or icmp6") == {"lldp", "icmp6"}
    assert got("tcp[tcpflags] & (tcp-syn|tcp-ack) == tcp-syn|tcp-ack") == {"plain"}
    assert got("tcp[13] & 2 != 0") == {"plain"} and got("ip[0] & 0xf > 5") == {"options"}
    assert got("icmp[icmptype] = icmp-echo") == {"icmp", "short icmp"} and got("icmp6[0] == icmp6-echo") == {"icmp6"}
    assert got("ether[12:2] = 0x88cc") == {"lldp"} == got("ether proto 35020") and got("len <= 9") == {"short"} == got("len * 2 < 20")
    assert got("udp port domain") == {"dns", "dns small", "dns loop"} and got("tcp port ftp or smtp") == {"ftp", "auth login"}
    assert got("tcp dst port (ftp or 25)") == {"ftp", "auth login"} and got("src and dst port 1") == set()
    assert got("ip proto 47") == {"gre"} == got("proto gre") and got("ip6 proto \\icmp6") == {"icmp6"} == got("icmp6")
    assert got("ip6 net 2001:db8::/33 and udp") == set() and got("ip6 net ::fffe:0:0/95") == {"icmp6"} == got("dst host ::ffff:1.2.3.4")
    everyone = {n for n, f in CASES.items() if len(f) >= 12}
    assert got("ether src 06:07:08:09:0a:0b") == everyone == got("ether host 0:1:2:3:4:5") and got("ether broadcast") == set()
    assert got("arp host 10.0.0.1 or arp net 10.1") == got("arp src 10.0.0.1 or arp dst 10.0.0.1")
    # and, or bind alike: (lldp or short rarp) and nothing of them is arp
    assert got("ether proto 0x88cc or rarp and not rarp") == {"lldp"} and got("rarp or (ether proto 0x88cc and not rarp)") == {"lldp", "short rarp"}
    assert got("vlan and vlan 2 and tcp port 6") == {"tagged"} and got("vlan 1 and udp") == set() and got("vlan 2") == set()
    assert got("") == set(CASES) and got("portrange 66-67") == {"dhcp", "dhcp short"} and got("net 10.0.0.0 mask 255.255.255.0 and tcp port 9999") == {"plain"}
    for bad in ("port", "tcp port 99999", "host nowhere", "(tcp", "tcp tcp", "frob 3", "tcp[13] & 2", "tcp[1:3] = 0", "ether host 1.2.3.4", "net 1.2.3.4/8", "portrange 5", "arp port 5"):
        with pytest.raises(FilterError):
            where(raw, bad)


def test_any_number_of_tags(spark):
    f = fr.eth(fr.ip4(fr.udp(b"deep", 5, 6), 17), tags=tuple(range(40)))
    raw = spark.createDataFrame([(0, 0, 0.0, len(f), len(f), 1, bytearray(f)), (1, 0, 0.0, len(f) - 40, len(f), 1, bytearray(f[:-40]))], decode_schema())
    rows = decode.decoded(raw).orderBy("packet_id").collect()
    assert pick(rows[0], "is_ipv4", "src_port", "payload_len") == (True, 5, 4) and not rows[1].is_ipv4


def test_switches(spark):
    plain = fr.eth(fr.ip4(fr.tcp(b"AUTH PLAIN AGJvYg==\r\n", 40000, 587)))
    over_tcp = fr.eth(fr.ip4(fr.tcp(b"\0\x20" + fr.dns("t.example"), 40000, 53)))
    raw = spark.createDataFrame([(k, 0, 0.0, len(f), len(f), 1, bytearray(f)) for k, f in enumerate((plain, over_tcp))], decode_schema())
    rows = decode.decoded(raw, late_dns_tcp=True, auth_plain=True, keep_data=True).orderBy("packet_id").collect()
    assert pick(rows[0], "cred_password", "cred_protocol") == ("AGJvYg==", "smtp_auth_plain") and bytes(rows[0].data) == plain
    assert rows[1].is_dns and rows[1].dns_queries != ["t.example"]


def test_legacy_profile(spark):
    rows = [(k, 0, 0.0, len(f), len(f), 1, bytearray(f)) for k, f in enumerate(CASES.values())]
    found = dict(zip(CASES, decode.legacy(spark.createDataFrame(rows, decode_schema())).orderBy("packet_id").collect()))
    assert all(len(CASES[n]) >= r.payload_off + r.payload_len for n, r in found.items())
    assert pick(found["padded"], "payload_len", "l4") == (0, 6)  # the IP length bounds it
    assert pick(found["small total"], "is_ipv4", "src_ip", "l4", "payload_len") == (True, "0.0.0.0", 0, len(CASES["small total"]) - 14)
    assert pick(found["bad version"], "is_ipv4", "l4") == (False, 0)
    assert pick(found["tagged"], "l4", "payload_len") == (0, 11)
    assert pick(found["bad offset"], "src_port", "payload_len") == (11, 24) and pick(found["bad udp"], "payload_len", "l4") == (4, 17)
    assert pick(found["v6"], "is_ipv4", "l4", "payload_len") == (False, 0, len(CASES["v6"]) - 14)
    assert found["dns"].dns_qname_lower == "www.example.com" and found["dns tcp"].dns_qname_lower == "" and found["dns loop"].dns_qname_lower == ""
    assert pick(found["short icmp"], "l4", "payload_len") == (1, 1) and found["arp"].payload_len == 28
