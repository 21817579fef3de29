import json
import random

import frames as fr
import pytest
from pyspark.sql import functions as F

from packetlens.config import ScanConfig
from packetlens.functions import columns as c
from packetlens.operators import aggregate, detect, fold, logs, match, views
from packetlens.plans.scan import Scan, scan_files
from packetlens.sources import results

T0 = 1_700_000_000_000_000


def scalar(spark, value, *exprs, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*(e.alias(f"e{k}") for k, e in enumerate(exprs))).first())


# --- scalars


@pytest.mark.parametrize("text, ip", [("192.168.1.1", 0xC0A80101), ("0.0.0.0", 0), ("255.255.255.255", 2**32 - 1), ("256.1.1.1", None), ("1.2.3", None), ("01.2.3.4", None), ("not.an.ip.address", None), ("", None), ("1.2.3.4\n", None)])
def test_parse_ip4(spark, text, ip):
    assert scalar(spark, text, c.parse_ip4("x")) == (ip,)


def test_text_functions(spark):
    assert scalar(spark, " \t a b\r\n", c.trim_blank("x"), c.ascii_lower("x"), c.starts_with("x", "")) == ("a b", " \t a b\r\n", True)
    assert scalar(spark, "ÉABc", c.ascii_lower("x")) == ("Éabc",)
    assert scalar(spark, 'a"b\\c\n\t', c.json_escape("x")) == ('a\\"b\\\\c\\n\\t',)
    assert [scalar(spark, s, c.redact("x"))[0] for s in ("", "abc", "abcd", "abcde", "password1")] == ["", "***", "****", "ab*de", "pa*****d1"]
    assert scalar(spark, "abcd", F.round(c.entropy("x"), 9)) == (2.0,) and scalar(spark, "", c.entropy("x")) == (0.0,) and scalar(spark, "aaaa", c.entropy("x")) == (0.0,)
    assert scalar(spark, 443, c.bucket("x"), kind="long") == (797,)
    assert scalar(spark, 0, c.iso8601("x"), kind="long") == ("1970-01-01T00:00:00Z",) and scalar(spark, 1704067200_500000, c.iso8601("x"), kind="long") == ("2024-01-01T00:00:00Z",)
    assert scalar(spark, bytearray(b"\0\1ab cd\xffxyz\x80  longer \r\n\0"), c.extract_strings("x"), c.hex_preview("x", 3), kind="binary") == (["ab cd", "longer"], "000161")
    assert scalar(spark, bytearray(b"\xaa\xbb\x0c"), c.mac_text("x"), kind="binary") == ("aa:bb:0c",)


@pytest.mark.parametrize("ip", ["::", "::1", "2001:db8::1", "2001:db8:0:1:0:0:0:1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "fe80::1:0:0:1", "::ffff:1.2.3.4", "::1.2.3.4", "1:0:0:2::", "0:1:2:3:4:5:6:7"])
def test_ip6_text(spark, ip):
    import socket

    raw = socket.inet_pton(socket.AF_INET6, ip)
    assert scalar(spark, bytearray(raw), c.ip6_text("x"), kind="binary") == (socket.inet_ntop(socket.AF_INET6, raw),)


def test_private_addresses(spark):
    def private(ip):
        return scalar(spark, ip, c.is_private(c.parse_ip4("x")))[0]

    assert all(map(private, ("10.0.0.0", "10.255.255.255", "172.16.0.1", "172.31.255.255", "192.168.0.1", "127.0.0.1")))
    assert not any(map(private, ("9.255.255.255", "11.0.0.0", "172.15.255.255", "172.32.0.0", "192.169.0.0", "8.8.8.8", "x")))


def test_file_extension(spark):
    ext = lambda kind, body: spark.createDataFrame([(kind, bytearray(body))], "k string, b binary").select(c.file_extension("k", "b")).first()[0]
    assert [ext("image/jpeg; x", b"none"), ext("x/y", b"%PDF-1"), ext("text/html", b"\x89PNG"), ext("a", b"MZ.."), ext("a", b"\x7fELF"), ext("a", b"GIF8"), ext("a", b"PK\x03\x04"), ext("a", b"MZ")] == [".jpg", ".pdf", ".png", ".exe", ".elf", ".gif", ".zip", ".bin"]


# --- indicator lists


def test_lists(spark, tmp_path):
    (tmp_path / "ips").write_text("# all\n\n 10.0.0.1 \n172.16.99.9/16\n")
    (tmp_path / "names").write_text("Malware.Example.COM.\nevil.org\n#x\n")
    (tmp_path / "words").write_text("abc\n..\\..\\\nabc\n")
    ioc = match.loaded(spark, *(str(tmp_path / x) for x in ("ips", "names", "words")))
    assert {tuple(r) for r in ioc.networks.collect()} == {(32, 10 << 24 | 1), (16, 172 << 8 | 16)}
    assert {r.domain for r in ioc.domains.collect()} == {"malware.example.com", "evil.org"}
    assert ioc.keywords == ("abc", "..\\..\\", "abc")
    (tmp_path / "bad").write_text("2001:db8::1\n")
    with pytest.raises(Exception, match="not an IPv4 address"):
        match.loaded(spark, str(tmp_path / "bad")).networks.collect()


def test_networks_and_domains(spark):
    ioc = match.of_lists(spark, ("10.0.0.1", "192.168.1.100", "172.16.0.0/16", "0.0.0.0/1"), ("malware.example.com", "evil.org"))
    ips = ["10.0.0.1", "200.0.0.2", "172.16.255.255", "172.17.0.1", "192.168.1.100", "8.8.8.8"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", c.parse_ip4("ip").alias("src_ip4"))
    assert {r.ip for r in match.blocked(df, ioc.networks, "src").where("blocked_src").collect()} == {"10.0.0.1", "172.16.255.255", "192.168.1.100", "8.8.8.8"}
    names = ["malware.example.com", "foo.malware.example.com", "example.com", "notevil.org", "sub.evil.org", "EVIL.ORG", "evil.org:80", "org", ""]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    assert {r.name for r in match.listed_domains(df, ioc.domains, "k").collect()} == {"malware.example.com", "foo.malware.example.com", "sub.evil.org"}


@pytest.mark.parametrize("words, text, found", [
    (("hello",), "say hello world", "hello"), (("password", "secret", "api_key"), "user&password=1&api_key=x", "password"), (("ab", "abc", "bc"), "xabc", "ab"),
    (("bc", "abc"), "abc", "abc"), (("abc", "abc"), "abc", "abc"), (("zz",), "abc", None), ((), "abc", None), (("cmd.exe",), "GET /cmd.exe?", "cmd.exe"), (("ABC",), "abc", None),
])
def test_keywords(spark, words, text, found):
    assert scalar(spark, bytearray(text.encode()), match.keyword(F.col("x"), words, 512), kind="binary") == (found,)


def test_many_keywords_in_one_pass(spark):
    rng = random.Random(4)
    words = tuple(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(400))) + ("é", "ab")
    assert len(words) > match.FEW_WORDS
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))).encode() for _ in range(100)] + [b"", "xé".encode(), None]
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts)], "k int, x binary")
    got = df.select("k", match.keyword(F.col("x"), words, 20).alias("w"), match.keyword_matches(F.col("x"), words, 20).alias("m")).orderBy("k").collect()
    for r, t in zip(got, texts):
        if t is None:
            assert r.w is None and r.m is None
            continue
        t = t[:20]
        found = {(k, e) for k, w in enumerate(words[:-1]) for e in range(len(t) + 1) if t[:e].endswith(w.encode())}
        assert {(x.id, x.stop) for x in r.m} == found and [x.stop for x in r.m] == sorted(x.stop for x in r.m)
        assert r.w == (words[min(found, key=lambda x: (x[1], -len(words[x[0]].encode()), x[0]))[0]] if found else None)


@pytest.mark.parametrize("words, text, most, found", [
    (("hello",), "say hello world", None, [(0, 9)]), (("password", "secret", "api_key"), "user=admin&password=123&api_key=xyz", None, [(0, 19), (2, 31)]),
    (("ab", "abc", "bc"), "abc", None, [(0, 2), (1, 3), (2, 3)]), (("a",), "aaaaaaaaaa", 3, [(0, 1), (0, 2), (0, 3)]), (("a",), "", None, []), ((), "abc", None, []),
])
def test_keyword_matches(spark, words, text, most, found):
    got = scalar(spark, bytearray(text.encode()), match.keyword_matches(F.col("x"), words, most=most), kind="binary")[0]
    assert [(x.id, x.stop) for x in got] == found


def test_keyword_limit(spark):
    x = bytearray(b"-" * 509 + b"abc" + b"d")
    assert scalar(spark, x, match.keyword(F.col("x"), ("abc",), 512), match.keyword(F.col("x"), ("abcd",), 512), match.keyword(F.col("x"), ("abc",), 0), kind="binary") == ("abc", None, None)


# --- folds and detectors


def probes(spark, rows):
    """(ts in seconds, source, port) as packets."""
    from packetlens.plans.adapter import completed

    df = spark.createDataFrame([(k, int(t * 1e6), s, 8 << 24, p) for k, (t, s, p) in enumerate(rows)], "packet_id long, ts_us long, src_ip4 long, dst_ip4 long, dst_port int")
    return completed(df.withColumns({"l4": F.lit(6), "src_port": F.lit(1), "payload_len": F.lit(0), "raw_len": F.lit(54)}))


def slow_port_scan(rows, seconds, threshold):
    state, out = {}, []
    for k, (t, s, p) in enumerate(rows):
        if not p:
            continue
        v = p ^ p >> 7
        v = v * 0x9E3779B1 & 0xFFFFFFFF
        v = (v ^ v >> 11) & 2047
        if s not in state or int(t) >= state[s][0] + seconds:
            state[s] = (int(t), set())
        state[s][1].add(v)
        if len(state[s][1]) == threshold:
            out.append(k)
    return out


def test_port_scan(spark):
    rng = random.Random(1)
    rows, t = [], 100.0
    for _ in range(1500):
        t += rng.choice([0, 0.1, 0.5, 3, -2])
        rows.append((t, rng.randint(1, 3), rng.randint(0, 40)))
    cfg = ScanConfig(portscan_threshold=8, portscan_window_seconds=10)
    got = [r.packet_id for r in detect.port_scan(probes(spark, rows), cfg).orderBy("packet_id").collect()]
    assert got == slow_port_scan(rows, 10, 8) and got


def test_port_scan_edges(spark):
    cfg = ScanConfig(portscan_threshold=3, portscan_window_seconds=10)
    rows = [(0, 1, 1), (9.9, 1, 2), (10.0, 1, 3), (11, 1, 4), (12, 1, 5), (13, 1, 5), (14, 1, 6)]
    assert slow_port_scan(rows, 10, 3) == [4, 5] == [r.packet_id for r in detect.port_scan(probes(spark, rows), cfg).orderBy("packet_id").collect()]
    once = ScanConfig(portscan_threshold=3, portscan_window_seconds=10, portscan_once=True)
    assert [r.packet_id for r in detect.port_scan(probes(spark, rows), once).collect()] == [4]
    assert [tuple(r) for r in detect.port_scan_suspects(probes(spark, rows), cfg).collect()] == [("0.0.0.1", 4)]


def slow_beacons(rows, least, tolerance):
    times, out = {}, []
    for k, (t, s, p) in enumerate(rows):
        q = times.setdefault((s, p), [])
        q.append(t)
        del q[:-100]
        if len(q) < least:
            continue
        gaps = [b - a for a, b in zip(q, q[1:])]
        mean = sum(gaps) / len(gaps)
        sd = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
        if mean > 1.0 and sd < tolerance * mean:
            out.append((k, len(q)))
            q.clear()
    return out


@pytest.mark.parametrize("bits", [12, 3])
def test_port_scans_over_parts(spark, monkeypatch, bits):
    """Windows that span parts, time that runs backwards, and a source that holds nearly all packets."""
    monkeypatch.setattr(fold, "PART_BITS", bits)
    rng = random.Random(bits)
    rows, t = [], 1000.0
    for _ in range(1500):
        t += rng.choice([0, 0.2, 0.5, 3, 11, -4])
        rows.append((max(0.0, t), 1 if rng.random() < 0.9 else rng.randint(2, 5), rng.choice([1, 2, 3, 4, 5, 80, 443, rng.randint(1, 9999)])))
    cfg = ScanConfig(portscan_threshold=4, portscan_window_seconds=10)
    assert [r.packet_id for r in detect.port_scan(probes(spark, rows), cfg).orderBy("packet_id").collect()] == slow_port_scan(rows, 10, 4)


def test_a_busy_source_is_folded_by_seconds(spark):
    """One source sends all packets: the fold, the only step in which they could meet, reads parts of first seconds."""
    rows = [(k // 400, 1, k % 3000 + 1) for k in range(20_000)]
    df = probes(spark, rows).select("src_ip4", "packet_id", F.floor("ts").cast("long").alias("tsec"), c.bucket("dst_port").alias("bucket"))
    read = []
    real = type(df).mapInArrow

    def counted(self, *args, **options):
        read.append(self.agg(F.count("*"), F.sum(F.size("firsts"))).first())
        return real(self, *args, **options)

    type(df).mapInArrow, kept = counted, real
    try:
        fold.windowed(df, "src_ip4", 10).count()
    finally:
        type(df).mapInArrow = kept
    assert [tuple(r) for r in read] == [(5, 54)]  # 50 seconds in five parts, four of them cut


@pytest.mark.parametrize("least, tolerance", [(10, 0.1), (3, 0.5), (40, 0.9)])
def test_beacons_of_long_keys(spark, least, tolerance):
    rng = random.Random(least)
    rows, t = [], 0.0
    for k in range(6000):
        t += rng.choice([0.5, 0.1, 1.2]) if k % 2000 < 700 else 2 + rng.random() * (0.01, 1, 4)[k // 150 % 3]
        rows.append((t, 10 << 24 | int(rng.random() < 0.03), 80))
    got = fold.beacons(probes(spark, rows).select("src_ip4", "dst_port", "packet_id", "ts"), ["src_ip4", "dst_port"], least, tolerance)
    want = slow_beacons(rows, least, tolerance)
    assert [(r.packet_id, r.sample_count) for r in got.orderBy("packet_id").collect()] == want and len(want) > 5


def test_beacons(spark):
    rng = random.Random(2)
    rows, t = [], 0.0
    for k in range(900):
        t += 2 + rng.random() * (0.1 if k % 300 < 150 else 5)
        rows.append((t, 10 << 24 | k % 2, 80))
    got = fold.beacons(probes(spark, rows).select("src_ip4", "dst_port", "packet_id", "ts"), ["src_ip4", "dst_port"], 10, 0.1)
    assert [(r.packet_id, r.sample_count) for r in got.orderBy("packet_id").collect()] == slow_beacons(rows, 10, 0.1)
    steady = [(float(k), 10 << 24, 80) for k in range(20)]  # a mean of exactly one second is not above it
    assert detect.beaconing(probes(spark, steady), ScanConfig()).count() == 0
    assert detect.beaconing(probes(spark, [(1.5 * t, s, p) for t, s, p in steady]), ScanConfig()).count() == 2


def test_exfiltration(spark):
    rows = [(float(k), 10 << 24, 80) for k in range(30)]
    sent = probes(spark, rows).withColumn("payload_len", F.lit(100)).withColumn("dst_ip4", (F.lit(8 << 24) + F.col("packet_id") % 2).cast("long")).withColumn("packet_id", F.col("packet_id") * 3000)
    got = detect.exfiltration(sent, ScanConfig(exfil_bytes_threshold=1000)).orderBy("packet_id").collect()
    assert [(r.packet_id, r.bytes_sent) for r in got] == [(54000, 1000), (57000, 1000)]
    assert detect.exfiltration(sent, ScanConfig(exfil_bytes_threshold=1501)).count() == 0


def test_dns_tunnel(spark):
    names = ["a" * 25 + "bcdefghijklmnopqrstuvwxyz" + ".x.com", "a" * 60 + ".x.com", "abcdefghijklmnopqrstuvwxyz012345678901234567890123", ".x", "bcdefghijklmnopqrstuvwxyz012345" * 2 + ".y"]
    df = probes(spark, [(k, 1, 53) for k in range(len(names))])
    df = df.withColumn("dns_qname_lower", F.element_at(F.array(*map(F.lit, names)), (F.col("packet_id") + 1).cast("int")))
    assert [(r.packet_id, r.subdomain_len) for r in detect.dns_tunnel(df, ScanConfig()).orderBy("packet_id").collect()] == [(4, 62)]


# --- aggregation


def test_sketches_hold_their_bounds(spark):
    rng = random.Random(3)
    rows = [(f"k{int(rng.paretovariate(0.7))}", rng.randint(1, 5)) for _ in range(4000)]
    true = {}
    for k, n in rows:
        true[k] = true.get(k, 0) + n
    df = spark.createDataFrame(rows, "key string, n int").repartition(5)
    for capacity in (1, 20, 5000):
        parts = aggregate.sketched(df, "key", F.col("n"), capacity)
        assert parts.where("key is not null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= capacity
        got = {r.key: (r["count"], r.error) for r in aggregate.merged_sketches(parts).collect()}
        assert all(n - e <= true[k] <= n for k, (n, e) in got.items())
        floors = parts.where("key is null").agg(F.sum("floor")).first()[0]
        assert all(true[k] <= floors for k in true if k not in got)
        if capacity == 5000:
            assert got == {k: (n, 0) for k, n in true.items()}
    top = aggregate.merged_sketches(aggregate.sketched(df, "key", F.col("n"), 200), 5)
    assert [r.key for r in top.collect()] == sorted(true, key=lambda k: (-true[k], k))[:5]
    assert aggregate.pruned(top, 2).count() == 2
    assert aggregate.merged_sketches(aggregate.sketched(df.limit(0), "key", F.col("n"), 5)).count() == 0


def test_space_saving():
    top = aggregate.space_saving([(1, 100), (2, 200), (3, 50)], 3)
    assert top[0][:2] == (2, 200)
    assert aggregate.space_saving([(1, 100), (1, 50), (1, 25)], 5) == [(1, 175, 0)]
    assert len(aggregate.space_saving([(k, 1) for k in range(5)], 3)) == 3
    assert aggregate.space_saving([(1, 1)], 0) == []
    assert aggregate.space_saving([("a", 5), ("b", 3), ("c", 4)], 2) == [("c", 7, 3), ("a", 5, 0)]


def test_settings():
    for bad in ({"top_k": 0}, {"payload_max": -1}, {"portscan_threshold": 0}, {"portscan_window_seconds": 0}, {"max_alerts": -1}, {"profile": "x"}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            ScanConfig.of(**bad)


# --- a whole scan


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    f, t = [], 0
    http = b"GET /x?token=1 HTTP/1.1\r\nHost: www.evil.org\r\n\r\n"
    reply = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + b"\xff\xd8\xff" + b"q" * 30
    f += [fr.eth(fr.ip4(fr.tcp(http))), fr.eth(fr.ip4(fr.tcp(reply, 80, 40000), src="8.8.8.8", dst="10.0.0.1"))]
    f += [fr.eth(fr.ip4(fr.udp(fr.dns("a.evil.org"), 40001), 17)), fr.eth(fr.ip4(fr.tcp(fr.hello("sni.test"), 40002, 443)))]
    f += [fr.eth(fr.arp(), 0x0806), fr.eth(fr.ip6(fr.udp(b"plain text", 1, 2), 17), 0x86DD), fr.eth(fr.ip4(b"\x08\0ping data", 1))]
    f += [fr.eth(fr.ip4(fr.tcp(b"USER admin\r\nPASS hunter22\r\n", 40003, 21), src="10.0.0.7"))]
    f += [fr.eth(fr.ip4(fr.tcp(b"", 5000, p, 2), src="10.0.0.9")) for p in range(1, 80)]
    p = tmp_path_factory.mktemp("capture") / "all.pcap"
    p.write_bytes(fr.pcap([(T0 + 1000 * k, x) for k, x in enumerate(f)]))
    return p, len(f)


def settings(**given):
    return ScanConfig.of(enable_carving=True, **given)


def test_scan(spark, capture, tmp_path):
    path, n = capture
    ioc = match.of_lists(spark, ("8.8.8.8",), ("evil.org",), ("ping",))
    scan = scan_files(spark, str(path), ioc, settings(), land=str(tmp_path / "packets"))
    out = tmp_path / "out"
    results.write(scan, str(out), single=True)
    s = results.read_summary(out / "summary.json")
    assert {k: s[k] for k in ("packets", "ipv4", "ipv6", "arp", "other", "udp", "icmp", "dns_queries", "http_requests", "tls_handshakes", "credentials_found", "files_carved", "world_size")} == {
        "packets": n, "ipv4": n - 2, "ipv6": 1, "arp": 1, "other": 1, "udp": 2, "icmp": 1, "dns_queries": 1, "http_requests": 1, "tls_handshakes": 1, "credentials_found": 1, "files_carved": 1, "world_size": 1}
    assert s["top_tls_sni"] == [{"key": "sni.test", "count": 1}] and s["portscan_suspects"] == [{"ip": "10.0.0.9", "count": 78}]
    assert s["carved_files"][0]["filename"].endswith(".jpg") and (out / "files" / s["carved_files"][0]["filename"]).read_bytes().startswith(b"\xff\xd8\xff")
    lines = [json.loads(x) for x in (out / "alerts.ndjson").read_text().splitlines()]
    kinds = [x["type"] for x in lines]
    assert s["alerts_total"] == len(lines) and kinds.count("blocklisted_domain") == 2 and kinds.count("port_scan") >= 1 and kinds.count("keyword_match") == 1 and kinds.count("sensitive_data") == 2
    assert lines[0]["detail"] == "Matched IP blocklist (dst: 8.8.8.8)" and list(lines[0])[:3] == ["ts", "time", "type"]
    assert next(x for x in lines if "credentials" in x["detail"])["detail"] == "Plaintext credentials detected (ftp) user: ad*in"
    flows = (out / "flows.csv").read_text().splitlines()
    assert flows[0].startswith("src_ip,dst_ip,src_port") and len(flows) == 1 + scan.flows.count()
    assert flows[1].startswith("10.0.0.1,8.8.8.8,40000,80,TCP,1,") and flows[1].endswith(",HTTP") and ",1700000000.000000," in flows[1]
    assert json.loads((out / "dns.jsonl").read_text())["queries"] == ["a.evil.org"]
    assert [json.loads(x)["proto"] for x in (out / "payload.jsonl").read_text().splitlines()] == ["UDP", "ICMP", "TCP"]
    assert results.read_alerts(spark, str(out / "alerts.ndjson")).count() == len(lines)
    assert results.read_flows(spark, str(out / "flows.csv")).count() == len(flows) - 1
    assert results.read_log(spark, str(out / "http.jsonl")).count() == 2
    (out / "alerts.ndjson").open("a").write("not json\n")
    assert results.read_alerts(spark, str(out / "alerts.ndjson")).count() == len(lines)
    results.write(Scan(scan.packets, ioc, settings(max_alerts=2)), str(tmp_path / "few"), single=True)
    assert len((tmp_path / "few/alerts.ndjson").read_text().splitlines()) == 2 and results.read_summary(tmp_path / "few/summary.json")["alerts_total"] == len(lines)


def test_scan_does_not_depend_on_dealing(spark, capture):
    path, _ = capture
    ioc = match.of_lists(spark, ("8.8.8.8",), ("evil.org",), ("ping",))
    one, many = (scan_files(spark, str(path), ioc, settings(), splitBytes=x) for x in ("100000000", "300"))
    rows = lambda s: sorted(map(str, s.alerts.collect()))
    assert rows(one) == rows(many)
    assert sorted(map(str, one.flows.collect())) == sorted(map(str, many.flows.collect()))


def test_legacy_profile(spark, capture):
    path, _ = capture
    scan = scan_files(spark, str(path), match.of_lists(spark, ("0.0.0.0",), ("evil.org",), ("ping",)), settings(profile="legacy"))
    kinds = [(r.type, r.proto) for r in scan.written_alerts.collect()]
    assert ("blocklisted_ip", "OTHER") in kinds and ("keyword_match", "ICMP") in kinds and ("port_scan_suspected", "TCP") in kinds and ("blocklisted_domain", "UDP") in kinds


def test_filtered_scan(spark, capture):
    path, _ = capture
    assert scan_files(spark, str(path), bpf="udp and ip").packets.count() == 1


def test_empty_scan(spark, tmp_path):
    p = tmp_path / "none.pcap"
    p.write_bytes(fr.pcap([]))
    results.write(scan_files(spark, str(p), cfg=settings()), str(tmp_path / "out"), single=True)
    s = results.read_summary(tmp_path / "out/summary.json")
    assert s["packets"] == s["bytes"] == s["alerts_total"] == 0 and s["top_src_bytes"] == [] and "carved_files" not in s
    assert (tmp_path / "out/alerts.ndjson").read_text() == "" and (tmp_path / "out/flows.csv").read_text().count("\n") == 1
    assert not (tmp_path / "out/dns.jsonl").exists()


def test_views(spark, capture):
    path, _ = capture
    scan = scan_files(spark, str(path), match.of_lists(spark, ("8.8.8.8",)), settings())
    hosts = {r.ip: r.role for r in views.hosts(scan.top("src"), scan.top("dst")).collect()}
    assert hosts["10.0.0.9"] == "Client" and hosts["8.8.8.8"] == "Server"
    assert views.sessions(scan.flows, "icmp").count() == 1 and views.payloads(scan.logs()["payload"], "UDP", "PLAIN").count() == 1
    assert views.alerts(scan.alerts, "blocklisted_ip", severity="critical", rows=3).count() == 3
    assert "body" not in views.files(scan.carved).columns and views.credentials(scan.credentials).first().credential == "ad*in:hu****22"
    assert len(views.summary_cards(scan.summary, 1).first().top_src_bytes) == 1
    assert views.names(scan.top("http"), "EVIL").count() == 1 and views.log_head(logs.dns(scan.packets)).count() == 1


def test_command_line(capture, tmp_path):
    from packetlens import cli

    path, n = capture
    for wrong in (["--pcap", str(path)], ["--nonsense"], ["--pcap", "a", "--out", "b", "--top-k", "x"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2
    assert cli.main(["--pcap", str(path), "--out", str(tmp_path), "--top-k", "0"]) == 2
    assert cli.main(["--pcap", str(path), "--out", str(tmp_path / "o"), "--enable-carving", "--progress", str(tmp_path / "p.json")]) == 0
    told = json.loads((tmp_path / "p.json").read_text())
    assert list(told) == ["packets_processed", "bytes_processed", "time_elapsed", "rank", "world_size", "percentage"] and told["packets_processed"] == n and told["percentage"] == 100.0
    assert (tmp_path / "o/summary.json").exists() and (tmp_path / "o/alerts.ndjson").is_dir()
