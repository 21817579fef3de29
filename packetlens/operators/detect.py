"""Detectors: each takes packets and returns alerts; ``alerts`` is their union in packet and check order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.config import ScanConfig
from packetlens.functions import columns as c
from packetlens.operators import fold, match
from packetlens.operators.decode import settled
from packetlens.schema import ALERTS, names

#: Order in which a packet's checks report.
ORDER = {"ip": 1, "domain": 2, "keyword": 3, "portscan": 4, "dns_tunnel": 5, "beaconing": 6, "exfil": 7, "credential": 8, "pattern": 9}
#: Payload patterns and what they are called, in the order of search (fixed values).
PATTERNS = (
    ("authorization: basic", "Basic auth header"), ("authorization: bearer", "Bearer token"), ("api_key=", "API key"), ("apikey=", "API key"),
    ("password=", "Password in URL"), ("passwd=", "Password in URL"), ("secret=", "Secret in URL"), ("token=", "Token in URL"),
    ("set-cookie:", "Cookie being set"),
)


def _alert(check: str, kind: str, detail: Column | str, proto: Column, **extra: Column) -> Column:
    """An alert of the packet at hand as a struct."""
    columns = {x.split()[0]: x.split()[1] for x in ALERTS.split(", ")}
    made = {
        "check_ord": F.lit(ORDER[check]), "time": c.iso8601("ts_us"), "type": F.lit(kind), "proto": proto,
        "detail": F.lit(detail) if isinstance(detail, str) else detail, **extra,
    }
    value = lambda k: made[k] if k in made else F.col(k) if k in ("packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port") else F.lit(None)
    return F.struct(*(value(k).cast(t).alias(k) for k, t in columns.items()))


def _alerts(df: DataFrame, check: str, kind: str, detail: Column | str, proto: Column, **extra: Column) -> DataFrame:
    return df.select(_alert(check, kind, detail, proto, **extra).alias("x")).select("x.*")


def blocklisted_ip(packets: DataFrame, nets: DataFrame) -> DataFrame:
    hit = match.blocked(packets.where("is_ipv4"), nets, "src", "dst").where("blocked_src or blocked_dst")
    part = lambda side: F.when(F.col(f"blocked_{side}"), F.concat(F.lit(f" ({side}: "), f"{side}_ip", F.lit(")"))).otherwise("")
    return _alerts(hit, "ip", "blocklisted_ip", F.concat(F.lit("Matched IP blocklist"), part("src"), part("dst")), c.alert_proto())


def blocklisted_domain(packets: DataFrame, listed: DataFrame) -> DataFrame:
    """The first of DNS name, HTTP host and TLS server name that is listed."""
    names_ = F.array("dns_qname_lower", c.ascii_lower("http_host"), c.ascii_lower("tls_sni"))
    keep = ["packet_id", "ts_us", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "l4"]
    each = packets.select(*keep, F.posexplode(names_).alias("place", "name")).where("name <> ''")
    hits = match.listed_domains(each, listed, "packet_id")
    first = hits.groupBy(*keep).agg(F.min_by("name", "place").alias("name"))
    return _alerts(first, "domain", "blocklisted_domain", F.concat(F.lit("Matched domain blocklist: "), "name"), c.alert_proto())


def keyword_match(packets: DataFrame, words: tuple[str, ...], cfg: ScanConfig) -> DataFrame:
    return stateless(packets, words, cfg, ("keyword",))


#: Packet columns that an alert is made of.
SEEN = ("packet_id", "ts_us", "ts", "src_ip", "dst_ip", "src_ip4", "dst_ip4", "src_port", "dst_port", "l4")


def probes(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Packets to a port, with what alerts need, the port's bucket in the sketch, and the window of their source."""
    to_port = packets.where(F.col("is_ipv4") & F.col("l4").isin(c.TCP, c.UDP) & (F.col("dst_port") != 0))
    slim = to_port.select(*SEEN, F.floor("ts").cast("long").alias("tsec"), c.bucket("dst_port").alias("bucket"))
    return fold.windowed(slim, "src_ip4", cfg.portscan_window_seconds)


def _sketches(seen: DataFrame) -> DataFrame:
    """(src_ip4, window, firsts): the packets that set the bits of each window's sketch, in order; 2,048 at most."""
    firsts = seen.groupBy("src_ip4", "window", "bucket").agg(F.min("packet_id").alias("first"))
    return firsts.groupBy("src_ip4", "window").agg(F.sort_array(F.collect_list("first")).alias("firsts"))


def port_scan(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Packets at which as many bits as the threshold are set: from the one that sets the last of them to the one
    before the next bit is set."""
    seen, t = probes(packets, cfg), cfg.portscan_threshold
    reached = _sketches(seen).where(F.size("firsts") >= t).select("src_ip4", "window", F.get("firsts", F.lit(t - 1)).alias("from"), F.get("firsts", F.lit(t)).alias("to"))
    until = F.col("packet_id") == F.col("from") if cfg.portscan_once else F.coalesce(F.col("packet_id") < F.col("to"), F.lit(True))
    hit = seen.join(reached, ["src_ip4", "window"]).where((F.col("packet_id") >= F.col("from")) & until)
    kind = "port_scan_suspected" if cfg.profile == "legacy" else "port_scan"
    proto = c.proto_name() if cfg.profile == "legacy" else F.when(F.col("l4") == c.TCP, "TCP").otherwise("UDP")
    return _alerts(hit, "portscan", kind, "Approx distinct dst ports in window >= T", proto)


def port_scan_suspects(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(ip, count): the largest sketch of each source that reached the threshold."""
    sizes = _sketches(probes(packets, cfg)).select("src_ip4", F.size("firsts").cast("long").alias("pop")).where(F.col("pop") >= cfg.portscan_threshold)
    top = sizes.groupBy("src_ip4").agg(F.max("pop").alias("count"))
    return top.orderBy(F.desc("count"), "src_ip4").limit(cfg.top_k).select(c.ip4_text("src_ip4").alias("ip"), "count")


def dns_tunnel(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    return stateless(packets, (), cfg, ("dns_tunnel",))


def beaconing(packets: DataFrame, cfg: ScanConfig, keys: tuple[str, ...] = ("src_ip4", "dst_ip4", "dst_port")) -> DataFrame:
    sent = packets.where(F.col("is_ipv4") & F.col("l4").isin(c.TCP, c.UDP) & c.outbound()).select(*SEEN)
    return _alerts(
        fold.beacons(sent, list(keys), cfg.beaconing_min_count, cfg.beaconing_tolerance), "beaconing", "beaconing", "Potential beaconing detected", c.alert_proto(),
        interval_mean=F.round("interval_mean", 2), interval_stddev=F.round("interval_stddev", 2), sample_count=F.col("sample_count"),
    )


def exfiltration(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The packet with which a destination's bytes from inside reach the threshold.

    Bytes are first summed over stretches of packets, pre-aggregated, and the stretches of a destination are summed
    up; only the stretch in which the threshold falls is sorted by packet. A busy destination so costs no more than
    its share of the scan.
    """
    sent = packets.where(F.col("is_ipv4") & c.outbound()).select(*SEEN, "payload_len", F.shiftright("packet_id", fold.PART_BITS).alias("part"))
    limit = F.lit(cfg.exfil_bytes_threshold).cast("long")
    earlier = Window.partitionBy("dst_ip4").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sent.groupBy("dst_ip4", "part").agg(F.sum("payload_len").alias("size"))
    falls = (
        parts.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")))
        .where((F.col("before") < limit) & (F.col("before") + F.col("size") >= limit)).select("dst_ip4", "part", "before")
    )
    so_far = Window.partitionBy("dst_ip4").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    crossed = (
        sent.join(falls, ["dst_ip4", "part"]).withColumn("bytes_sent", F.col("before") + F.sum("payload_len").over(so_far))
        .where((F.col("bytes_sent") >= limit) & (F.col("bytes_sent") - F.col("payload_len") < limit))
    )
    return _alerts(crossed, "exfil", "exfiltration", "Potential data exfiltration detected", c.alert_proto(), bytes_sent=F.col("bytes_sent"))


def credentials(packets: DataFrame) -> DataFrame:
    """Protocol and redacted user and password of every packet with credentials."""
    hit = packets.where("cred_username <> '' or cred_password <> ''")
    pair = F.concat(c.redact("cred_username"), F.lit(":"), c.redact("cred_password"))
    return hit.select("packet_id", "ts", "src_ip", "dst_ip", F.col("cred_protocol").alias("protocol"), pair.alias("credential"))


def plaintext_credentials(packets: DataFrame, cfg: ScanConfig) -> DataFrame:
    return stateless(packets, (), cfg, ("credential",))


def pattern(payload: Column) -> Column:
    """What the first listed pattern in the payload's first 1,024 bytes is called; null for none."""
    text = c.ascii_lower(c.latin1(c.bytes_at(payload, 0, 1024)))
    return F.coalesce(*(F.when(text.contains(p), what) for p, what in PATTERNS))


def sensitive_pattern(packets: DataFrame) -> DataFrame:
    return stateless(packets, (), ScanConfig(), ("pattern",))


def stateless(packets: DataFrame, words: tuple[str, ...], cfg: ScanConfig, checks: tuple[str, ...] = ("keyword", "dns_tunnel", "credential", "pattern")) -> DataFrame:
    """Alerts of the checks that look at one packet only, from one pass over the packets."""
    name, user = F.col("dns_qname_lower"), F.col("cred_username")
    dot = F.instr(name, ".")
    label = F.when((name != "") & (dot > 1) & (dot - 1 >= cfg.dns_tunnel_len), F.substring(name, F.lit(1), dot - 1))
    # what the checks look at, null where there is nothing to look at
    seen = {
        "keyword": {"word": F.when(F.col("payload_len") > 0, match.keyword(F.col("payload"), words, cfg.payload_max))},
        "dns_tunnel": {"label": label, "bits": F.when(label.isNotNull(), c.entropy(label))},
        "credential": {"login": (user != "") | (F.col("cred_password") != "")},
        "pattern": {"what": F.when(F.col("payload_len") > 10, pattern(F.col("payload")))},
    }
    shown = c.redact("cred_username") if cfg.redact_secrets else user
    who = F.when(user != "", F.concat(F.lit(" user: "), shown)).otherwise("")
    made = {
        "keyword": F.when(F.col("word").isNotNull(), _alert("keyword", "keyword_match", F.concat(F.lit("Matched keyword: "), "word"), c.alert_proto())),
        "dns_tunnel": F.when(F.col("bits") >= cfg.dns_tunnel_entropy, _alert(
            "dns_tunnel", "dns_tunnel", F.concat(F.lit("Potential DNS tunnel: "), name), F.lit("DNS"), subdomain_len=F.length("label"), entropy=F.round("bits", 2),
        )),
        "credential": F.when(F.col("login"), _alert(
            "credential", "sensitive_data", F.concat(F.lit("Plaintext credentials detected ("), "cred_protocol", F.lit(")"), who), F.col("cred_protocol"),
        )),
        "pattern": F.when(F.col("what").isNotNull(), _alert("pattern", "sensitive_data", F.concat(F.lit("Sensitive data pattern: "), "what"), c.alert_proto())),
    }
    columns = {k: v for check in checks for k, v in seen[check].items()}
    keep = (*SEEN, "dns_qname_lower", "cred_username", "cred_protocol")
    some = F.lit(False)
    for k in columns:
        some = some | (F.col(k) if k == "login" else F.col(k).isNotNull())
    rows = settled(packets.select(*keep, *(v.alias(k) for k, v in columns.items()))).where(some)
    return rows.select(F.inline(F.filter(F.array(*(made[k] for k in checks)), lambda x: x.isNotNull())))


def _legacy(packets: DataFrame, ioc: match.Indicators, cfg: ScanConfig) -> list[DataFrame]:
    """Four kinds; addresses of other frames count as 0.0.0.0, protocols have their names."""
    zero = packets.withColumns({f"{s}_ip4": F.coalesce(f"{s}_ip4", F.lit(0).cast("long")) for s in ("src", "dst")})
    zero = zero.withColumns({f"{s}_ip": c.ip4_text(f"{s}_ip4") for s in ("src", "dst")})
    ip = match.blocked(zero, ioc.networks, "src", "dst").where("blocked_src or blocked_dst")
    named = match.listed_domains(zero.where("dns_qname_lower <> ''"), ioc.domains, "packet_id", "dns_qname_lower")
    word = zero.where("payload_len > 0").withColumn("word", match.keyword(F.col("payload"), ioc.keywords, cfg.payload_max)).where("word is not null")
    return [
        _alerts(ip, "ip", "blocklisted_ip", "Matched IP blocklist (src or dst)", c.proto_name()),
        _alerts(named, "domain", "blocklisted_domain", F.concat(F.lit("Matched domain blocklist: "), "dns_qname_lower"), c.proto_name()),
        _alerts(word, "keyword", "keyword_match", F.concat(F.lit("Matched keyword: "), "word"), c.proto_name()),
        port_scan(zero, cfg),
    ]


def alerts(packets: DataFrame, ioc: match.Indicators, cfg: ScanConfig) -> DataFrame:
    """All alerts of the profile, unordered; order them by packet_id and check_ord."""
    if cfg.profile == "legacy":
        parts = _legacy(packets, ioc, cfg)
    else:
        parts = [
            blocklisted_ip(packets, ioc.networks), blocklisted_domain(packets, ioc.domains), stateless(packets, ioc.keywords, cfg),
            port_scan(packets, cfg), beaconing(packets, cfg), exfiltration(packets, cfg),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*names(ALERTS))


def written(found: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Alerts in order, as many as are to be written."""
    ordered = found.orderBy("packet_id", "check_ord")
    return ordered.limit(cfg.max_alerts) if cfg.max_alerts else ordered


def alert_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("count"), F.min(c.severity()).alias("severity"))
