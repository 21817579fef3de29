"""A whole scan: captures to packets, landed once, and from them every table of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.config import ScanConfig
from packetlens.operators import aggregate, decode, detect, logs, match
from packetlens.plans.bpf import where
from packetlens.sources import pcap

SUMMARY_ORDER = (
    "world_size", "packets", "bytes", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6", "arp", "other", "dns_queries", "http_requests", "tls_handshakes",
    "dhcp_messages", "alerts_total", "alerts_blocklisted_ip", "alerts_blocklisted_domain", "alerts_keyword", "alerts_portscan", "alerts_dns_tunnel",
    "alerts_beaconing", "alerts_exfil", "alerts_sensitive", "files_carved", "credentials_found", "top_src_bytes", "top_dst_bytes", "top_dns_qnames",
    "top_http_hosts", "top_tls_sni", "portscan_suspects",
)


@dataclass
class Scan:
    """Lazy tables over one set of packets. Results do not depend on how Spark deals the packets out."""

    packets: DataFrame
    ioc: match.Indicators
    cfg: ScanConfig = field(default_factory=ScanConfig)

    @property
    def alerts(self) -> DataFrame:
        return detect.alerts(self.packets, self.ioc, self.cfg)

    @property
    def written_alerts(self) -> DataFrame:
        return detect.written(self.alerts, self.cfg)

    @property
    def flows(self) -> DataFrame:
        return aggregate.flows(self.packets)

    @property
    def carved(self) -> DataFrame:
        found = logs.carved(self.packets)
        return found if self.cfg.enable_carving else found.where(F.lit(False))

    @property
    def credentials(self) -> DataFrame:
        return detect.credentials(self.packets)

    @property
    def suspects(self) -> DataFrame:
        return detect.port_scan_suspects(self.packets, self.cfg)

    def top(self, what: str) -> DataFrame:
        legacy = self.cfg.profile == "legacy"
        if what in ("src", "dst"):
            return aggregate.top_bytes(self.packets, what, self.cfg.top_k, legacy)
        return aggregate.top_names(self.packets, {"dns": "dns_qname_lower", "http": "http_host", "tls": "tls_sni"}[what], self.cfg.top_k)

    def logs(self) -> dict[str, DataFrame]:
        return {"dns": logs.dns(self.packets), "http": logs.http(self.packets), "tls": logs.tls(self.packets), "payload": logs.payload(self.packets)}

    @property
    def summary(self) -> DataFrame:
        """One row: counters, and the lists of at most top_k entries."""
        def listed(df: DataFrame, name: str) -> DataFrame:
            key = df.columns[0]
            order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), key, "count"))), lambda x: F.struct(x[key].alias(key), x["count"].alias("count")))
            return df.agg(order.alias(name))

        parts = [
            aggregate.counters(self.packets), aggregate.alert_counters(self.alerts), self.carved.agg(F.count("*").alias("files_carved")),
            self.credentials.agg(F.count("*").alias("credentials_found")), listed(self.top("src"), "top_src_bytes"), listed(self.top("dst"), "top_dst_bytes"),
            listed(self.top("dns"), "top_dns_qnames"), listed(self.top("http"), "top_http_hosts"), listed(self.top("tls"), "top_tls_sni"),
            listed(self.suspects, "portscan_suspects"),
        ]
        # each part has one row: the join adds columns
        one = parts[0].withColumn("one", F.lit(1))
        for part in parts[1:]:
            one = one.join(F.broadcast(part.withColumn("one", F.lit(1))), "one")
        return one.withColumn("world_size", F.lit(1)).select(*SUMMARY_ORDER)


def scan_raw(raw: DataFrame, ioc: match.Indicators, cfg: ScanConfig | None = None, bpf: str = "", land: str | None = None) -> Scan:
    """Scan of raw packets. ``bpf`` filters frames before anything counts; ``land`` keeps the packets as Parquet."""
    cfg = cfg or ScanConfig()
    chosen = where(raw, bpf) if bpf else raw
    packets = decode.legacy(chosen) if cfg.profile == "legacy" else decode.decoded(chosen)
    if land:
        packets.write.mode("overwrite").parquet(land)
        packets = raw.sparkSession.read.parquet(land)
    return Scan(packets, ioc, cfg)


def scan_files(spark: SparkSession, path: str, ioc: match.Indicators | None = None, cfg: ScanConfig | None = None, bpf: str = "", land: str | None = None, **options: str) -> Scan:
    """Scan of capture files."""
    raw = pcap.load(spark, path, **options)
    return scan_raw(raw, ioc or match.of_lists(spark), cfg, bpf, land)
