"""Protocol logs, payload log and carved files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import columns as c

STRINGS, SCANNED, PREVIEW = 20, 2048, 64
HASHED = 65536


def _ends() -> list[Column]:
    end = lambda side: F.concat(f"{side}_ip", F.lit(":"), F.col(f"{side}_port").cast("string")).alias(side)
    return [F.col("ts"), end("src"), end("dst")]


def _given(name: str, alias: str, cond: Column | None = None) -> Column:
    return F.when(cond if cond is not None else F.col(name) != "", F.col(name)).alias(alias)


def dns(packets: DataFrame) -> DataFrame:
    return packets.where("is_dns").select("packet_id", *_ends(), F.col("dns_queries").alias("queries"), F.col("dns_answers").alias("answers"))


def http(packets: DataFrame) -> DataFrame:
    return packets.where("is_http").select(
        "packet_id", *_ends(), _given("http_method", "method"), _given("http_uri", "uri"), _given("http_host", "host"),
        _given("http_status_code", "status", F.col("http_status_code") > 0), _given("http_content_type", "content_type"),
    )


def tls(packets: DataFrame) -> DataFrame:
    return packets.where("is_tls").select(
        "packet_id", *_ends(), F.col("tls_version").alias("version"), _given("tls_sni", "sni"), _given("tls_ja3", "ja3"),
        _given("tls_alpn", "alpn", F.size("tls_alpn") > 0),
    )


def payload(packets: DataFrame) -> DataFrame:
    """Printable strings and a preview of payloads that no other log covers."""
    rest = packets.where("not is_dns and not is_http and not is_tls and not is_dhcp and payload_len > 0")
    rest = rest.withColumn("strings", c.extract_strings("payload", SCANNED)).where(F.size("strings") > 0)
    icmp = F.col("l4").isin(c.ICMP, c.ICMPV6)
    return rest.select(
        "packet_id", *_ends(), c.proto_name().alias("proto"), "payload_len", _given("icmp_type", "icmp_type", icmp), _given("icmp_code", "icmp_code", icmp),
        F.slice("strings", 1, STRINGS).alias("strings"), c.hex_preview("payload", PREVIEW).alias("hex_preview"),
    )


def carved(packets: DataFrame, compat: bool = False) -> DataFrame:
    """Bodies of 16 bytes and more of successful HTTP responses in one packet, named by the hash of their first 64 KiB.

    ``compat`` takes the body from where the payload's offset would point in the frame (needs column data).
    """
    hit = packets.where("is_http and http_status_code between 200 and 299 and http_body_len >= 16 and http_body_offset < raw_len")
    source, size = (F.col("data"), F.col("http_body_len")) if compat else (F.col("payload"), F.col("http_body_len"))
    hit = hit.withColumn("body", c.bytes_at(source, F.col("http_body_offset"), size))
    hit = hit.withColumn("sha256", F.sha2(c.bytes_at("body", 0, HASHED), 256))
    return hit.select(
        "packet_id", "ts", F.concat(F.substring("sha256", 1, 16), c.file_extension("http_content_type", "body")).alias("filename"), "sha256",
        F.col("http_content_type").alias("content_type"), F.col("http_body_len").alias("size"), "src_ip", "dst_ip", "body",
    )
