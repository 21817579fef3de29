"""Schemas of the tables: raw packets, decoded packets, alerts, flows."""

from __future__ import annotations

RAW = "packet_id long, ts_us long, ts double, caplen int, wirelen int, linktype int, data binary"
FLOWS = (
    "src_ip string, dst_ip string, src_port int, dst_port int, proto string, packets long, bytes long, "
    "first_ts double, last_ts double, app_proto string"
)
#: Columns of every alert; extras are null where a detector has none.
ALERTS = (
    "packet_id long, check_ord int, ts double, time string, type string, src_ip string, dst_ip string, proto string, "
    "src_port int, dst_port int, detail string, subdomain_len int, entropy double, interval_mean double, "
    "interval_stddev double, sample_count int, bytes_sent long"
)


def names(schema: str) -> list[str]:
    return [x.strip().split()[0] for x in schema.split(",")]
