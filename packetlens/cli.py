"""Command line: ``python -m packetlens.cli --pcap FILE --out DIR [...]``. Wrong arguments end with status 2."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from packetlens.config import ScanConfig
from packetlens.operators import match
from packetlens.plans.progress import reported
from packetlens.plans.scan import scan_files
from packetlens.sources import results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="packetlens", allow_abbrev=False)
    p.add_argument("--pcap", required=True, help="capture file, glob or folder")
    p.add_argument("--out", required=True, help="folder for the results")
    p.add_argument("--ip-blocklist")
    p.add_argument("--domain-blocklist")
    p.add_argument("--keywords")
    p.add_argument("--bpf", default="")
    p.add_argument("--top-k", type=int, default=50)
    p.add_argument("--payload-max", type=int, default=512)
    p.add_argument("--portscan-threshold", type=int, default=64)
    p.add_argument("--portscan-window", type=int, default=10)
    p.add_argument("--max-alerts", type=int, default=0)
    p.add_argument("--enable-carving", action="store_true")
    p.add_argument("--no-redact", action="store_true")
    p.add_argument("--profile", choices=("ext", "legacy"), default="ext")
    p.add_argument("--single", action="store_true", help="write plain files through the driver, not folders of part files")
    p.add_argument("--land", help="folder to keep the decoded packets in, as Parquet")
    p.add_argument("--progress", help="file that tells how far the scan is")
    p.add_argument("--keylog", help="accepted and not used")
    p.add_argument("--openmp", action="store_true", help="accepted and not used")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        cfg = ScanConfig(
            top_k=a.top_k, payload_max=a.payload_max, portscan_threshold=a.portscan_threshold, portscan_window_seconds=a.portscan_window,
            max_alerts=a.max_alerts, enable_carving=a.enable_carving, redact_secrets=not a.no_redact, profile=a.profile,
        )
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("packetlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began = time.time()
    ioc = match.loaded(spark, a.ip_blocklist, a.domain_blocklist, a.keywords)
    with reported(spark, a.pcap, a.progress):
        scan = scan_files(spark, a.pcap, ioc, cfg, a.bpf, a.land or f"{a.out}/packets.parquet")
    results.write(scan, a.out, single=a.single)
    print(f"scanned {scan.packets.count()} packets in {time.time() - began:.1f} s; results in {a.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
