"""Results of a scan as files, and back: summary, alerts, flows, protocol logs, carved files, progress."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.plans.scan import SUMMARY_ORDER, Scan
from packetlens.schema import FLOWS
from packetlens.sources.pcap import store_of

ALERT_KEYS = ("ts", "time", "type", "src_ip", "dst_ip", "proto", "src_port", "dst_port", "detail")
EXTRAS = ("subdomain_len", "entropy", "interval_mean", "interval_stddev", "sample_count", "bytes_sent")


def ndjson(df: DataFrame, *keys: str) -> Column:
    """The row as one JSON line: ts with six decimals first, nulls left out."""
    rest = F.to_json(F.struct(*(k for k in keys if k != "ts")))
    return F.concat(F.lit('{"ts":'), F.format_string("%.6f", F.col("ts")), F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))))


def _text(lines: DataFrame, path: str, single: bool, head: str = "") -> None:
    """Ordered lines as a folder of parts, or as one local file."""
    if not single:
        lines.write.mode("overwrite").text(path)
        return
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
        f.write(head)
        for row in lines.toLocalIterator(prefetchPartitions=True):
            f.write(row[0] + "\n")
    os.replace(f.name, path)


def summary_text(scan: Scan) -> str:
    """summary.json, its keys in fixed order; carved files only if there are any."""
    row = scan.summary.first().asDict(recursive=True)
    out = {k: row[k] for k in SUMMARY_ORDER}
    if scan.cfg.enable_carving:
        listed = scan.carved.orderBy("packet_id").select("filename", "sha256", "content_type", "size", "src_ip", "dst_ip")
        if files := [r.asDict() for r in listed.toLocalIterator()]:
            out["carved_files"] = files
    lines = [f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in out.items()]
    return "{\n" + ",\n".join(lines) + "\n}\n"


def write(scan: Scan, folder: str, single: bool = False) -> None:
    """All result files of a scan, as folders of parts. ``single``: plain local files, drawn through the driver.

    No packets: a summary of zeros, no alerts, flows of a header only, and no protocol logs.
    """
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/summary.json") as f:
        f.write(summary_text(scan).encode())
    alerts = scan.written_alerts
    _text(alerts.select(ndjson(alerts, *ALERT_KEYS, *EXTRAS)), f"{folder}/alerts.ndjson", single)
    six = lambda x: F.format_string("%.6f", F.col(x)).alias(x)
    flows = scan.flows.orderBy("first_ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto")
    names = [x.split()[0] for x in FLOWS.split(", ")]
    line = F.concat_ws(",", *(six(x) if x.endswith("_ts") else F.col(x).cast("string") for x in names))
    if single:
        _text(flows.select(line), f"{folder}/flows.csv", True, ",".join(names) + "\n")
    else:
        flows.select(*(six(x) if x.endswith("_ts") else x for x in names)).write.mode("overwrite").csv(f"{folder}/flows.csv", header=True)
    if not scan.packets.isEmpty():
        for name, log in scan.logs().items():
            keys = [x for x in log.columns if x != "packet_id"]
            _text(log.orderBy("packet_id").select(ndjson(log, *keys)), f"{folder}/{name}.jsonl", single)
    if scan.cfg.enable_carving:
        write_carved(scan.carved, f"{folder}/files")


def write_carved(carved: DataFrame, folder: str) -> None:
    """Each body under its name, written aside and moved, so that a task that runs again does no harm."""
    def put(rows: Iterator) -> None:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            aside = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(bytes(r.body))
            store.move(aside, f"{base}/{r.filename}")

    carved.select("filename", "body").foreachPartition(put)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of a file; lines that are no JSON are skipped."""
    kinds = "ts double, time string, type string, src_ip string, dst_ip string, proto string, src_port int, dst_port int, detail string, subdomain_len int, entropy double, interval_mean double, interval_stddev double, sample_count int, bytes_sent long"
    return spark.read.schema(kinds).option("mode", "DROPMALFORMED").json(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOWS).csv(path, header=True).fillna("", ["app_proto"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def read_summary(path: str) -> dict:
    store, name = store_of(str(path))
    with store.open_input_stream(name) as f:
        return json.loads(f.read())
