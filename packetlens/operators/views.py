"""What a reader of results asks for, as DataFrames over the tables of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.functions import columns as c

TOP, ROWS, LOG_ROWS, ALERT_ROWS = 10, 500, 100, 2000


def matching(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON holds the text, whatever its case."""
    return df.where(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(text.lower()))) if text else df


def hosts(top_src: DataFrame, top_dst: DataFrame, text: str = "") -> DataFrame:
    """Bytes sent and received of every host of either list, with its role."""
    s, d = top_src.select("ip", F.col("count").alias("src_bytes")), top_dst.select("ip", F.col("count").alias("dst_bytes"))
    both = s.join(d, "ip", "full").select("ip", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("src_bytes", "dst_bytes")))
    both = both.withColumn("total_bytes", F.col("src_bytes") + F.col("dst_bytes")).withColumn("role", c.host_role("src_bytes", "dst_bytes"))
    return both.where(F.contains(F.lower("ip"), F.lit(text.lower()))) if text else both


def sessions(flows: DataFrame, proto: str = "", text: str = "", rows: int = ROWS) -> DataFrame:
    """Largest flows; the protocol in any letter case."""
    chosen = flows.where(F.lower("proto") == proto.lower()) if proto else flows
    return matching(chosen, text).orderBy(F.desc("bytes"), "src_ip", "dst_ip", "src_port", "dst_port", "proto").limit(rows)


def names(top: DataFrame, text: str = "") -> DataFrame:
    """Heavy hitters whose key holds the text."""
    return top.where(F.contains(F.lower("key"), F.lit(text.lower()))) if text else top


def log_head(log: DataFrame, rows: int = LOG_ROWS) -> DataFrame:
    return log.orderBy("packet_id").limit(rows)


def payloads(log: DataFrame, proto: str = "", text: str = "", rows: int = ROWS) -> DataFrame:
    """Payload log with the first five strings; the protocol as it is written."""
    chosen = log.where(F.col("proto") == proto) if proto else log
    return matching(chosen, text).orderBy("packet_id").limit(rows).withColumn("strings", F.slice("strings", 1, 5))


def files(carved: DataFrame) -> DataFrame:
    return carved.orderBy("packet_id").drop("body", "packet_id")


def credentials(found: DataFrame) -> DataFrame:
    return found.orderBy("packet_id")


def alerts(found: DataFrame, kind: str = "", text: str = "", severity: str = "", rows: int = ALERT_ROWS) -> DataFrame:
    chosen = found.withColumn("severity", c.severity())
    chosen = chosen.where(F.col("type") == kind) if kind else chosen
    chosen = chosen.where(F.col("severity") == severity) if severity else chosen
    return matching(chosen, text).orderBy("packet_id", "check_ord").limit(rows)


def summary_cards(summary: DataFrame, top: int = TOP) -> DataFrame:
    """The summary with its lists cut to the first few."""
    lists = [f.name for f in summary.schema if f.dataType.typeName() == "array"]
    return summary.withColumns({x: F.slice(x, 1, top) for x in lists})


def unique_sources(alerts: DataFrame) -> DataFrame:
    return alerts.select("src_ip").distinct()
