"""Captures as they arrive: a streaming source over a folder, windowed traffic, and stateful detectors.

Beyond a whole scan: results here are by event time, with a watermark for late packets and an end to idle state. Files
are taken in name order; rotating capture writers name them so.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetlens.config import ScanConfig
from packetlens.functions import columns as c
from packetlens.schema import RAW
from packetlens.sources.pcap import FILE_BITS, CaptureError, PcapReader, Range


class FolderReader(DataSourceStreamReader):
    """Offsets are the last file name read, how many files were read, and those of them that came late.

    A batch is the files after the last one in name order, and files with smaller names that were not there when their
    turn was. A file must be whole when it appears. Late files are told from those read by what this reader has seen;
    after a restart it has seen nothing, so that a file that came late in between is an error that says so.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options.get("path", "").removeprefix("file://")
        self.reader = PcapReader(options)
        self.suffix = options.get("suffix", ".pcap")
        self.seen: set[str] | None = None
        self.last, self.files, self.late = "", 0, []

    def _names(self) -> list[str]:
        return sorted(x for x in os.listdir(self.folder) if x.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"last": "", "files": 0, "late": []}

    def latestOffset(self) -> dict:
        names = self._names()
        if self.seen is not None:
            self.late += [x for x in names if x < self.last and x not in self.seen]
        self.seen = set(names) | (self.seen or set())
        self.last = max(self.last, names[-1] if names else "")
        self.files = len(self.seen)
        return {"last": self.last, "files": self.files, "late": list(self.late)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        names, known, late = self._names(), start.get("late", []), end.get("late", [])
        if late[: len(known)] == known:
            late = late[len(known) :]
        before = sum(x <= start["last"] for x in names)
        if before - len(set(late)) > start["files"]:
            raise CaptureError(f"a file before {start['last']} appeared while nothing read the folder: give it a later name")
        new = [x for x in names if start["last"] < x <= end["last"]]
        return [Range(os.path.join(self.folder, x), (start["files"] + k) << FILE_BITS) for k, x in enumerate([*late, *(x for x in new if x not in late)])]

    def read(self, partition: Range) -> Iterator:
        return self.reader.read(partition)


class PcapFolder(DataSource):
    """The streaming data source "pcap_folder"."""

    @classmethod
    def name(cls) -> str:
        return "pcap_folder"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Raw packets of captures that appear in a folder."""
    spark.dataSource.register(PcapFolder)
    return spark.readStream.format("pcap_folder").options(**options).load(folder)


def timed(packets: DataFrame, late: str = "1 minute") -> DataFrame:
    """Packets with column at, their event time, and a watermark on it."""
    return packets.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)


def traffic(packets: DataFrame, window: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Packets and bytes by window and source."""
    w = F.window("at", window, slide) if slide else F.window("at", window)
    return (
        packets.where("is_ipv4 or is_ipv6").groupBy(w.alias("w"), "src_ip")
        .agg(F.count("*").alias("packets"), F.sum(F.col("raw_len").cast("long")).alias("bytes"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "src_ip", "packets", "bytes")
    )


SCANS = "src_ip4 long, packet_id long, ts_us long, ports int"


def port_scans(packets: DataFrame, cfg: ScanConfig, idle_ms: int = 600_000) -> DataFrame:
    """SCANS rows at which a source's sketch reaches the threshold in its window, once a window.

    State of a source: when its window began and the sketch's set bits; it ends ``idle_ms`` of event time after the
    source's last packet. Packets of a micro-batch are taken in packet order.
    """
    probes = packets.where(F.col("is_ipv4") & F.col("l4").isin(c.TCP, c.UDP) & (F.col("dst_port") != 0))
    slim = probes.select("src_ip4", "packet_id", "ts_us", "at", c.bucket("dst_port").alias("bucket"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, bits, told = state.get if state.exists else (None, [], False)
        seen, out, last = set(bits), [], 0
        rows = pd.concat(list(batches)).sort_values("packet_id")
        for r in rows.itertuples():
            second = r.ts_us // 1_000_000
            if begun is None or second >= begun + cfg.portscan_window_seconds:
                begun, seen, told = second, set(), False
            seen.add(r.bucket)
            if len(seen) >= cfg.portscan_threshold and not told:
                told = True
                out.append((key[0], r.packet_id, r.ts_us, len(seen)))
            last = max(last, r.ts_us // 1000)
        state.update((int(begun), sorted(int(x) for x in seen), told))
        # never before the watermark, which state must not fall behind
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["src_ip4", "packet_id", "ts_us", "ports"])

    return slim.groupBy("src_ip4").applyInPandasWithState(
        step, SCANS, "begun long, bits array<int>, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


BEACONS = "src_ip4 long, dst_ip4 long, dst_port int, packet_id long, interval_mean double, interval_stddev double, sample_count int"


def beacons(packets: DataFrame, cfg: ScanConfig, depth: int = 100, idle_ms: int = 86_400_000) -> DataFrame:
    """BEACONS rows at which the last times from a private source to a public port are regular; times are then forgotten."""
    sent = packets.where(F.col("is_ipv4") & F.col("l4").isin(c.TCP, c.UDP) & c.outbound())
    slim = sent.select("src_ip4", "dst_ip4", "dst_port", "packet_id", "ts", "at")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out, last = [], 0
        for r in pd.concat(list(batches)).sort_values("packet_id").itertuples():
            times = [*times[1 - depth :], r.ts]
            last = max(last, int(r.ts * 1000))
            if len(times) < cfg.beaconing_min_count:
                continue
            gaps = [b - a for a, b in zip(times, times[1:])]
            mean = sum(gaps) / len(gaps)
            spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
            if mean > 1.0 and spread < cfg.beaconing_tolerance * mean:
                out.append((*key, r.packet_id, mean, spread, len(times)))
                times = []
        state.update((times,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BEACONS.split(", ")])

    return slim.groupBy("src_ip4", "dst_ip4", "dst_port").applyInPandasWithState(
        step, BEACONS, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
