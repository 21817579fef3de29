import frames as fr
import pytest

from packetlens.config import ScanConfig
from packetlens.operators import decode
from packetlens.streaming import live

T0 = 1_700_000_000_000_000


def collected(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def write(folder, name, packets):
    (folder / name).write_bytes(fr.pcap(packets))


def test_folder_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    scan = [(T0 + 100_000 * k, fr.eth(fr.ip4(fr.tcp(b"", 5000, p, 2), src="10.0.0.9"))) for k, p in enumerate(range(1, 30))]
    steady = [(T0 + 2_000_000 * k, fr.eth(fr.ip4(fr.tcp(b"hi", 5000, 9999)))) for k in range(25)]
    both = sorted(scan + steady)
    write(folder, "a.pcap", both[:20])
    write(folder, "b.pcap", both[20:])
    write(folder, "c.pcap", [(T0 + 3_600_000_000, fr.eth(fr.ip4(fr.udp(b"x", 1, 2), 17)))])
    packets = live.timed(decode.headers(live.stream(spark, str(folder))), "1 second")
    cfg = ScanConfig(portscan_threshold=16, portscan_window_seconds=60)
    scans = collected(spark, live.port_scans(packets, cfg), "scans", tmp_path)
    assert len(scans) == 1 and scans[0].src_ip4 == 10 << 24 | 9 and scans[0].ports == 16
    found = collected(spark, live.beacons(packets, ScanConfig()), "beacons", tmp_path)
    assert [(r.dst_port, r.sample_count, r.interval_mean) for r in found] == [(9999, 10, 2.0)] * 2
    rows = collected(spark, live.traffic(packets, "10 seconds"), "traffic", tmp_path)
    assert sum(r.packets for r in rows) in (len(both), len(both) + 1)


def test_late_files_are_read_or_told(tmp_path):
    for name in ("b.pcap", "d.pcap"):
        write(tmp_path, name, [])
    reader = live.FolderReader({"path": str(tmp_path)})
    names = lambda a, b: [r.path.rsplit("/", 1)[1] for r in reader.partitions(a, b)]
    first = reader.latestOffset()
    assert names(reader.initialOffset(), first) == ["b.pcap", "d.pcap"]
    write(tmp_path, "c.pcap", [])
    write(tmp_path, "e.pcap", [])
    second = reader.latestOffset()
    assert names(first, second) == ["c.pcap", "e.pcap"] and len({r.first_id for r in reader.partitions(first, second)}) == 2
    assert names(second, reader.latestOffset()) == []
    write(tmp_path, "a.pcap", [])  # while nothing reads
    restarted = live.FolderReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="appeared while"):
        restarted.partitions(second, restarted.latestOffset())
