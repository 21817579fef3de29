import random
from types import SimpleNamespace

import frames as fr
import pytest

from packetlens.sources import pcap

FRAMES = [(1_700_000_000_000_000 + 250_001 * k, fr.eth(fr.ip4(fr.tcp(b"x" * k)))) for k in range(40)]


def read(spark, path, **options):
    return pcap.register(spark).read.format("pcap").options(**options).load(str(path)).orderBy("packet_id").collect()


@pytest.mark.parametrize("data", [fr.pcap(FRAMES), fr.pcap(FRAMES, ">"), fr.pcap(FRAMES, nanos=True), fr.pcapng(FRAMES), fr.pcapng(FRAMES, ">", 9)], ids=["le", "be", "nanos", "ng", "ng-be-nanos"])
@pytest.mark.parametrize("split", [1 << 20, 500])
def test_formats_and_splits(spark, tmp_path, data, split):
    p = tmp_path / "a.pcap"
    p.write_bytes(data)
    rows = read(spark, p, splitBytes=str(split))
    assert [(r.packet_id, r.ts_us, r.data, r.caplen) for r in rows] == [(k, us, f, len(f)) for k, (us, f) in enumerate(FRAMES)]
    assert rows[3].ts == 1_700_000_000.0 + 750_003 / 1e6
    assert pcap.count_packets(spark, str(p)) == 40 == pcap.count_packets(spark, str(p), split)
    assert sorted(pcap.load(spark, str(p), splitBytes=str(split)).collect()) == rows
    assert len(pcap.planned(str(p), 0, split, True)) == (1 if split > 5000 else pytest.approx(8, abs=3))


def test_simple_blocks_have_no_time(spark, tmp_path):
    p = tmp_path / "s.pcapng"
    p.write_bytes(fr.pcapng(FRAMES[:3], simple=True))
    assert [(r.ts_us, r.data) for r in read(spark, p)] == [(0, f) for _, f in FRAMES[:3]]


def test_several_files_keep_order(spark, tmp_path):
    for k, part in enumerate((FRAMES[:2], FRAMES[2:5])):
        (tmp_path / f"{k}.pcap").write_bytes(fr.pcap(part))
    assert [r.packet_id for r in read(spark, tmp_path / "*.pcap")] == [0, 1, 1 << 40, (1 << 40) + 1, (1 << 40) + 2]


def test_empty_capture(spark, tmp_path):
    p = tmp_path / "e.pcap"
    p.write_bytes(fr.pcap([]))
    assert read(spark, p) == []


def test_broken_tail(spark, tmp_path):
    p = tmp_path / "t.pcap"
    p.write_bytes(fr.pcap(FRAMES[:3])[:-5])
    with pytest.raises(Exception, match="breaks off"):
        read(spark, p)
    assert len(read(spark, p, mode="PERMISSIVE")) == 2


def test_wrong_files(spark, tmp_path):
    with pytest.raises(Exception, match="no capture at"):
        read(spark, tmp_path / "missing.pcap")
    (tmp_path / "x.pcap").write_bytes(b"not a capture at all")
    with pytest.raises(Exception, match="not a capture file"):
        read(spark, tmp_path / "x.pcap")


def test_other_links_warn(tmp_path):
    p = tmp_path / "l.pcap"
    p.write_bytes(fr.pcap(FRAMES[:1], linktype=101))
    with pytest.warns(UserWarning, match="link type 101"):
        pcap.planned(str(p), 0, 1 << 20, True)


def tame(rng, n=1500):
    frames, t = [], 1_700_000_000_000_000
    for _ in range(n):
        t += rng.randint(0, 2_000_000)
        frames.append((t, fr.eth(fr.ip4(fr.tcp(rng.choice([b"\0" * 300, bytes(rng.choices(range(256), k=rng.randint(1, 1400)))]))))))
    return frames


def empties(rng):
    return [(t, b"" if k % 10 == 0 else f) for k, (t, f) in enumerate(tame(rng, 2000))]


def clockless(rng):
    return [(0 if k % 10 == 0 else t, f) for k, (t, f) in enumerate(tame(rng, 2000))]


def nested(rng):
    """A capture inside one packet."""
    frames = tame(rng, 100)
    return [*frames[:50], (frames[50][0], fr.pcap(tame(rng, 600))), *frames[50:]]


def zeros(rng):
    return [(1_700_000_000_000_000 + k, b"\0" * rng.choice([0, 16, 160, 5000])) for k in range(800)]


@pytest.mark.parametrize("made, order, nanos, ids", [
    (tame, ">", True, "offset"), (empties, "<", False, "offset"), (clockless, "<", True, "order"), (nested, ">", False, "offset"), (nested, "<", False, "order"), (zeros, "<", False, "order"),
])
def test_no_cut_loses_or_makes_records(spark, tmp_path, made, order, nanos, ids):
    frames = made(random.Random(order + ids))
    p = tmp_path / "big.pcap"
    p.write_bytes(fr.pcap(frames, order, nanos))
    for split in (40_000, 300_000):
        rows = pcap.load(spark, str(p), ids=ids, splitBytes=str(split)).orderBy("packet_id").collect()
        assert [(r.ts_us, r.data) for r in rows] == frames, split
        if ids == "order":
            assert [r.packet_id for r in rows] == list(range(len(frames)))
        else:
            assert rows[0].packet_id == 24 and len({r.packet_id for r in rows}) == len(frames)
    assert [(r.ts_us, r.data) for r in read(spark, p, ids=ids, splitBytes="90000")] == frames
    assert pcap.count_packets(spark, str(p), 100_000) == len(frames)


def test_a_walk_to_the_end_after_some_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pcap, "ROUNDS", 1)
    frames = [x for k in range(12) for x in nested(random.Random(k))]
    p = tmp_path / "n.pcap"
    p.write_bytes(fr.pcap(frames))
    rows = pcap.load(spark, str(p), splitBytes="20000").orderBy("packet_id").collect()
    assert [(r.packet_id, r.ts_us, r.data) for r in rows] == [(k, *x) for k, x in enumerate(frames)]


def test_a_break_in_the_middle(spark, tmp_path):
    frames = tame(random.Random(5), 300)
    data = bytearray(fr.pcap(frames))
    at = 24 + sum(16 + len(f) for _, f in frames[:200])
    data[at + 8 : at + 12] = b"\xff" * 4
    p = tmp_path / "b.pcap"
    p.write_bytes(data)
    with pytest.raises(Exception, match="impossible length"):
        pcap.load(spark, str(p), splitBytes="9000").collect()
    assert pcap.load(spark, str(p), splitBytes="9000", mode="PERMISSIVE").count() == 200


def test_folders_and_globs_of_a_store(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    for k in range(3):
        (tmp_path / f"{k}.pcap").write_bytes(fr.pcap(FRAMES[:1]))
    (tmp_path / "notes.txt").write_text("x")
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: (store, uri.partition("://")[2].partition("/")[2])))
    assert pcap.located("far://bucket/*.pcap") == [f"far://bucket/{k}.pcap" for k in range(3)]
    assert pcap.located("far://bucket/[12].pcap") == ["far://bucket/1.pcap", "far://bucket/2.pcap"]
    assert pcap.located("far://bucket/1.pcap") == ["far://bucket/1.pcap"]
    assert pcap.located("far://bucket") == [*(f"far://bucket/{k}.pcap" for k in range(3)), "far://bucket/notes.txt"]
    with pytest.raises(FileNotFoundError):
        pcap.located("far://bucket/*.none")
