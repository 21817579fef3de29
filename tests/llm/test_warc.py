import base64
import hashlib
import io
import random
import uuid

import zstandard

from packetlens.llm import warc


def test_bundle_is_seekable_and_plain_zstd():
    rng = random.Random(1)
    parts = [bytes(rng.choices(b"abc", k=rng.choice([0, 10, 5000, 400_000]))) for _ in range(40)]
    out = io.BytesIO()
    out.close, keep = lambda: None, out
    b = warc.Bundle(out)
    places = [(*b.add(p), len(p)) for p in parts]
    b.close()
    data = keep.getvalue()
    reader = warc.Reader(io.BytesIO(data), len(data))
    assert len(reader.sizes) > 3
    for k in rng.sample(range(40), 40):
        assert reader.record(*places[k]) == parts[k]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(parts)


def test_record_round_trip():
    name, raw = warc.record(7, "http://x/\r\nEvil: 1", "tëxt".encode(), None)
    head, http, payload = warc.parsed(raw)
    assert payload == "tëxt".encode() and head["WARC-Type"] == "response" and head["WARC-Record-ID"] == f"<{name}>" and "Evil" not in head
    head, http, payload = warc.parsed(warc.record(8, None, b"", 7)[1])
    assert head["X-Refers-To-Page-Id"] == "7" and payload == b"" and b"Content-Length: 0" in http


def test_archive(spark, tmp_path):
    pages = [(k, f"http://h/{k}", t) for k, t in enumerate(["a", "b", "a", None, "", "x" * 600_000, "b", "é" * 10])]
    pages += [(None, "u", "a"), (3, "again", None), (20, None, "b"), (21, "u", "é" * 10)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, payload string, frame int")
    got = warc.archived(df, str(tmp_path / uuid.uuid4().hex)).collect()
    first = {}
    for i, _, t in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(t or "", i)
    want = []
    for i, _, t in pages:
        b = (t or "").encode()
        ref = None if i is None or first[t or ""] == i else first[t or ""]
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:4])
    large = warc.archived(df, str(tmp_path / uuid.uuid4().hex), revisit_bytes=5).collect()
    assert sorted(r.page_id for r in large if r.record_type == "revisit") == [21]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none, str(tmp_path / "none")).count() == 0
