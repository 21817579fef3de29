import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from packetlens.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.codec(*bpe.located(None, None))


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in own.token.items()}, special_tokens={})


def texts(n):
    rng = random.Random(11)
    bits = ["ab", " ", "  ", "\n", "\t", "1", "!!", "é", "'s", "'ll", "日", "a" * 30, " " * 20, "\r\n", "<|endoftext|>", "😀", " ", "x'"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_stitching_equals_one_pass(own):
    rng = random.Random(1)
    for t in texts(3000):
        got = [p for part in bpe.stitched(own.pattern, t, rng.randint(5, 40), rng.randint(2, 9)) for p in part]
        assert got == own.pattern.findall(t)


def test_ids_equal_the_library(own, library):
    for t in texts(800):
        ids = own.encode(t, 30, 5)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_cache_starts_anew(own, monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert np.frombuffer(own.encode("one two three four five six"), "<u4").tolist() == library.encode_ordinary("one two three four five six")


def test_odd_rows(odd_docs, no_docs, library):
    rows = bpe.encoded(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encoded(no_docs).count() == 0
    back = bpe.decoded(bpe.encoded(odd_docs)).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back)


def test_long_texts_by_chunks(spark, odd_docs, library):
    rows = [(k, t * 3, "s") for k, t in enumerate(texts(40))] + [(1, texts(2)[1] * 3, "s"), (1, texts(2)[1] * 3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for frame in (df, odd_docs):
        whole = sorted(map(str, bpe.encoded(frame).collect()))
        assert sorted(map(str, bpe.encoded(frame, long=20, chunk=37, overlap=6).collect())) == whole


def test_map_columns_are_carried(spark):
    df = spark.createDataFrame([(1, "one two three four", {"a": 1}), (2, "five", {"b": 2})], "doc_id long, text string, extra map<string, int>")
    for long in (4, 1000):
        got = {r.doc_id: (r.n_tokens > 0, r.extra) for r in bpe.encoded(df, long=long, chunk=5, overlap=2).collect()}
        assert got == {1: (True, {"a": 1}), 2: (True, {"b": 2})}
