import hashlib
import math
import random
import re
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from packetlens.llm import secrets


def slow(text):
    t, out = text or "", []
    for m in re.finditer(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    n = [sum(x[1] == k for x in out) for k in range(3)]
    return n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)).encode()).hexdigest()


def test_base_spans_against_brute_force(spark, odd_docs):
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " = ", "'", '"', " ", "abc", "x1y2z3", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "ff", "é", "日", "\n", ".", "-", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["token=token:abcdef", "AKIAAKIA" + "B" * 16, "secret==abcdef", "x" * 50_000 + " password: hunter22", "f" * 23, "f" * 24]
    rows = [(k, t) for k, t in enumerate(texts)]
    found = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == slow(r.text), r.text
    for r in secrets.scanned(odd_docs).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == slow(r.text)


def slow_entropy(w, window=20):
    best = 0.0
    for k in range(len(w) - window + 1):
        x = w[k : k + window]
        best = max(best, -sum(x.count(c) / window * math.log2(x.count(c) / window) for c in set(x)))
    return best


def test_window_entropy(spark):
    rng = random.Random(8)
    letters = secrets.CLASSES[-1][2]
    words = ["".join(rng.choice(letters[: rng.choice([2, 8, 65])]) for _ in range(rng.randint(20, 70))) for _ in range(60)]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.window_entropy(F.col("w"), F.lit(letters)).alias("e")).collect():
        assert r.e == pytest.approx(slow_entropy(r.w), abs=1e-9)


def test_entropy_adds_and_allow_list_suppresses(spark):
    texts = [
        "key aB3dE5gH7jK9mN1pQ3rS5tU7 end", "id 123e4567-e89b-12d3-a456-426614174000 end", "a-long-hyphenated-compound-word-2024 end", "1234567890123456789012345 end",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaa1 end", "token=aB3dE5gH7jK9mN1pQ3rS5tU7", "EXAMPLEaB3dE5gH7jK9mN1pQ3rS5tU7",
    ]
    got = {r.doc_id: r.spans for r in secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "entropy:4:28", 1: "", 2: "", 3: "hex:0:25", 4: "hex:0:28", 5: "assign:0:30", 6: ""}


def test_masks(spark, no_docs, odd_docs):
    df = spark.createDataFrame([(1, "é token=abcdef123 and " + "0f" * 12 + " x"), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert [r.text for r in secrets.redacted(df).orderBy("doc_id").collect()] == ["é [secret] and [secret] x", "nothing", None]
    assert secrets.scanned(no_docs).count() == 0 and secrets.redacted(odd_docs).columns == odd_docs.columns


def test_no_python_in_the_plan(odd_docs):
    assert "Python" not in secrets.scanned(odd_docs)._jdf.queryExecution().toString()


def test_against_sql(spark):
    import duckdb

    rng = random.Random(12)
    bits = ["token", "=", " ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "ff", "é", "aB3dE5gH7jK9mN1pQ3rS5tU7", "x9Y8", "-", "/", "example", "zzzzzzzzzz", "1234567890"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(500)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = secrets.scanned(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert sorted(con.execute(secrets.oracle()).fetchall()) == sorted(map(tuple, got)) and sum("entropy" in r.spans for r in got) > 50


def test_long_candidates(spark):
    rng = random.Random(1)
    blob = "".join(rng.choice(secrets.CLASSES[-1][2]) for _ in range(200_000))
    df = spark.createDataFrame([(1, "a " + blob + " b"), (2, "deadbeef" * 3 + " " + "word " * 50_000)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scanned(df).collect()}
    assert found[1].endswith("entropy:2:200002") or "hex" in found[1]
    assert found[2] == "hex:0:24"


def test_many_matches_in_one_text(spark):
    rng = random.Random(4)
    bits = ["token=abc1234 ", "AKIA" + "Q7" * 9 + " ", "0f" * 13 + " ", "aB3dE5gH7jK9mN1pQ3rS5tU7é ", "aB3dE5gH7jK9mN1pQ3rS5tU7/secret=hunter22 ", "words here, "]
    text = "".join(rng.choice(bits) for _ in range(100_000))
    began = time.monotonic()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    (row,) = secrets.scanned(df).collect()
    (masked,) = secrets.redacted(df).collect()
    assert time.monotonic() - began < 60
    assert ([row.n_assign, row.n_access, row.n_hex], row.base_sha256) == slow(text)
    want, at = [], 0
    for x in row.secret_spans:
        if x.start >= at:
            want += [text[at : x.start], "[secret]"]
        at = max(at, x.stop)
    assert masked.text == "".join(want) + text[at:] and len(row.secret_spans) > 60_000


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randint(0, 99) for _ in range(n)]) for k, n in enumerate([0, 1, 31, 32, 33, 1024, 1025, 40_000])]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = df.select("k", secrets.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), secrets.running(F.col("v"), F.greatest, F.lit(0)).alias("m")).collect()
    assert [(r.k, r.s, r.m) for r in sorted(got)] == [(k, list(accumulate(v)), list(accumulate(v, max))) for k, v in rows]
