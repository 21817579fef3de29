import collections
import random
import re

import duckdb
import pytest

from packetlens.llm import mixture


def filled(sizes, share=1.5, most=2.0):
    """Shares by hand: one source after the other is capped."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    w = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in out]
        level = left / sum(w[n] for n in free) if free else 0
        over = [n for n in free if most * sizes[n] <= level * w[n]]
        if not over:
            return {**out, **{n: level * w[n] for n in free}}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]


def check(rows):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    return {s: (taken[s], want[s]) for s in sizes}


def test_odd_rows(odd_docs):
    rows = mixture.mixed(odd_docs, keep=["doc_id", "source", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for got, want in check(rows).values():
        assert abs(got - want) <= 4  # rows that repeat share what is left evenly


def test_empty_table(no_docs):
    assert mixture.mixed(no_docs, keep=["doc_id"]).count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixture.mixed(df).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seed", range(3))
def test_against_sql(spark, seed):
    rng = random.Random(seed)
    docs = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 3, 30, 300]))), rng.choice(["hot"] * 6 + ["b", "é", "c", None])) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixture.mixed(df).collect()
    for total, want in check(got).values():
        assert abs(total - want) <= 0.5
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.execute(mixture.oracle()).fetchall())
    assert want == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mixed(df.repartition(7)).collect()))


def test_whole_copies(spark):
    df = spark.createDataFrame([(k, "a b c d", "x" if k < 40 else "y") for k in range(60)], "doc_id long, text string, source string")
    rows = mixture.mixed(df).collect()
    assert all(abs(r.copies * r.size - r.taken) <= r.size / 2 for r in rows)
