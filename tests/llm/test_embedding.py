import math
import random

import numpy as np
import pytest

from packetlens.llm import embedding


def planted(rng, n, dim=32):
    rows = []
    for k in range(n):
        base = np.array([rng.gauss(0, 1) for _ in range(dim)])
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((base + np.array([rng.gauss(0, rng.choice([0.02, 0.2, 0.3])) for _ in range(dim)])).tolist())
    rows += [rows[0]] * 40
    return [(i, [float(np.float32(x)) for x in v], rng.choice([1, 1, 2])) for i, v in enumerate(rows)]


def slow(rows):
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, x, lab = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    for i, j in zip(*np.nonzero(np.triu(near))):
        a, b = sorted((find(ids[i]), find(ids[j])))
        root[b] = a
    return dict(zip(ids, near.sum(axis=1))), {i: find(i) for i in root}


@pytest.mark.parametrize("block", [512, 6])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rows = planted(random.Random(3), 150)
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    links, comps = slow(rows)
    found, real = sum(r.n_links for r in got), sum(links.values())
    assert len(got) == len(rows) and all(r.n_links <= links[r.vec_id] for r in got) and found / real >= 0.97
    assert np.mean([r.component_id == comps[r.vec_id] for r in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 4.0], 1), (4, [1.0, 2.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1),
            (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (13, [1e30, 2e30], 2), (14, [-1.0, -2.0], 1), (15, [0.0, 0.0], 1), (None, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, h string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(df).collect())
    alone = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 14, 15)]
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (0, 4, 1, False), (12, 1, 12, True), (13, 1, 12, False), *alone], key=lambda x: x[:2])
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def at_cosine(rng, base, cosine):
    """A vector at just this cosine to ``base``."""
    other = rng.standard_normal(len(base))
    base = base / np.linalg.norm(base)
    other -= (other @ base) * base
    return cosine * base + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_recall_just_above_the_threshold_at_64_dimensions(spark):
    rng = np.random.default_rng(7)
    rows, wanted = [], 0
    for k in range(1500):
        base = rng.standard_normal(64)
        cosine = rng.uniform(0.9301, 0.94) if k % 3 else rng.uniform(0.92, 0.9299)
        wanted += 2 * (cosine > 0.93)
        rows += [(2 * k, base.tolist(), k % 5), (2 * k + 1, at_cosine(rng, base, cosine).tolist(), k % 5)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = got.agg({"n_links": "sum"}).first()[0]
    assert 0.97 * wanted <= found <= wanted


def test_against_sql(spark):
    """Derived vectors that have links, within labels and across them, against the registered SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        base = rng.standard_normal(64)
        for c in rng.uniform(0.94, 1.0, rng.choice([0, 1, 4])):
            rows.append((len(rows), at_cosine(rng, base, c).astype(np.float32).tolist(), k % 3))
        rows.append((len(rows), base.astype(np.float32).tolist(), k % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    want = sorted(con.execute(embedding.oracle()).fetchall())
    got = sorted(tuple(r) for r in embedding.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(r[1] for r in want) > 200


def test_bits_and_tables_follow_the_count():
    for count in (0, 1, 100, 10_000, 10**6, 10**9):
        tables, bits = embedding.sized(count, 0.93)
        assert count <= 1 << bits and (1 - 0.88**bits) ** tables < 0.01
    assert embedding.sized(10, 1.0)[0] == 1
