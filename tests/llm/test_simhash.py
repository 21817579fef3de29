import random

import numpy as np
import pytest
import xxhash

from packetlens.llm import common, simhash


def slow_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, most):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_fingerprints():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["Foo", "BAR", "é", "baz\n", "\tq"]) for _ in range(n))
        assert int.from_bytes(simhash.fingerprint(text), "big") == slow_fingerprint(text)
    text = " ".join(str(rng.random()) for _ in range(2000))
    whole = np.concatenate(list(simhash.shingle_hashes(text, 3)))
    assert (np.concatenate(list(simhash.shingle_hashes(text, 3, 50))) == whole).all()
    assert simhash.fingerprint(None, 5, 256) == bytes(32) and len(simhash.fingerprint("a b", 5, 1024)) == 128


def planted(rng, n, spread):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 4])):
            for b in rng.sample(range(64), rng.randint(0, spread)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out), key=lambda v: rng.random())


@pytest.mark.parametrize("block", [512, 8])
def test_keys_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    values = planted(rng, 250, 4)
    center = rng.getrandbits(64)  # a large group of near copies round one text
    values += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)]
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(values)], "rep long, fp binary")
    roots = {r.node: r.root for r in common.components(simhash.links(df, 3)).collect()}
    want = slow_components(list(enumerate(values)), 3)
    assert {k: roots.get(k, k) for k in want} == want


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (2000, 8), dtype=np.uint8)
    b = np.unpackbits(a, axis=1)
    for row in b:
        row[rng.choice(64, rng.integers(0, 4), replace=False)] ^= 1
    ka, kb = simhash.ring_keys(a), simhash.ring_keys(np.packbits(b, axis=1))
    assert (ka == kb).any(axis=1).all()


def test_chains_are_walks_round_rings():
    for count in (0, 1, 1 << 14, 1 << 18, 1 << 22, 1 << 30, 1 << 35):
        bits = simhash.key_bits(count)
        assert 8 * count <= 1 << bits
        slots = simhash.chains(bits)
        alike = -(-bits // 4)
        assert slots.shape[1] == alike + simhash.FOLLOW and all(len(set(x)) == len(x) for x in slots.tolist())
        assert len({frozenset(x[:alike]) for x in slots.tolist()}) == len(slots)


def test_keys_and_budgets_against_brute_force():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 256, (4, simhash.WIDE // 8), dtype=np.uint8)
    for bits in (17, 18, 19, 20):
        slots = simhash.chains(bits)[:50]
        key, chain = simhash.filed(fps, bits, slots)
        for r in range(4):
            digits = "".join(f"{x:08b}" for x in fps[r])
            for k in range(50):
                walk = "".join(digits[4 * i : 4 * i + 4] for i in slots[k])
                assert key[r, k] == (k << bits) | int(walk[:bits], 2) and chain.view(np.uint64)[r, k] == int(walk[20:], 2)
        for (mask, most), follow in zip(simhash.budgets(bits), (4, 8, 16)):
            assert f"{mask:016x}" == "f" * follow + "0" * (16 - follow) and most == (5 + follow) * simhash.NEAR // 256


def shingles_of(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [512, 8])
def test_similar_odd_rows(odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "SETS", block)
    rows = simhash.similar(odd_docs, 5, 0.8).collect()
    assert len(rows) == odd_docs.count() and simhash.similar(no_docs, 5, 0.8).count() == 0
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[0] == of[1] == of[2] == {0} and of[111] == {111} and of[3] == {3}


def test_recall_of_lone_pairs_by_similarity(spark):
    """Pairs that only their own link can find, by bands of their exact similarity: nine of ten at least in each."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    docs, exact = [], {}
    for k in range(900):
        n = rng.choice([9, 12, 25, 60, 150, 400])
        w = [word() for _ in range(n)]
        v = list(w)
        edits = rng.randint(1, max(1, n // 40))
        if n < 60 or rng.random() < 0.4:  # at an end, in one stretch
            v = v + [word() for _ in range(rng.randint(1, max(1, n // 5)))] if rng.random() < 0.5 else v[: n - rng.randint(1, max(1, n // 6))]
        else:
            for at in rng.sample(range(n), edits):
                v[at] = word()
        a, b = shingles_of(w), shingles_of(v)
        exact[2 * k] = len(a & b) / len(a | b)
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()}
    for lo, hi in ((0.8, 0.825), (0.825, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [k for k, j in exact.items() if lo <= j < hi]
        assert len(band) > 30 and np.mean([got[k + 1] == k for k in band]) >= 0.9, (lo, len(band))
    assert all(got[k + 1] == k + 1 for k, j in exact.items() if j < 0.8)


@pytest.mark.parametrize("block", [512, 8])
def test_similar_texts_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SETS", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for k in range(60):
        w = [word() for _ in range(rng.choice([5, 9, 40, 300]))]
        texts.append(w)
        for _ in range(k % 4):
            v = list(w)
            for at in rng.sample(range(len(w)), min(len(w), rng.randint(0, max(1, len(w) // 30)))):
                v[at] = word()
            texts.append(v)
        texts.append(w + w[:5] * rng.choice([0, 40]))  # a repeated passage changes the fingerprint, not the set much
    common = [word() for _ in range(120)]
    texts += [common + [word() for _ in range(rng.randint(0, 60))] for _ in range(80)]  # near 0.8, on both sides
    texts = [" ".join(w) for w in texts]
    sets = [shingles_of(x.split()) for x in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()}
    assert [got[k] for k in range(len(texts))] == root


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_EDGES", broadcast)
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
