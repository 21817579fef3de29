import collections
import hashlib
import math
import random

import numpy as np

from packetlens.llm import weighted


def jaccard(a, b):
    def bag(t):
        w = t.encode().split()
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collision_rate_is_weighted_jaccard():
    rng = random.Random(2)
    errors = []
    for _ in range(150):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(20, 400))]
        other = [w if rng.random() > 0.03 else "zz" for w in base] + base[: rng.randint(0, 80)]
        a, b = " ".join(base), " ".join(other)
        errors.append(weighted.likeness(weighted.samples_of(a), weighted.samples_of(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.sqrt(np.mean(np.square(errors))) < 0.055


def test_blocks_do_not_matter():
    text = "".join(random.Random(k).choice(["word ", "other\n", "ü ", "\t"]) for k in range(3000))
    data = text.encode()
    assert (weighted.word_hashes(data, 64) == weighted.word_hashes(data)).all() and len(weighted.word_hashes(data)) == len(data.split())
    assert (weighted.samples_of(text, block=7) == weighted.samples_of(text)).all()
    assert weighted.likeness(weighted.samples_of(""), weighted.samples_of(" \n")) == 1.0
    assert weighted.likeness(weighted.samples_of(""), weighted.samples_of("a")) == 0.0


def test_edited():
    assert weighted.edited("abcdef", "xyzuvw") == "abcxyz" and weighted.edited("abcde", "x") == "abcx" and weighted.edited("a", "xyz") == "a" and weighted.edited("", "x") == ""


def check(df, parts):
    rows = df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    rows = [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text.encode()))]
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        e = weighted.edited(a, b)
        s = [weighted.samples_of(x) for x in (a, e, b)]
        want.append((i is not None, i or 0, len(a), hashlib.sha256(e.encode()).hexdigest(), weighted.likeness(s[0], s[1]), weighted.likeness(s[0], s[2])))
    got = weighted.fingerprinted(df, parts).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
    return got


def test_next_documents(spark, odd_docs, no_docs):
    check(odd_docs, 5)
    assert weighted.fingerprinted(no_docs).count() == 0
    one = spark.createDataFrame([(3, "only one document here, its own next")], "doc_id long, text string")
    assert check(one, 4)[0].near_next == 1.0
    rng = random.Random(1)
    many = spark.createDataFrame([(k * 10, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))) for k in range(300)], "doc_id long, text string")
    for parts in (2, 16, 600):
        got = check(many, parts)
    same = collections.defaultdict(set)
    texts = {r.doc_id: r.text for r in many.collect()}
    for r in got:
        same[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_hot_ids_are_cut(spark):
    """Null ids, one id and one row that hold most of the table: every row has its follower, no task has them all."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
    rows = [(None, text()) for _ in range(150)] + [(77, text()) for _ in range(200)] + [(90, "the same row over and over again")] * 2500 + [(k, text()) for k in range(60, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, 40)
    dealt = weighted.followed(df, 40)
    assert dealt.where("doc_id is null and ghost = 0").select("range").distinct().count() > 1
    assert dealt.where("doc_id = 90").count() <= 4
    few = spark.createDataFrame([(None, text()) for _ in range(90)] + [(5, text()) for _ in range(90)], "doc_id long, text string")
    check(few, 30)
    ranges = weighted.followed(few, 30).where("ghost = 0").groupBy("range").count().collect()
    assert len(ranges) > 15 and max(r["count"] for r in ranges) < 30


def slow_samples(text, samples):
    """The method with plain loops over words, terms and samples."""
    mask = (1 << 64) - 1
    m1, m2, m3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mix(x):
        x = (x ^ (x >> 30)) * m2 & mask
        x = (x ^ (x >> 27)) * m3 & mask
        return x ^ (x >> 31)

    def word(w):
        return mix((sum((b + 1) * pow(0x2545F4914F6CDD1D, k, 1 << 64) for k, b in enumerate(w)) + len(w) * m1) & mask)

    words = [word(w) for w in text.encode().split()]
    bag = collections.Counter()
    for k in range(max(1, len(words) - 4) if words else 0):
        h = 0
        for x in words[k : k + 5]:
            h = (h * m1 + x) & mask
        bag[mix(h)] += 1
    r, c, b = weighted.draws()
    out = []
    for k in range(samples):
        odd, best = mix((k + 1) * m1 & mask) | 1, None
        for term, n in bag.items():
            d = (term * odd & mask) >> 48
            t = math.floor(math.log(n) / r[d] + b[d])
            value = c[d] - r[d] * (t - b[d]) - r[d]
            if best is None or value < best[0]:
                best = (value, (term + t * m2) & mask)
        out.append(mix((best[1] + k) & mask) >> 48 if best else 0)
    return out


def test_samples_against_brute_force():
    rng = random.Random(12)
    for n in (0, 1, 4, 5, 30, 200):
        text = " ".join(rng.choice(["alpha", "be", "ç", "dd", "e"]) for _ in range(n))
        want = slow_samples(text, 64)
        # 32-bit and 64-bit arithmetic may part on a near tie
        assert np.mean(weighted.samples_of(text, 64) == np.array(want, dtype=np.uint16)) >= 0.98
