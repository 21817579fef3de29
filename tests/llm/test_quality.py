import random

import numpy as np

from packetlens.llm import quality


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def junk(rng, kind):
    words = prose(rng, 120).split()
    return {
        "symbols": " ".join(w + "%%%" for w in words), "shout": " ".join(w.upper() + "!!" for w in words), "table": " | ".join(words),
        "runs": " ".join(w for w in words[:8] for _ in range(12)),
    }[kind]


def test_separates_planted_junk(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.choice([3, 9, 40, 300])), 1) for k in range(400)]
    rows += [(1000 + k, junk(rng, kind), 0) for k in range(20) for kind in ("symbols", "shout", "table", "runs")]
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    found = quality.classified(df).collect()
    right = np.mean([r.kept == bool(r.good) for r in found])
    clean = np.mean([r.kept for r in found if r.good])
    assert right > 0.98 and clean > 0.99


def test_em_finds_rates():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.8
    votes = np.full((len(y), 7), quality.NONE)
    for j in range(5):
        votes[(~y) & (rng.random(len(y)) < 0.5), j] = quality.BAD
    for j in quality.MERITS:
        right = rng.random(len(y)) < 0.9
        votes[:, j] = np.where(right == y, quality.GOOD, quality.BAD)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    share, logs = quality.fit_labellers([(tuple(map(int, r)), int(c)) for r, c in zip(rows, counts)])
    assert abs(share - 0.8) < 0.02 and abs(np.exp(logs[0, 0, quality.BAD]) - 0.5) < 0.05 and abs(np.exp(logs[1, 5, quality.GOOD]) - 0.9) < 0.03


def test_odd_rows(odd_docs, no_docs):
    rows = quality.classified(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality_score <= 1 and r.kept is not None for r in rows)
    assert quality.classified(no_docs).count() == 0
    twins = [r.quality_score for r in rows if r.doc_id == 111]
    assert len(twins) == 3 and len(set(twins)) == 1


def slow_em(votes, rounds=100):
    """EM document by document, in plain probabilities. Votes of MERITS count only where they are given."""
    k = len(quality.LABELLERS)
    rates = {c: [list(r) for _ in range(k)] for c, r in ((0, (0.5, 0.1, 0.4)), (1, (0.02, 0.5, 0.48)))}
    share = 0.8

    def chance(v, c):
        out = 1.0
        for j, x in enumerate(v):
            if j not in quality.MERITS:
                out *= rates[c][j][x]
            elif x != quality.NONE:
                out *= rates[c][j][x] / (rates[c][j][0] + rates[c][j][1])
        return out

    def posts():
        return [share * chance(v, 1) / (share * chance(v, 1) + (1 - share) * chance(v, 0)) for v in votes]

    for _ in range(rounds):
        post = posts()
        before, share = share, min(0.98, max(0.02, sum(post) / len(post)))
        for c in (0, 1):
            for j in range(k):
                seen = [0.5, 0.5, 0.5]
                for v, p in zip(votes, post):
                    seen[v[j]] += p if c else 1 - p
                rates[c][j] = [x / sum(seen) for x in seen]
        if abs(share - before) < 1e-7:
            break
    return share, posts()


def test_em_against_brute_force(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([1, 5, 30, 90])) for _ in range(150)] + [junk(rng, k) for k in ("symbols", "shout", "table", "runs") for _ in range(8)]
    texts += [None, "", "\n\n", texts[0], texts[0]]
    want_share, want = slow_em([quality.votes(quality.measures(t)) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.label_posterior for r in quality.classified(df).collect()}
    assert all(abs(got[k] - p) < 1e-6 for k, p in enumerate(want))
    assert abs(quality.fit(df)[0] - want_share) < 1e-6


def test_scorer_learns_from_the_text_alone(spark):
    """Held out: the scorer agrees with the labellers on texts that it was not fitted to, and words change its score."""
    rng = random.Random(5)
    kinds = ("symbols", "shout", "table", "runs")
    rows = [(k, prose(rng, rng.choice([10, 40, 200])) if k % 3 else junk(rng, kinds[k // 3 % 4])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share, logs, w = quality.fit(df, 200)
    z = np.array([quality.features(t) @ w[:-1] + w[-1] for _, t in rows])
    assert np.mean((z >= 0) == [k % 3 > 0 for k, _ in rows]) > 0.97
    assert len(w) == quality.DIMS + 1 and (quality.features("ab cd") != quality.features("ab ce")).any()


def test_a_row_that_fills_the_table(spark):
    """Repeats count once in the fit, so that they crowd nothing out of it."""
    rng = random.Random(6)
    rows = [(1, "The same row, again and again.")] * 3000 + [(10 + k, prose(rng, 60)) for k in range(60)] + [(500 + k, junk(rng, "table")) for k in range(30)]
    found = quality.classified(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    assert len(found) == len(rows) and all(r.kept == (r.doc_id < 500) for r in found)
