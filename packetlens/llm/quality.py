"""Weak-label quality classifier: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Seven labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns
(at most 3^7, whatever the number of documents) estimates each labeller's rates under both classes and the classes'
shares. The posterior of a document's votes is its label; a logistic scorer over hashed n-grams of words, bytes and
character classes, none of the labellers' measures among them, is fitted to the posteriors of a bounded sample and
scores every whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import durable
from packetlens.llm.weighted import word_hashes

LABELLERS = ("symbols", "shouting", "tables", "word_runs", "line_repeats", "clean_words", "running_text")
GOOD, BAD, NONE = 1, 0, 2
#: Labellers that vote both ways. Where they don't vote they say nothing; of the others, silence speaks for a text.
MERITS = (5, 6)
#: Rows whose posteriors the scorer is fitted to, the ones with the smallest hashes of their ids and texts.
FIT_ROWS = 3000
#: Parts of the feature vector: n-grams of character classes, n-grams of bytes, words and how often they occur.
SHAPES, LETTERS, TERMS = 1 << 10, 1 << 11, 1 << 10
DIMS = SHAPES + LETTERS + TERMS
#: N-grams that every text is taken to have besides its own, of no kind: a short one says little.
FEW = 20.0

_CLASS = np.full(256, 3, dtype=np.int64)  # 3: other punctuation
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(128, 256))] = 0  # parts of letters beyond ASCII, mostly
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[44, 46]] = 6
_CLASS[ord("!")] = 7
_CLASS[[ord(c) for c in "#$%&*"]] = 8
_CLASS[ord("|")] = 9
_N = 10
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def measures(text: str | None) -> dict[str, float]:
    """Counts that the labellers look at, over the whole text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return {"n": 0}
    shapes = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:]))
    return {
        "n": n,
        "symbols": sum(w[-1] in "#$%&*" and len(w) > 3 and w[-3:] == w[-1] * 3 for w in words) / n,
        "upper": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "pipes": shapes["|"] / n,
        "runs": runs / max(1, n - 1),
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "lower": sum(w.islower() or w.istitle() for w in words) / n,
        "clean": sum(w.rstrip(".,;:?").isalpha() for w in words) / n,
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote for each of LABELLERS. A text without words gets no vote but a bad one for its lack of prose."""
    if not m["n"]:
        return (NONE,) * (len(LABELLERS) - 1) + (BAD,)

    def flaw(x: float, bad: float, at_least: int = 8) -> int:
        return BAD if x >= bad and m["n"] >= at_least else NONE

    def merit(x: float, bad: float, good: float) -> int:
        return BAD if x <= bad and m["n"] >= 20 else GOOD if x >= good else NONE

    return (
        flaw(m["symbols"], 0.25, 4),
        flaw(m["upper"], 0.4),
        flaw(m["pipes"], 0.2, 4),
        flaw(m["runs"], 0.3),
        flaw(m["lines"], 0.7),
        merit(m["clean"], 0.6, 0.8),
        merit(m["lower"] - 2 * m["runs"], 0.6, 0.8),
    )


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM over vote patterns and their counts: the share of good, and log rates [class, labeller, vote].

    Starts from labellers that rarely call a good text bad; pseudo-counts keep every rate above zero. Without any
    pattern the start is returned.
    """
    k = len(LABELLERS)
    rates = np.empty((2, k, 3))
    rates[0], rates[1] = [0.5, 0.1, 0.4], [0.02, 0.5, 0.48]
    share = 0.8
    if patterns:
        v = np.array([p for p, _ in patterns])
        n = np.array([c for _, c in patterns], dtype=float)
        for _ in range(rounds):
            post = posterior(v, share, weighed(rates))
            before, share = share, float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
            for c, w in ((1, n * post), (0, n * (1 - post))):
                for j in range(k):
                    rates[c, j] = np.bincount(v[:, j], weights=w, minlength=3) + 0.5
                rates[c] /= rates[c].sum(axis=1, keepdims=True)
            if abs(share - before) < 1e-7:
                break
    return share, weighed(rates)


def weighed(rates: np.ndarray) -> np.ndarray:
    """Log rates; those of MERITS are of the votes given."""
    logs = np.log(rates)
    for j in MERITS:
        logs[:, j] -= np.log(rates[:, j, :2].sum(axis=1, keepdims=True))
        logs[:, j, NONE] = 0.0
    return logs


def posterior(v: np.ndarray, share: float, logs: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes."""
    j = np.arange(v.shape[1])
    good = np.log(share) + logs[1, j, v].sum(axis=1)
    bad = np.log(1 - share) + logs[0, j, v].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def features(text: str | None, block: int = 1 << 20) -> np.ndarray:
    """Hashed shares of the whole text's n-grams, read in blocks: of character classes (4), of bytes (3), of words (1).

    A word also counts under how often it occurs in the text, in powers of two of its share, whatever the word is. Each
    kind has its own part of the vector; what the labellers measure is not among them.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    classes, letters, terms = np.zeros(SHAPES), np.zeros(LETTERS), np.zeros(TERMS)
    for at in range(0, max(1, len(data) - 3), block):
        x = np.frombuffer(data[at : at + block + 3], dtype=np.uint8)
        if len(x) > 3:
            c = _CLASS[x]
            code = ((c[:-3] * _N + c[1:-2]) * _N + c[2:-1]) * _N + c[3:]
            classes += np.bincount((code * 2654435761 >> 7) % SHAPES, minlength=SHAPES)
            y = _LOWER[x]
            code = (y[:-3] << 16) | (y[1:-2] << 8) | y[2:-1]
            letters += np.bincount((code * 2654435761 >> 9) % LETTERS, minlength=LETTERS)
    words, n = np.unique(word_hashes(data.lower()), return_counts=True)
    if len(words):
        often = np.minimum(31, np.log2(n.sum() / n).astype(np.int64) * 2 + (n > 1))
        place = np.concatenate([(words >> np.uint64(20)).astype(np.int64) % (TERMS - 32) + 32, often])
        terms += np.bincount(place, weights=np.concatenate([n, n]), minlength=TERMS)
    return np.concatenate([np.sqrt(v / (v.sum() + FEW)) for v in (classes, letters, terms)])


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last one is the constant) by accelerated gradient steps on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]) if len(x) else np.zeros((0, DIMS + 1))
    w = look = np.zeros(DIMS + 1)
    # each class weighs the same in all, so that rare bad texts count
    good, bad = max(1e-9, y.sum()), max(1e-9, (1 - y).sum())
    scale = y / (2 * good) + (1 - y) / (2 * bad)
    rate, t = 4.0 / max(1e-9, np.einsum("ij,ij->i", x, x).max() if len(x) else 1.0), 1.0
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ look.astype(x.dtype), -30, 30)))
        new = look - rate * ((scale * (p - y)).astype(x.dtype) @ x + decay * look)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share, labeller log rates and scorer weights. Patterns are counted over all documents."""
    k = len(LABELLERS)

    @F.pandas_udf("int")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(v * 3**i for i, v in enumerate(votes(measures(t)))) for t in texts], dtype="int32")

    seen = durable(docs.select(F.xxhash64("doc_id", "text").alias("h"), pattern("text").alias("p")))
    digits = lambda p: tuple(p // 3**i % 3 for i in range(k))
    counts = [(digits(r.p), r.n) for r in seen.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()]
    share, logs = fit_labellers(counts)

    # The sample: the smallest hashes, half from patterns that look bad so that both classes are in it; equal rows
    # have one hash and count once, so that what is collected is bounded.
    post = {p: q for (p, _), q in zip(counts, posterior(np.array([p for p, _ in counts]), share, logs))} if counts else {}
    bad = [sum(v * 3**i for i, v in enumerate(p)) for p, q in post.items() if q < 0.5]
    chosen = None
    for part in (F.col("p").isin(bad) if bad else F.lit(False), ~F.col("p").isin(bad) if bad else F.lit(True)):
        part = seen.where(part).select("h").distinct().orderBy("h").limit(fit_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)

    @F.pandas_udf("struct<x: binary, p: array<int>>")
    def featured(texts: pd.Series) -> pd.DataFrame:
        ms = [measures(t) for t in texts]
        return pd.DataFrame({"x": [features(t).astype("<f2").tobytes() for t in texts], "p": [list(votes(m)) for m in ms]})

    hashes = F.broadcast(chosen)  # at most fit_rows longs
    rows = (
        docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").join(hashes, "h", "left_semi").dropDuplicates(["h"])
        .select("h", featured("text").alias("f")).select("h", "f.x", "f.p").collect()  # one row a hash
    )
    rows.sort(key=lambda r: r.h)
    x = np.frombuffer(b"".join(r.x for r in rows), dtype="<f2").astype("f4").reshape(-1, DIMS)
    y = posterior(np.array([r.p for r in rows]), share, logs) if rows else np.zeros(0)
    w = fit_scorer(x, y)
    w[-1] += np.log(share / (1 - share))  # both classes weigh the same in the fit, but not in the corpus
    return share, logs, w


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with label_posterior (of the votes) and quality_score (of the scorer), by what ``fit`` found."""
    share, logs, w = model

    @F.pandas_udf("label_posterior double, quality_score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        ms = [measures(t) for t in texts]
        post = posterior(np.array([votes(m) for m in ms]), share, logs) if len(ms) else np.zeros(0)
        z = np.array([features(t) @ w[:-1] + w[-1] for t in texts], dtype=float)
        return pd.DataFrame({"label_posterior": post, "quality_score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    own = [c for c in docs.columns if c not in ("label_posterior", "quality_score", "kept")]
    return docs.select(*own, score("text").alias("scored text")).select(*own, "`scored text`.*")


def classified(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5, model: tuple[float, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with label_posterior (of the votes), quality_score (of the scorer) and kept (score >= threshold).

    ``model``: what ``fit`` found, if it is to be used again; else it is fitted to ``docs``.
    Null and empty texts have no words: the one vote they get is bad, and they are scored like any other. An empty
    table gives no rows. Repeated rows get equal scores. Columns of ``docs`` with one of the new names are replaced.
    """
    return scored(docs, model or fit(docs, fit_rows)).withColumn("kept", F.col("quality_score") >= F.lit(threshold))
