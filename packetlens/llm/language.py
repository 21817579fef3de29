"""Language identification by a mixture of languages, fitted to each document by EM.

Training counts hashed byte n-grams of one to four letters per language. A document's n-grams come from a mixture of
languages: expectation-maximisation finds the proportions. Languages are then dropped one by one, the least first,
as long as the likelihood, penalised by half the log of the n-gram count for each language kept, does not fall.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 15
#: Rows of each language that the model is fitted to, about: those with the smallest hashes of their ids and texts.
FIT_ROWS = 400
#: N-grams beyond which a document weighs no more in the fit, the unit that counts are rounded to, and how many n-grams
#: of all languages together are added to each.
LONG, UNIT, SMOOTH = 20_000, 4096, 200.0
#: Rows of the fit whose counts one task adds up.
TASK_ROWS = 400
ROUNDS = 12
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that are never trained on: crc32 of the id as text leaves 2 modulo 4. Null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _table() -> np.ndarray:
    """Byte classes: letters lower-cased, bytes beyond ASCII as they are, everything else a space."""
    t = np.full(256, 32, dtype=np.int64)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_BYTES = _table()


def grams(text: str | None, block: int = 1 << 18) -> np.ndarray:
    """Counts of hashed n-grams (1 to 4 bytes, lower case, signs as spaces) over the whole text, in blocks."""
    data = b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" "
    out = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(data), block):
        c = _BYTES[np.frombuffer(data[at : at + block + 3], dtype=np.uint8)]
        code = np.zeros(len(c), dtype=np.int64)
        for k in range(4):
            code = code[: len(c) - k] * 257 + c[k:] + 1
            n = min(len(code), block)
            solid = code[:n][(c[:n] != 32) | (k > 0)]
            out += np.bincount(((solid + k) * 0x9E3779B1 >> 11) & (DIMS - 1), minlength=DIMS)
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and smoothed log probabilities [gram, language].

    Only text and lang of rows that are not held out are used; about ``fit_rows`` rows a language, equal rows (id and
    text) once. A document weighs as much as its n-grams, but none more than one of LONG n-grams. The executors add
    the counts up, in whole numbers, so that the sums are the same in every run.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a threshold of hashes for each language, from its exact count, so that no group is gathered
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((DIMS, 0))
    span = 1 << 20
    limit = F.lit(-1)
    for x in langs:
        limit = F.when(F.col("lang") == x, min(span, int(span * fit_rows / sizes[x]))).otherwise(limit)
    sample = labelled.select("lang", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("h")).where(F.pmod("h", F.lit(span)) < limit)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(t)
                sums[x] = sums.get(x, 0) + np.rint(g * (UNIT * min(1.0, LONG / max(1, g.sum())))).astype(np.int64)
        for x, v in sums.items():
            at = np.nonzero(v)[0]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "gram", "n"])

    # every task has its own counts, so there are as many tasks as the sample fills, however many partitions it comes in
    tasks = max(1, -(-sum(min(n, fit_rows) for n in sizes.values()) // TASK_ROWS))
    seen = sample.dropDuplicates(["lang", "h"]).select("lang", "text").coalesce(tasks).mapInArrow(count, "lang string, gram int, n long")
    found = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # the model's own size at most
    counts = np.zeros((DIMS, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    counts[found["gram"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy() / UNIT
    # what all languages share smooths each one
    whole = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * DIMS)
    p = (counts + SMOOTH * whole[:, None]) / (counts.sum(axis=0) + SMOOTH)
    return langs, np.log(p)


def mixture(n: np.ndarray, p: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the proportions of the languages in columns of ``p``, from ``share`` on; with the log likelihood."""
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * (p.T @ (n / mixed)) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(n @ np.log(p @ share))


def identified_one(counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the languages in the document, and their proportions."""
    at = np.nonzero(counts)[0]
    n, q = counts[at].astype(float), p[at]
    # grams overlap: one byte is in four of them, so a quarter counts as evidence
    n = n / 4
    chosen = np.arange(p.shape[1])
    share, fit_ = mixture(n, q, np.full(len(chosen), 1 / len(chosen)))
    penalty = 0.5 * np.log(max(2.0, n.sum()))
    while len(chosen) > 1:
        keep = np.arange(len(chosen)) != share.argmin()
        left = share[keep] / max(share[keep].sum(), 1e-12)
        fewer, its = mixture(n, q[:, chosen[keep]], left)
        if its + penalty < fit_:
            break
        chosen, share, fit_ = chosen[keep], fewer, its
    return chosen, share


def identified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages ("de:0.93 en:0.07") of every row.

    score is the proportion of the predicted language. `und` with score 0 if the text is null or has no letter, or
    nothing could be learned. Ties go to the first language by name. lang, source and doc_id never reach a
    prediction; rows without an id or a lang are predicted, not learned from.
    """
    langs, logs = fit(docs, fit_rows)
    p = np.exp(logs)

    @F.pandas_udf("lang_pred string, score double, languages string")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not text or not langs or not any(map(str.isalpha, text)):
                rows.append((UNKNOWN, 0.0, ""))
                continue
            chosen, share = identified_one(grams(text), p)
            best = int(share.argmax())
            named = sorted(zip(-share, chosen))
            rows.append((langs[chosen[best]], min(1.0, float(share[best])), " ".join(f"{langs[c]}:{-s:.2f}" for s, c in named)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.*")
