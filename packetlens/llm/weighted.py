"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles, their weights how often they occur. For sample k every term has r and c from Gamma(2, 1)
and b from the unit interval, drawn from its hash. With t = floor(ln(weight) / r + b) and y = exp(r * (t - b)), the
term of smallest ln(c) - ln(y) - r is the sample, together with its t: two documents give the same one with a
probability equal to the generalised Jaccard similarity of their weighted terms.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES, WORDS = 128, 5
_DRAWS = 1 << 16
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln(c) and b by number of draw. A term's hash and the sample's number choose the draw."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
    return r, c, rng.random(_DRAWS).astype(np.float32)


@functools.lru_cache(maxsize=4)
def multipliers(samples: int) -> np.ndarray:
    return mix(np.arange(1, samples + 1, dtype=np.uint64) * _M1) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    p = 0x2545F4914F6CDD1D
    inverse = pow(p, -1, 1 << 64)
    out = []
    for base in (p, inverse):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes, block: int = 1 << 18) -> np.ndarray:
    """A hash for each word of ``data``, by prefix sums of a polynomial over its bytes; blocks end between words."""
    at, out = 0, []
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        x = np.frombuffer(data[at:end], dtype=np.uint8)
        space = np.ones(len(x) + 2, dtype=bool)
        space[1:-1] = _SPACE[x]
        edge = np.diff(space.astype(np.int8))
        starts, stops = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        if len(starts):
            p, inverse = powers(max(block + 64, len(x) + 1) if len(x) <= block + 64 else 1 << int(len(x)).bit_length())
            sums = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p[: len(x)], out=sums[1:])
            h = (sums[stops] - sums[starts]) * inverse[starts]
            out.append(mix(h + (stops - starts).astype(np.uint64) * _M1))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def terms(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's word shingles and how often each occurs. Fewer words: one term of all of them."""
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return w, np.zeros(0, dtype=np.int64)
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(w))):
        h = h * _M1 + w[k : k + n]
    return np.unique(mix(h), return_counts=True)


def samples_of(text: str | None, samples: int = SAMPLES, words: int = WORDS, block: int = 2048) -> np.ndarray:
    """The text's samples, as 16-bit hashes of (term, t); all zero if it has no word."""
    h, n = terms(text or "", words)
    if not len(h):
        return np.zeros(samples, dtype=np.uint16)
    r, c, b = draws()
    odd = multipliers(samples)
    best = np.full(samples, np.inf, dtype=np.float32)
    won = np.zeros(samples, dtype=np.uint64)
    once = n == 1
    k = np.arange(samples)
    for single in (True, False):
        hs, logs = h[once == single], np.log(n[once == single]).astype(np.float32)
        for at in range(0, len(hs), block):
            own = hs[at : at + block]
            draw = ((own[:, None] * odd[None, :]) >> np.uint64(48)).astype(np.intp)
            if single:
                value, t = unit()[draw], None
            else:
                t = np.floor(logs[at : at + block, None] / r[draw] + b[draw])
                value = c[draw] - r[draw] * (t - b[draw]) - r[draw]
            first = value.argmin(axis=0)
            low = value[first, k]
            name = own[first] + (np.uint64(0) if t is None else t[first, k].astype(np.uint64)) * _M2
            better = (low < best) | ((low == best) & (name < won))
            best, won = np.where(better, low, best), np.where(better, name, won)
    return (mix(won + k.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


@functools.lru_cache(maxsize=1)
def unit() -> np.ndarray:
    """The value of each draw for a term of weight one: ln(weight) and so t are 0."""
    r, c, b = draws()
    return c + r * b - r


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; a fingerprint without terms is like another such only."""
    return float((a == b).mean()) if a.any() == b.any() else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_KEY = np.dtype([("given", "i1"), ("id", "i8"), ("part", "f8")])


def _bounds(rows: DataFrame, parts: int) -> tuple[np.ndarray, list[int | None]]:
    """Sorted (id given, id, place of the text's hash) that cut the table in about ``parts`` ranges of about equal row
    counts, and the ids, None for null, that fill more than one: those are cut by the hashes of their texts."""
    found = rows.agg(
        F.percentile_approx("doc_id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 20 * parts).alias("q"),
        F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    cuts = [(0, 0, k * found.n / (parts * found.nulls)) for k in range(1, parts) if k * found.n < parts * found.nulls]
    cuts += [(1, np.iinfo(np.int64).min, 0.0)] if found.nulls else []
    hot: list[int | None] = [None] if len(cuts) > 1 else []
    times = Counter(found.q or [])
    for x in sorted(times):
        cuts += [(1, x, k / times[x]) for k in range(times[x])]
        hot += [x] if times[x] > 1 else []
    return np.array(sorted(set(cuts)), dtype=_KEY), hot


def followed(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, h, text, n, range, ghost): rows dealt by ranges of (doc_id, hash of the text), each range ended by a
    ghost of its follower.

    One shuffle of the texts: a range's first row is also sent to the range before it, as the next document of that
    range's last row. The first row of all is sent to the last range. Rows of an id that fills whole ranges are cut by
    the hashes of their texts; of those that are equal even so one is sent, with their number n.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts, hot = _bounds(rows, parts)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.lit(1).cast("long"))
    if hot:
        busy = F.col("doc_id").isin([x for x in hot if x is not None])
        busy = F.coalesce(busy, F.lit(None in hot))
        merged = rows.where(busy).groupBy("doc_id", "h", "text").agg(F.count("*").alias("n"))
        rows = rows.where(~busy).unionByName(merged)

    def ranged(ids: pd.Series, h: pd.Series) -> np.ndarray:
        key = np.zeros(len(ids), dtype=_KEY)
        key["given"], key["id"] = ids.notna(), ids.fillna(0).to_numpy(dtype=np.int64)
        key["part"] = h.to_numpy() / 2.0**64 + 0.5
        return np.searchsorted(cuts, key, side="right")

    @F.pandas_udf("int")
    def place(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranged(ids.astype("Int64"), h), dtype="int32")

    # the least row of each range, by (id, hash, text's digest): one row a range, so bounded
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "h"))
    firsts = rows.select("doc_id", "h", place("doc_id", "h").alias("range")).groupBy("range").agg(least.alias("x")).orderBy("range").collect()
    places = [r.range for r in firsts]
    before = dict(zip(places, places[-1:] + places[:-1]))
    # of rows that share a first key the one with the smallest text is the follower; the reader takes the first ghost
    ghosts = {(r.x.doc_id, r.x.h): before[r.range] for r in firsts}

    @F.pandas_udf("array<struct<range: int, ghost: int>>")
    def sent(ids: pd.Series, h: pd.Series) -> pd.Series:
        ids = ids.astype("Int64")
        own = ranged(ids, h)
        to = [ghosts.get((None if x is pd.NA else int(x), int(y))) for x, y in zip(ids, h)]
        return pd.Series([[(int(a), 0)] if b is None else [(int(a), 0), (b, 1)] for a, b in zip(own, to)], dtype=object)

    return rows.withColumn("sent", F.explode(sent("doc_id", "h"))).select("sent.range", "sent.ghost", "doc_id", "h", "text", "n")


def fingerprinted(docs: DataFrame, parts: int | None = None, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are the samples' hashes in hex. The next document is that of the next doc_id (nulls first, equal ids
    by XXH64 of their texts, seed 42, then by text), the first one after the last; a table of one row is its own next. Null texts count as empty. Empty
    texts have the zero fingerprint, like that of other empty texts only. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    cols = [c.split()[0] for c in schema.split(", ")]

    def row(doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
        new = edited(text, following)
        changed = samples_of(new, samples, words)
        return (
            doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u2").tobytes().hex(),
            changed.astype(">u2").tobytes().hex(), likeness(own, changed), likeness(own, its),
        )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ended = None, False

        def framed(out: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=cols)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in batches:
            out = []
            ids = batch["doc_id"].astype("Int64").astype(object)
            for place, ghost, doc_id, text, n in zip(batch["range"], batch["ghost"], ids, batch["text"], batch["n"]):
                own = samples_of(text, samples, words)
                if last is not None and last[0] == place and not ended:
                    out.append(row(*last[1:], text, own))
                if last is None or last[0] != place:
                    ended = False
                ended = ended or bool(ghost)
                doc_id = None if doc_id is pd.NA else doc_id
                last = (place, doc_id, text, own)
                if n > 1 and not ghost:  # each but the last is followed by its equal
                    alike = row(doc_id, text, own, text, own)
                    for k in range(0, n - 1, 1000):
                        yield framed([alike] * min(1000, n - 1 - k))
            yield framed(out)

    dealt = followed(docs, parts).repartition("range").sortWithinPartitions("range", "ghost", "doc_id", "h", "text")
    return dealt.mapInPandas(stream, schema)
