"""Byte-level BPE by a vocabulary of ranks: overlapping chunks, stitched pre-tokens, pieces, and the way back.

A text is pre-tokenised in chunks that overlap: each chunk's matches begin a stretch before its own part and end a
stretch after it. Wherever the matches of two neighbours share a boundary inside the overlap, the pattern is in the
same state in both, so what follows is the same: the pieces of the one are taken up to that boundary and of the other
from there. Where an overlap holds no common boundary (one run of letters fills it), it is doubled. Chunks do not
depend on one another: they are matched in any order, and the pieces of a long text never are all in memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 16, 256
#: Code points beyond which a text's chunks are dealt to several tasks, and how many each gets.
LONG, PART = 1 << 21, 1 << 18
#: Pieces whose ids a worker keeps; beyond it the table starts anew.
CACHE = 400_000
SCHEMA = "n_tokens long, n_bytes long, ids binary, ids_sha256 string, decoded_sha256 string"


def boundaries(pattern: regex.Pattern, text: str, lo: int, hi: int) -> list[int]:
    """Starts of the matches of ``text[lo:hi]``, and its end. Every code point must be in a match."""
    at = [m.start() + lo for m in pattern.finditer(text[lo:hi])]
    return [*at, hi]


def stitched(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """Lists of the pieces of ``text``, one for each chunk; together equal to ``pattern.findall(text)``."""
    n = len(text)
    if n <= chunk + 2 * overlap:
        yield pattern.findall(text)
        return
    ours, begin = boundaries(pattern, text, 0, min(n, chunk + overlap)), 0
    for edge in range(chunk, n, chunk):
        wide = overlap
        while True:
            lo, hi = max(begin, edge - wide), min(n, edge + wide)
            if wide > overlap:
                ours = boundaries(pattern, text, begin, hi)
            theirs = boundaries(pattern, text, lo, min(n, edge + chunk + overlap))
            # a match at the very end or start of a slice is not final: lookahead and context are cut there
            inner = set(ours[:-2]) & set(theirs[1:-2]) if hi < n else set(ours) & set(theirs[1:])
            if meet := min((x for x in inner if lo < x <= hi), default=None):
                break
            if lo == begin and hi == n:
                return_to = boundaries(pattern, text, begin, n)
                yield [text[a:b] for a, b in zip(return_to, return_to[1:])]
                return
            wide *= 2
        cut = ours[bisect_left(ours, begin) : bisect_left(ours, meet) + 1]
        yield [text[a:b] for a, b in zip(cut, cut[1:])]
        ours, begin = theirs, meet
        if theirs[-1] >= n and edge + chunk >= n:
            break
    cut = ours[bisect_left(ours, begin) :]
    yield [text[a:b] for a, b in zip(cut, cut[1:])]


class Codec(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers, filled as pieces come."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        # the pieces are made here; the library's own pattern takes each of them whole
        self.core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.token: dict[int, bytes] = {i: b for b, i in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(self.core.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return b"".join(b"".join([self[p] for p in pieces]) for pieces in stitched(self.pattern, text, chunk, overlap))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def located(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    """Defaults of a worker: the file by name from the installed tokenizer files, and their pattern."""
    import public_tokenizers

    name = vocabulary or "byte_bpe_50k.tiktoken"
    return (name if "/" in name else public_tokenizers.path(name)), pattern or public_tokenizers.PATTERN


def measured(c: Codec, ids: bytes, keep_ids: bool) -> tuple:
    """The columns of SCHEMA for a text's ids."""
    back = c.decode(ids)
    return len(ids) // 4, len(back), ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _long(docs: DataFrame, key: list[str], chunk: int, overlap: int, vocabulary: str | None, pattern: str | None, keep_ids: bool) -> DataFrame:
    """``key`` and SCHEMA of texts by chunks that are pre-tokenised in as many tasks, then stitched and encoded by text."""
    at, n = F.col("at"), F.length("text")
    low = F.greatest(at - overlap, F.lit(0))
    chunks = (
        docs.dropDuplicates(key).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))))
        .select(*key, low.alias("low"), n.alias("n"), F.substring("text", low + 1, at - low + chunk + overlap).alias("slice"))
        .repartition(*key, "low")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(*located(vocabulary, pattern))
        for b in batches:
            yield b.assign(bounds=[np.array(boundaries(c.pattern, x, 0, len(x)), dtype="<i4").tobytes() for x in b["slice"]])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(*located(vocabulary, pattern))
        now, ids, text, start, ours = None, [], "", 0, []  # ours: boundaries from a true one on, in text, which begins at start

        def take(to: int | None) -> None:
            places = ours[: bisect_left(ours, to) + 1] if to is not None else ours
            ids.append(b"".join([c[text[a - start : b - start]] for a, b in zip(places, places[1:])]))

        def ended() -> pd.DataFrame:
            take(None)
            return pd.DataFrame([(*now, *measured(c, b"".join(ids), keep_ids))], columns=[*key, *NAMES])

        for batch in batches:
            for r in batch.itertuples(index=False):
                own, theirs = tuple(getattr(r, k) for k in key), (np.frombuffer(r.bounds, dtype="<i4") + r.low).tolist()
                if own != now:
                    if now is not None:
                        yield ended()
                    now, ids, text, start, ours = own, [], r.slice, r.low, theirs
                    continue
                # what a slice ends with is not final: the pattern looks ahead
                if meet := min(set(ours[:-2]) & set(theirs[:-2] if r.low + len(r.slice) < r.n else theirs), default=None):
                    take(meet)
                    text, start, ours = r.slice, r.low, theirs[bisect_left(theirs, meet) :]
                else:
                    text, start = text[ours[0] - start :] + r.slice[start + len(text) - r.low :], ours[0]
                    ours = [x + start for x in boundaries(c.pattern, text, 0, len(text))]
        if now is not None:
            yield ended()

    kinds = ", ".join(f"{k} long" for k in key)
    cuts = chunks.mapInPandas(cut, f"{kinds}, low int, n int, slice string, bounds binary")
    return cuts.repartition(*key).sortWithinPartitions(*key, "low").mapInPandas(join, f"{kinds}, {SCHEMA}")


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = True, long: int = LONG, chunk: int = PART, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with n_tokens, n_bytes, ids (binary, little-endian u32; null without ``keep_ids``) and digests.

    Texts of up to ``long`` code points are encoded where they are, without a shuffle. Longer ones are dealt out by
    chunks, so that one does not hold up a task, equal texts once; they are told apart by two hashes. Null and empty texts
    have no tokens and the digest of no bytes. The decoded digest is of the bytes that the ids give back. Repeated
    rows repeat. Columns of ``docs`` that share a name with a new one are replaced.
    """

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(*located(vocabulary, pattern))
        return pd.DataFrame([measured(c, c.encode(t) if t else b"", keep_ids) for t in texts], columns=NAMES)

    kept = [c for c in docs.columns if c not in NAMES]
    large = F.coalesce(F.length("text") > long, F.lit(False))
    near = docs.where(~large).select(*kept, run(F.col("text")).alias("encoded ids")).select(*kept, "`encoded ids`.*")
    hashes = [F.xxhash64("text", F.lit(k)).alias(f"text hash {k}") for k in (1, 2)]
    apart = docs.where(large).select(*kept, *hashes)
    key = ["h1", "h2"]
    texts = apart.select("text", *(F.col(f"text hash {k}").alias(f"h{k}") for k in (1, 2)))
    parts = _long(texts, key, chunk, overlap, vocabulary, pattern, keep_ids)
    far = apart.join(parts, (F.col("text hash 1") == F.col("h1")) & (F.col("text hash 2") == F.col("h2"))).select(*kept, *NAMES)
    return near.unionByName(far)


def decoded(ids: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``ids`` (with a binary column ids) with the column bytes: the raw bytes of the tokens, joined. Null: null."""
    @F.pandas_udf("binary")
    def back(col: pd.Series) -> pd.Series:
        c = codec(*located(vocabulary, pattern))
        return pd.Series([None if x is None else c.decode(x) for x in col], dtype=object)

    return ids.withColumn("bytes", back("ids"))
