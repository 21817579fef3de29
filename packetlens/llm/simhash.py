"""SimHash near-duplicates: fingerprints by majority of shingle hashes, candidates by a pigeonring of segments.

The bytes of a fingerprint are the segments of a ring. If two fingerprints of m segments differ in at most t bits,
some segment starts a chain in which every l consecutive segments together differ in at most l * t / m bits. For 64
bits and 3 differences that means: two segments alike, and of the next three at most one that differs. So each
fingerprint is filed under 8 starts x 3 segments that may differ = 24 keys of 32 bits, and no link is lost. Candidates
that share a key must hold the chain's other budgets before the full Hamming check: some start's chain does.

``similar`` (the pipeline) asks for a Jaccard similarity of the sets of shingles, 0.8 or more. There a fingerprint has
1,024 bits, each distinct shingle counts once, and two such sets differ in some 155 bits. A ring of 256 segments of 4
bits then promises chains that are too common to be looked up, so keys ask for more than the budget: a chain whose
first bits, as many as the number of documents calls for, are alike. Several rings, which visit the segments by
different steps, give so many starts that a pair at 0.8 shares one but for one in fifty. The chain's next 16 segments
travel with the key and must hold the budgets; what is left is decided by all bits and then by both whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import components, durable, grouped, in_blocks, spanning

#: Rows of a bucket that one task compares at once.
BLOCK = 512
#: Smallest members that each class is compared with at first.
NEAREST = 3
#: Fingerprints of shingle sets: bits, and segments of 4 bits.
WIDE, SEGMENTS = 1024, 256
#: Differing bits up to which two sets are compared, and of which chains hold their shares: similarity 0.8 gives 155, 12
#: either way. Sets of four and of five shingles differ in 192, so pairs of fewer than FEW are compared up to MOST.
NEAR, MOST = 194, 230
#: Share of bits in which sets of similarity 0.8 differ, and of such pairs those that may share no key.
DIFFERENT, MISSED = 0.1515, 0.02
#: Segments of a chain that follow its key.
FOLLOW = 16
#: Sets of fewer shingles, whose fingerprints differ more, are filed under twice as many keys.
FEW = 40
#: Rows of a bucket that one task compares at once by their sets.
SETS = 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)

def shingle_hashes(text: str | None, words: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of the lower-cased text, as 8-byte rows, in blocks of bounded size."""
    digest = functools.partial(xxhash.xxh64_digest, seed=42)
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, rest, total = 0, [], 0
    while at < len(data):
        end = at + block
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        w = rest + data[at:end].split()
        at, n = end, len(w) - words + 1
        if n > 0:
            hashed = b"".join(map(digest, map(b" ".join, zip(*(w[i : n + i] for i in range(words))))))
            total += n
            yield np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8)
        rest = w[len(w) - words + 1 :] if n > 0 else w
    if not total and rest:
        yield np.frombuffer(digest(b" ".join(rest)), dtype=np.uint8).reshape(-1, 8)


def widened(h: np.ndarray, lanes: int) -> np.ndarray:
    """8-byte hashes as rows of ``lanes`` times 8 bytes: the hash itself, then mixes of it."""
    if lanes == 1:
        return h
    x = h.view(">u8").astype(np.uint64).reshape(-1, 1)
    out = x + np.arange(lanes, dtype=np.uint64)[None, :] * _ODD[0]
    out = (out ^ (out >> np.uint64(30))) * _ODD[1]
    out = (out ^ (out >> np.uint64(27))) * _ODD[2]
    out ^= out >> np.uint64(31)
    out[:, :1] = x
    return out.astype(">u8").view(np.uint8).reshape(len(h), -1)


def majority(blocks: Iterator[np.ndarray], bits: int) -> bytes:
    """A bit is 1 if it is set in over half of the hashes (8-byte rows, in blocks). No hash: all zero."""
    width, ones, n = bits // 8, np.zeros(bits, dtype=np.int64), 0
    for h in blocks:
        for part in np.array_split(h, max(1, len(h) * width >> 22)) if len(h) else ():
            part, n = widened(part, bits // 64), n + len(part)
            if len(part) < 48:
                ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            else:
                ones += np.concatenate([np.bincount(part[:, k], minlength=256) @ _BITS for k in range(width)])
    return np.packbits(2 * ones > n).tobytes() if n else bytes(width)


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """Majority of the text's shingle hashes, repeats counted."""
    return majority(shingle_hashes(text, words), bits)


def fingerprint_column(text: Column | str, words: int = 3, bits: int = 64) -> Column:
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, bits) for t in texts], dtype=object)

    return of(text)


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """The 24 keys (slot << 32 | value) of each row of 8 bytes; slot // 3 is the chain's start."""
    f, m = fps.astype(np.int64), fps.shape[1]
    at = lambda i: f[:, i % m]
    keys = []
    for i in range(m):
        tail = [i + 2, i + 3, i + 4]
        for skip in range(3):
            a, b = (x for k, x in enumerate(tail) if k != skip)
            keys.append(((3 * i + skip) << 32) | (at(i) << 24 | at(i + 1) << 16 | at(a) << 8 | at(b)))
    return np.stack(keys, axis=1)


def chain_linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a, b, fingerprint bytes from a chain's start on, hold the chain's budgets and the full check."""
    m = a.shape[1]
    ok, done, run = np.arange(len(a)), 0, np.zeros(len(a), dtype=np.int32)
    for length in range(3, m + 1):
        run = run + np.bitwise_count(a[ok, done:length] ^ b[ok, done:length]).sum(axis=1, dtype=np.int32)
        keep = run <= length * most // m
        ok, run, done = ok[keep], run[keep], length
        if not len(ok):
            break
    out = np.zeros(len(a), dtype=bool)
    out[ok] = True
    return out


def _matrix(fps: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), -1)


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """Edges (u, v) that connect ``classes`` (rep long, fp binary of 8 bytes, distinct) as all links within ``most`` do.

    First each class is compared with the smallest members of its buckets. Then only buckets that hold members of
    different components are compared, members of one component left out, in blocks of bounded size of which a
    spanning forest leaves. A large group of near copies so costs about its own size, not its square, and whatever
    the first pass finds, the two together connect exactly what all pairs would. ``most`` is 3 or fewer.
    """

    @F.pandas_udf("array<bigint>")
    def keys_of(fps: pd.Series) -> pd.Series:
        return pd.Series(list(ring_keys(_matrix(fps))) if len(fps) else [], dtype=object)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series, key: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        turn = ((key.to_numpy() >> 32)[:, None] // 3 + np.arange(8)[None, :]) % 8
        x, y = (np.take_along_axis(_matrix(s), turn, axis=1) for s in (a, b))
        return pd.Series(chain_linked(x, y, most))

    def block(g: pd.DataFrame) -> pd.DataFrame | None:
        f = np.roll(_matrix(g["fp"]), -((int(g["key"].iat[0]) >> 32) // 3), axis=1)
        i, j = apart(g)
        adj = np.zeros((len(g), len(g)), dtype=bool)
        for lo in range(0, len(i), 1 << 13):
            a, b = i[lo : lo + (1 << 13)], j[lo : lo + (1 << 13)]
            hit = chain_linked(f[a], f[b], most)
            adj[a[hit], b[hit]] = True
        u, v = spanning(adj, g["rep"].to_numpy())
        return pd.DataFrame({"u": u, "v": v})

    keyed = classes.select("rep", F.explode(keys_of("fp")).alias("key"))
    buckets = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("u")).where("n > 1"))
    members = durable(keyed.join(buckets, "key"))
    pairs = members.where("rep <> u").select(F.col("u").alias("p"), F.col("rep").alias("q"), "key").groupBy("p", "q").agg(F.collect_set("key").alias("keys"))
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("fp").alias(f"fp_{x}"))
    stars = durable(
        pairs.join(side("p"), "p").join(side("q"), "q").select("p", "q", "fp_p", "fp_q", F.explode("keys").alias("key"))
        .where(linked("fp_p", "fp_q", "key")).select(F.col("p").alias("u"), F.col("q").alias("v")).distinct()
    )
    roots = components(stars)
    rooted = durable(classes.join(roots, classes.rep == roots.node, "left").select("rep", "fp", F.coalesce("root", "rep").alias("root")))
    # the pair of a bucket of two was tried and need not be compared again
    named = members.where("n > 2").select("key", "n", "rep").join(rooted.select("rep", "root"), "rep")
    open_ = durable(named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"))
    left = named.join(open_, "key").join(rooted.select("rep", "fp"), "rep")
    more = grouped(in_blocks(left, "key", "n", F.col("rep"), BLOCK), ["key", "pa", "pb"], block, "u long, v long")
    return stars.unionByName(more)


def met(g: pd.DataFrame) -> np.ndarray:
    """Which pairs of a block's rows meet nowhere else."""
    my = g["my"].to_numpy()
    wanted = np.triu(np.ones((len(g), len(g)), dtype=bool), 1)
    return wanted & (my[:, None] != my[None, :]) if g["pa"].iat[0] != g["pb"].iat[0] else wanted


def apart(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows that have different roots and meet nowhere else."""
    root = g["root"].to_numpy()
    return np.nonzero(met(g) & (root[:, None] != root[None, :]))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (binary), component_id (the smallest doc_id reachable by links).

    Null texts count as empty; the empty fingerprint is all zero and links like any other. Repeated rows give
    repeated rows. A null doc_id never is a component's id: such a row gets the component of its fingerprint, or null
    if no row with an id holds it. Columns besides doc_id and text are not read. An empty table gives no rows.
    """
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), words).alias("fp")))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    roots = components(links(classes, most))
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(durable(named), "fp", "left").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    parts = [h.view(">u8").ravel().astype(np.uint64) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def set_fingerprint(shingles: np.ndarray) -> bytes:
    return majority(iter([shingles.astype(">u8").view(np.uint8).reshape(-1, 8)]), WIDE)


def key_bits(count: int) -> int:
    """Bits that a chain's key holds: so many that a class shares a bucket with an unlike one for one key in eight at most."""
    return max(16, max(1, count - 1).bit_length() + 3)


def chains(bits: int) -> np.ndarray:
    """Segments of each chain in order, the key's first. Each ring steps through all segments; its chains' keys are disjoint."""
    need, alike = 2 * math.ceil(-math.log(MISSED) / (1 - DIFFERENT) ** bits), -(-bits // 4)
    per_ring = SEGMENTS // alike
    slot = np.arange(need)
    ring = slot // per_ring
    step = (1 + 36 * ring) % SEGMENTS | 1  # odd: a step visits every segment
    start = slot % per_ring * alike + ring // 64
    return ((start[:, None] + np.arange(alike + FOLLOW)[None, :]) * step[:, None]) % SEGMENTS


def filed(fps: np.ndarray, bits: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (slot and its first segments, the last one as far as ``bits`` go) and the segments that follow, of each row
    of fingerprint bytes and chain."""
    nibbles = np.empty((len(fps), SEGMENTS), dtype=np.uint64)
    nibbles[:, ::2], nibbles[:, 1::2] = fps >> 4, fps & 15
    key = np.zeros((len(fps), len(slots)), dtype=np.uint64) + np.arange(len(slots), dtype=np.uint64)
    chain = np.zeros_like(key)
    for k in range(0, bits, 4):
        width = np.uint64(min(4, bits - k))
        key <<= width
        key |= nibbles[:, slots[:, k // 4]] >> (np.uint64(4) - width)
    for k in range(slots.shape[1] - FOLLOW, slots.shape[1]):
        chain <<= np.uint64(4)
        chain |= nibbles[:, slots[:, k]]
    return key.view(np.int64), chain.view(np.int64)


def budgets(bits: int) -> list[tuple[int, int]]:
    """(mask, most): bits of a chain's following segments, and how many of them may differ."""
    return [(((1 << 4 * k) - 1) << 4 * (FOLLOW - k), (-(-bits // 4) + k) * NEAR // SEGMENTS) for k in (4, 8, FOLLOW)]


def limit(least_n: np.ndarray) -> np.ndarray:
    """Differing bits up to which two sets are compared, by the size of the smaller one."""
    return np.where(least_n < FEW, MOST, NEAR)


def hamming(a: pd.Series, b: pd.Series) -> np.ndarray:
    return np.bitwise_count(_matrix(a) ^ _matrix(b)).sum(axis=1, dtype=np.int32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_links(classes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (u, v) that connect ``classes`` (rep long, fp binary, n shingles) as links of similarity ``least`` do.

    texts: rep, text. The passes are those of ``links``, but of a class's many pairs with bucket minima only those
    NEAREST with most common keys are tried first. Only texts of pairs that hold the budgets and are within MOST bits
    are cut to shingles.
    """
    bits = key_bits(classes.count())
    slots = chains(bits)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, fps, n = (b.column(k) for k in range(3))
            reps, n = reps.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint8).reshape(len(reps), WIDE // 8)
            for rows, used in ((n >= FEW, slots[: len(slots) // 2]), (n < FEW, slots)):
                if rows.any():
                    key, chain = filed(fps[rows], bits, used)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[rows], len(used))), pa.array(key.ravel()), pa.array(chain.ravel())], ["rep", "key", "chain"])

    @F.pandas_udf("boolean")
    def near_enough(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(hamming(a, b) <= limit(n.to_numpy()) if len(a) else [], dtype=bool)

    @F.pandas_udf("binary")
    def set_of(x: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).tobytes() for t in x], dtype=object)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        of = lambda x: np.frombuffer(x, dtype=np.uint64)
        return pd.Series([jaccard(of(x), of(y)) >= least for x, y in zip(a, b)], dtype=bool)

    def sets_of(reps: DataFrame) -> DataFrame:
        return durable(texts.join(reps.select("rep").distinct(), "rep", "left_semi").select("rep", set_of("text").alias("shingles")))

    def holds_budgets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([np.bitwise_count((a ^ b).view(np.uint64) & np.uint64(mask)) <= most for mask, most in budgets(bits)])

    def pairs_of(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Pairs apart that hold the budgets here, are within the limit, and do not hold them under an earlier key."""
        chain, f, n = g["chain"].to_numpy(), _matrix(g["fp"]), g["size"].to_numpy()
        i, j = apart(g)
        ok = holds_budgets(chain[i], chain[j])
        i, j = i[ok], j[ok]
        parts = [slice(k, k + (1 << 13)) for k in range(0, len(i), 1 << 13)]
        ok = [np.bitwise_count(f[i[p]] ^ f[j[p]]).sum(axis=1, dtype=np.int32) <= limit(np.minimum(n[i[p]], n[j[p]])) for p in parts]
        ok = np.concatenate(ok) if ok else np.zeros(0, dtype=bool)
        i, j = i[ok], j[ok]
        if not len(i):
            return i, j
        keys, chains_ = filed(f, bits, slots[: int(g["key"].iat[0]) >> bits])
        first = [~((keys[i[p]] == keys[j[p]]) & holds_budgets(chains_[i[p]], chains_[j[p]])).any(axis=1) for p in (slice(k, k + 512) for k in range(0, len(i), 512))]
        first = np.concatenate(first)
        return i[first], j[first]

    def chained(g: pd.DataFrame) -> pd.DataFrame | None:
        chain = g["chain"].to_numpy()
        i, j = np.nonzero(met(g))
        ok = holds_budgets(chain[i], chain[j])
        return g.iloc[np.unique(np.concatenate([i[ok], j[ok]]))] if ok.any() else None

    def candidates(g: pd.DataFrame) -> pd.DataFrame | None:
        i, j = pairs_of(g)
        return g.iloc[np.unique(np.concatenate([i, j]))] if len(i) else None

    def block(g: pd.DataFrame) -> pd.DataFrame | None:
        sets, rep, label = [np.frombuffer(x, dtype=np.uint64) for x in g["shingles"]], g["rep"].to_numpy(), g["root"].to_numpy().copy()
        u, v = [], []
        for a, b in zip(*pairs_of(g)):
            if label[a] != label[b] and jaccard(sets[a], sets[b]) >= least:
                label[label == label[b]] = label[a]
                u.append(rep[a])
                v.append(rep[b])
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    keyed = classes.select("rep", "fp", "n").mapInArrow(keys_of, "rep long, key long, chain long")
    buckets = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("u"), F.min_by("chain", "rep").alias("c")).where("n > 1"))
    holds = F.lit(True)
    for mask, most in budgets(bits):
        mask = mask - (1 << 64) if mask >> 63 else mask
        holds = holds & (F.bit_count(F.col("c").bitwiseXOR(F.col("chain")).bitwiseAND(F.lit(mask))) <= most)
    members = durable(keyed.join(buckets, "key").select("key", "n", "rep", "chain", "u", ((F.col("rep") != F.col("u")) & holds).alias("holds")))
    pairs = members.where("holds").select(F.col("u").alias("p"), F.col("rep").alias("q"), "key").groupBy("p", "q").agg(F.collect_set("key").alias("keys"))
    # a class has at most as many such pairs as keys
    listed = pairs.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.size("keys")).alias("order"), "p", "keys"))).alias("found"))
    pairs = durable(
        listed.select("q", F.posexplode("found").alias("place", "x"))
        .select("q", F.col("x.p").alias("p"), "x.keys", (F.col("place") < NEAREST).alias("tried"))
    )
    side = lambda df, col, x: df.select(F.col("rep").alias(x), F.col(col).alias(f"{col}_{x}"))
    sized = lambda x: classes.select(F.col("rep").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}"))
    near = durable(
        pairs.where("tried").select("p", "q").join(sized("p"), "p").join(sized("q"), "q")
        .where(near_enough("fp_p", "fp_q", F.least("n_p", "n_q"))).select("p", "q")
    )
    sets = sets_of(near.select(F.col("p").alias("rep")).union(near.select("q")))
    stars = durable(
        near.join(side(sets, "shingles", "p"), "p").join(side(sets, "shingles", "q"), "q")
        .where(linked("shingles_p", "shingles_q")).select(F.col("p").alias("u"), F.col("q").alias("v")).distinct()
    )
    roots = components(stars)
    rooted = durable(classes.join(roots, classes.rep == roots.node, "left").select("rep", F.coalesce("root", "rep").alias("root"), "fp", F.col("n").alias("size")))
    # Buckets to look into: a pair of different components that holds the budgets, or a member that does not hold them
    # with the smallest one but may with another. In a bucket of two there is no other, and a tried pair is decided.
    root_of = lambda x: rooted.select(F.col("rep").alias(x), F.col("root").alias(f"root_{x}"))
    parted = pairs.join(root_of("p"), "p").join(root_of("q"), "q").where("root_p <> root_q")
    parted = parted.select(F.explode("keys").alias("key"), "tried").groupBy("key").agg(F.bool_and("tried").alias("tried"))
    strange = members.where("n > 2 and not holds and rep <> u").select("key").distinct()
    open_ = parted.join(strange.withColumn("strange", F.lit(True)), "key", "full").select("key", (F.col("strange").isNotNull() | ~F.col("tried")).alias("all"))
    left = members.join(durable(open_), "key").where("n > 2 or `all`").select("key", "n", "rep", "chain")
    # a bucket of several blocks is worth a look at its roots first
    named = left.where(F.col("n") > SETS).select("key", F.col("rep").alias("member")).join(root_of("r"), F.col("member") == F.col("r"))
    closed = durable(named.groupBy("key").agg(F.min("root_r").alias("a"), F.max("root_r").alias("b")).where("a = b").select("key"))
    left = in_blocks(left.join(closed, "key", "left_anti"), "key", "n", F.col("rep"), SETS).select("key", "pa", "pb", "rep", "my", "chain")
    # chains first, then whole fingerprints, then whole sets
    block_of, own = ["key", "pa", "pb"], "key long, pa int, pb int, rep long, my int, chain long"
    held = durable(grouped(left, block_of, chained, own))
    rest = durable(grouped(held.join(rooted, "rep").select(*held.columns, "root", "fp", "size"), block_of, candidates, f"{own}, root long, fp binary, size int"))
    return stars.unionByName(grouped(rest.join(sets_of(rest), "rep"), block_of, block, "u long, v long"))


def similar(docs: DataFrame, words: int, least: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest doc_id reachable by links).

    Linked are texts whose sets of word shingles have a Jaccard similarity of ``least`` (0.8 or more) or more, as far
    as their fingerprints share a key: at 0.8 all but one in fifty, nearer texts hardly ever miss. The rest is as in
    ``near_duplicates``.
    """

    @F.pandas_udf("fp binary, content binary, n int")
    def described(x: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in x]
        return pd.DataFrame({"fp": [set_fingerprint(s) for s in sets], "content": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets]})

    key = F.col("doc_id").cast("long")
    rows = durable(docs.select(key.alias("doc_id"), described(F.col("text")).alias("x")).select("doc_id", "x.*"))
    classes = durable(rows.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n")).where("rep is not null"))
    roots = components(similar_links(classes, docs.select(key.alias("rep"), "text"), words, least))
    named = classes.join(roots, classes.rep == roots.node, "left").select("content", F.coalesce("root", "rep").alias("component_id"))
    return rows.select("doc_id", "content").join(durable(named), "content", "left").select("doc_id", "component_id")
