"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosines, components.

Equal vectors of a label are one class with a count. A class gets one hash in each of several tables; its bits follow
from the number of classes, so that unlike vectors hardly share one, and the tables from the bits: a pair at cosine
0.93 (an angle of 21.6 degrees) shares a bit with probability 0.88 and some table with 0.995. Classes of a bucket are
compared in blocks by exact double-precision cosine; a pair counts in the first table in which its hashes meet, which
both vectors tell, so that links are counted once without being listed.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import components, durable, grouped, in_blocks, spanning

#: Rows of a bucket in one block, and links at the least cosine that may be missed.
BLOCK, MISSED = 1024, 0.005


def sized(count: int, cosine: float) -> tuple[int, int]:
    """(tables, bits) for so many vectors: one unlike vector in a bucket at most."""
    bits = max(12, max(1, count - 1).bit_length())
    shared = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log1p(-shared)) if shared < 1 else 1, bits


@functools.lru_cache(maxsize=8)
def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, tables, bits]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One hash for each row and table."""
    up = (x @ hyperplanes(x.shape[1], tables, bits) >= 0).reshape(len(x), tables, bits)
    return up @ (1 << np.arange(bits, dtype=np.int64))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    Vectors of different lengths do not link. Equal vectors of a label link with one another; repeated rows do too. A
    row with a null vec_id counts as a link of others but never names a component. An empty table gives no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0.0)
    )
    key = F.xxhash64("label", "embedding")
    rows = durable(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
        .withColumn("sound", F.coalesce(sound, F.lit(False)))
        .select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), F.when(F.col("sound"), F.col("embedding")).alias("embedding"), F.when(F.col("sound"), key).alias("h"))
    )
    # h only speeds the grouping up: label and vector themselves are compared
    classes = durable(
        rows.where("h is not null").groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
        .withColumn("id", F.monotonically_increasing_id())  # fixed by the checkpoint
    )
    tables, bits = sized(classes.count(), cosine)

    @F.pandas_udf("array<bigint>")
    def hashed(vs: pd.Series) -> pd.Series:
        out = np.empty(len(vs), dtype=object)
        for dim in {len(x) for x in vs}:
            at = [i for i, x in enumerate(vs) if len(x) == dim]
            for i, s in zip(at, signatures(np.stack([vs.iat[i] for i in at]).astype(float), tables, bits)):
                out[i] = s.tolist()
        return pd.Series(out)

    filed = classes.select("id", "label", F.size("embedding").alias("dim"), F.posexplode(hashed("embedding")).alias("tab", "hash"))
    where = ["label", "dim", "tab", "hash"]
    full = durable(filed.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1"))
    members = filed.join(full, where).withColumn("key", F.xxhash64(*where))
    # buckets are dealt out by ids; a vector is added once for each block it is in
    dealt = in_blocks(members, "key", "n", F.col("id"), BLOCK).join(classes.select("id", "size", "embedding"), "id")

    def block(g: pd.DataFrame) -> pd.DataFrame | None:
        raw = np.stack(g["embedding"].to_numpy()).astype(float)
        x = raw / np.abs(raw).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        my, size, ids, tab = g["my"].to_numpy(), g["size"].to_numpy(), g["id"].to_numpy(), int(g["tab"].iat[0])
        if g["pa"].iat[0] != g["pb"].iat[0]:
            near &= my[:, None] != my[None, :]
        if not near.any():
            return None
        sig = signatures(raw, tables, bits)[:, :tab]
        for lo in range(0, len(near), 64):
            i, j = np.nonzero(near[lo : lo + 64])
            for at in range(0, len(i), 1 << 13):
                a, b = i[at : at + (1 << 13)] + lo, j[at : at + (1 << 13)]
                near[a, b] = ~(sig[a] == sig[b]).any(axis=1)
        count = near @ size
        u, v = spanning(near, ids)
        links = pd.DataFrame({"id": ids, "n": count, "to": pd.array([None] * len(ids), dtype="Int64")})[count > 0]
        return pd.concat([links, pd.DataFrame({"id": u, "n": 0, "to": pd.array(v, dtype="Int64")})], ignore_index=True)

    found = durable(grouped(dealt, [*where, "pa", "pb"], block, "id long, n long, to long"))
    linked = found.groupBy("id").agg(F.sum("n").alias("others"))
    roots = components(found.where("to is not null").select(F.col("id").alias("u"), F.col("to").alias("v")))
    named = classes.select("id", "rep").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    whole = durable(
        named.join(least, "root").join(linked, "id", "left")
        .select("id", "component_id", F.coalesce("others", F.lit(0)).alias("others"))
        .join(classes.select("id", "h", F.col("label").alias("l"), F.col("embedding").alias("e"), "size"), "id")
        .select("h", "l", "e", "component_id", (F.col("others") + F.col("size") - 1).alias("n_links"))
    )
    same = (rows["h"] == whole["h"]) & (rows["label"] == whole["l"]) & (rows["embedding"] == whole["e"])
    out = rows.join(whole, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(whole["h"].isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle() -> str:
    """DuckDB SQL for ``near_duplicates`` of sound vectors, by all pairs of a label: for small tables."""
    return """
with recursive v as (select vec_id, embedding::double[] e, label from embeddings),
links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
c as (select v.vec_id, least(v.vec_id, coalesce(min(r.b), v.vec_id)) component_id from v left join reach r on r.a = v.vec_id group by v.vec_id)
select vec_id, (select count(*) from links where a = vec_id)::bigint n_links, component_id, vec_id = component_id kept from c"""
