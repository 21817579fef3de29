"""Shared pieces of the corpus operators: durable cuts, block-wise group processing, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.session import importable

#: ASCII white space as the contracts count it: space and \t to \r. bytes.split() cuts at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a few numbers that one task takes.
TASK_ROWS = 500_000
#: Edges up to which their nodes' minima, two numbers for each of at most twice as many nodes, are broadcast.
BROADCAST_EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with batches to Python of bounded size, so that long texts do not fill a worker's memory."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where the session names none, a local master (tests) gets a temporary one; a cluster must name its own.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


def durable(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read from there: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``fn`` over each group of ``keys``; groups must be of bounded size.

    One sort and one Python stream for all groups of a partition: cheaper than a call with its own Arrow
    batch for each group, and a batch that ends inside a group is carried over.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            k = batch[keys]
            starts = [0, *(((k != k.shift()).any(axis=1)).to_numpy().nonzero()[0][1:])]
            rest = batch.iloc[starts[-1] :]
            out = [x for a, b in zip(starts, starts[1:]) if (x := fn(batch.iloc[a:b])) is not None and len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) and (x := fn(rest)) is not None and len(x):
            yield x

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def in_blocks(df: DataFrame, group: str, n: str, member: Column, size: int) -> DataFrame:
    """Rows of groups of any size, dealt so that every two rows of a group meet in a block of bounded size.

    ``n`` is the group's row count. Each row gets a block number; every pair of blocks (pa <= pb) becomes a group
    of its own, so that a hot group is shared by many tasks. A group within ``size`` stays whole.
    """
    return (
        df.withColumn("g", F.ceil(F.col(n) / F.lit(size)).cast("int"))
        .withColumn("my", F.pmod(F.xxhash64(member, F.lit(7)), F.col("g").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .withColumn("pa", F.least("my", "other"))
        .withColumn("pb", F.greatest("my", "other"))
        .drop("g", "other", n)
    )


def spanning(adjacent, ids, own=None) -> tuple[list, list]:
    """Forest of a block's links: each member with the smallest id of its local component.

    adjacent: boolean matrix; ids: int64 array.
    """
    import numpy as np

    order = np.argsort(ids, kind="stable")
    adj = (adjacent | adjacent.T)[np.ix_(order, order)]
    np.fill_diagonal(adj, True)
    label = np.arange(len(ids))
    while True:
        new = np.where(adj, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    s = ids[order]
    return s[moved], s[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the smallest id; only nodes that have an edge.

    Alternating large-star and small-star steps, each a pre-aggregated minimum and a join that adaptive execution
    splits at hubs. The edges stay distributed; the driver sees only a count and a hash of them.
    """
    e = durable(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
        if now == seen or now[0] == 0:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = now
        # as many tasks as the edges fill; they only get fewer
        few = lambda df: df.coalesce(max(1, -(-now[0] // TASK_ROWS)))  # noqa: B023, E731
        # the minima of few edges go to the edges, so that a hub's edges stay where they are; of many, the join splits hubs
        near = F.broadcast if now[0] <= BROADCAST_EDGES else (lambda df: df)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = durable(few(both.join(near(least), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()))
        least = e.groupBy("b").agg(F.min("a").alias("m"))
        e = durable(few(
            e.join(near(least), "b")
            .where("a <> m")
            .select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), "b"))
            .distinct()
        ))
