"""Keyed state in packet order: folds over partitions that are dealt by key and sorted.

The windows of the port-scan detector begin at a source's first packet and the beacon detector forgets after an alert,
so neither is a SQL window. Each task streams its keys in order, a stretch of a key's rows at a time as arrays, and
holds one key's state; nothing is gathered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Found in a stretch: (rows' places, columns of results for them), and the key's next state.
Stretch = Callable[[object, dict[str, np.ndarray]], tuple[list[int], list[tuple], object]]


def folded(df: DataFrame, keys: list[str], order: str, start: Callable[[], object], stretch: Stretch, read: list[str], added: str) -> DataFrame:
    """Rows of ``df`` that ``stretch(state, columns read)`` chooses, with the columns it adds, in the order of ``order``.

    A key's rows come in stretches, as batches end; whole numbers and doubles in ``keys`` and ``read``.
    """
    kinds = [x.strip().split() for x in added.split(",")]
    arrow = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            by, values = [column(k) for k in keys], {k: column(k) for k in read}
            new = np.zeros(n, dtype=bool)
            for x in by:
                new[1:] |= x[1:] != x[:-1]
            edges = [0, *np.nonzero(new)[0].tolist(), n]
            places, found = [], []
            for a, b in zip(edges, edges[1:]):
                own = tuple(x[a] for x in by)
                if own != key:
                    key, state = own, start()
                at, rows, state = stretch(state, {k: v[a:b] for k, v in values.items()})
                places += [a + i for i in at]
                found += rows
            if places:
                chosen = batch.take(pa.array(places))
                extra = [pa.array(v, arrow[t]) for v, (_, t) in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*chosen.columns, *extra], [*chosen.schema.names, *(k for k, _ in kinds)])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(stream, f"{have}, {added}")


#: Packets of a part: windows are found among parts, so that a source's packets need not meet in one task.
PART_BITS = 12


def windowed(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """``df`` (key, packet_id, tsec, ...) with window: the second in which the row's window began.

    The first packet of a key opens a window; a packet ``seconds`` or more after its start opens the next. Time that
    runs backwards stays in the window. Only a second later than all before it can open one, so a fold needs just the
    first packet of each second: those of a part of PART_BITS of packet numbers become one row, the fold passes a key's
    parts in order, and the packets, dealt by key and part, take from theirs the window it begins in and those that
    begin in it.
    """
    df = df.withColumn("part", F.shiftright("packet_id", PART_BITS))
    firsts = df.groupBy(key, "part", "tsec").agg(F.min("packet_id").alias("packet_id"))
    parts = firsts.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("packet_id", "tsec"))).alias("firsts"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begun = None, None
        for batch in batches:
            entered, opened = [], []
            for k, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != own:
                    own, begun = k, None
                entered.append(begun)
                here = []
                for x in found:
                    if begun is None or x["tsec"] >= begun + seconds:
                        begun = x["tsec"]
                        here.append(x)
                opened.append(here)
            kind = pa.list_(pa.struct([("packet_id", pa.int64()), ("tsec", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entered, pa.int64()), pa.array(opened, kind)], [key, "part", "entered", "opened"])

    kind = df.schema[key].dataType.simpleString()
    found = parts.repartition(key).sortWithinPartitions(key, "part").mapInArrow(stream, f"`{key}` {kind}, part long, entered long, opened array<struct<packet_id: long, tsec: long>>")
    last = F.element_at(F.filter("opened", lambda x: x["packet_id"] <= F.col("packet_id")), -1)["tsec"]
    begins = F.when(F.exists("opened", lambda x: x["packet_id"] <= F.col("packet_id")), last).otherwise(F.col("entered"))
    return df.join(found, [key, "part"]).withColumn("window", begins).drop("part", "entered", "opened")


def regular(times: np.ndarray, tolerance: float) -> tuple[float, float] | None:
    """Mean and population deviation of the times' intervals if they are regular; sums run from the oldest interval on."""
    gaps = np.diff(times)
    mean = float(np.add.accumulate(gaps)[-1]) / len(gaps)
    if mean <= 1.0:
        return None
    spread = (float(np.add.accumulate((gaps - mean) * (gaps - mean))[-1]) / len(gaps)) ** 0.5
    return (mean, spread) if spread < mean * tolerance else None


def likely(times: np.ndarray, first: int, least: int, depth: int, tolerance: float) -> np.ndarray:
    """Places from ``first`` on at which the last ``depth`` times may be regular, by running sums; none is left out."""
    gaps = np.concatenate([[0.0], np.diff(times)])
    at = np.arange(first, len(times))
    back = np.maximum(at - depth + 1, 0)
    n = at - back
    sums, squares = np.cumsum(gaps), np.cumsum(gaps * gaps)
    count = np.maximum(n, 1)
    mean = (sums[at] - sums[back]) / count
    scale = squares[-1] + 1.0  # of rounding in the running sums
    variance = (squares[at] - squares[back]) / count - mean * mean
    return at[(n + 1 >= least) & (mean > 1.0 - 1e-6) & (variance < (mean * tolerance) ** 2 * (1 + 1e-6) + 1e-9 * scale)]


BEACON = "interval_mean double, interval_stddev double, sample_count int"


def beacons(df: DataFrame, keys: list[str], least: int, tolerance: float, depth: int = 100) -> DataFrame:
    """Rows of ``df`` (packet_id, ts, ...) with BEACON at which the last ``depth`` times of their key are regular.

    Regular: ``least`` times or more, a mean interval above one second, and a population deviation below ``tolerance``
    times the mean. The key's times are then forgotten. A stretch is looked through by running sums; only places that
    these leave are decided by the sums themselves.
    """
    least = max(least, 2)

    def stretch(held: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[list[int], list[tuple], np.ndarray]:
        new = columns["ts"]
        places, found, at = [], [], 0
        block = 64
        while at < len(new):
            # the times held, and a block of new ones that grows as long as nothing is found
            times = np.concatenate([held, new[at : at + block]])
            first, hit = len(held), None
            if len(times) >= least:
                for k in likely(times, first, least, depth, tolerance):
                    seen = times[max(0, k + 1 - depth) : k + 1]
                    if (hit := regular(seen, tolerance)) is not None:
                        places.append(at + k - first)
                        found.append((*hit, len(seen)))
                        held, at, block = np.zeros(0), at + k - first + 1, 64
                        break
            if hit is None:
                at += len(times) - first
                held, block = times[max(0, len(times) - depth + 1) :] if depth > 1 else times[:0], min(4 * block, 1 << 14)
        return places, found, held

    return folded(df, keys, "packet_id", lambda: np.zeros(0), stretch, ["ts"], BEACON)
