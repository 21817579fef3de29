"""Counters, heavy hitters and flows: pre-aggregated before every shuffle, exact by default."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import columns as c

#: Alert counters and the types they count (fixed values).
ALERT_COUNTERS = (
    ("alerts_blocklisted_ip", "blocklisted_ip"), ("alerts_blocklisted_domain", "blocklisted_domain"), ("alerts_keyword", "keyword_match"),
    ("alerts_portscan", "port_scan"), ("alerts_dns_tunnel", "dns_tunnel"), ("alerts_beaconing", "beaconing"), ("alerts_exfil", "exfiltration"),
    ("alerts_sensitive", "sensitive_data"),
)


def counters(packets: DataFrame) -> DataFrame:
    """One row of traffic counters, from one pass."""
    n = lambda cond: F.count_if(cond)
    l4 = F.col("l4")
    return packets.agg(
        F.count("*").alias("packets"), F.coalesce(F.sum(F.col("raw_len").cast("long")), F.lit(0)).alias("bytes"),
        n(F.col("is_ipv4")).alias("ipv4"), n(F.col("is_ipv6")).alias("ipv6"),
        n(l4 == c.TCP).alias("tcp"), n(l4 == c.UDP).alias("udp"), n(l4 == c.ICMP).alias("icmp"), n(l4 == c.ICMPV6).alias("icmpv6"),
        n(F.col("is_arp")).alias("arp"), n(~l4.isin(c.TCP, c.UDP, c.ICMP, c.ICMPV6)).alias("other"),
        n(F.col("is_dns")).alias("dns_queries"), n(F.col("is_http") & (F.col("http_method") != "")).alias("http_requests"),
        n(F.col("is_tls")).alias("tls_handshakes"), n(F.col("is_dhcp")).alias("dhcp_messages"),
    )


def alert_counters(alerts: DataFrame) -> DataFrame:
    """One row: all alerts, whether written or not, and each type's."""
    return alerts.agg(F.count("*").alias("alerts_total"), *(F.count_if(F.startswith("type", F.lit(t))).alias(k) for k, t in ALERT_COUNTERS))


def top(df: DataFrame, key: str, weight: Column, k: int | None, name: str = "key") -> DataFrame:
    """(name, count): the ``k`` keys of largest weight, equal ones by key; for None all keys, in no order."""
    counted = df.groupBy(F.col(key).alias(name)).agg(F.sum(weight).alias("count"))
    return counted if k is None else counted.orderBy(F.desc("count"), name).limit(k)


def top_bytes(packets: DataFrame, side: str, k: int | None, legacy: bool = False) -> DataFrame:
    """(ip, count): bytes by source or destination. In the legacy profile frames without an address count as 0.0.0.0."""
    ip = f"{side}_ip4"
    rows = packets.select(F.coalesce(ip, F.lit(0).cast("long")).alias(ip), "raw_len") if legacy else packets.where("is_ipv4").select(ip, "raw_len")
    return top(rows, ip, F.col("raw_len").cast("long"), k, "n").select(c.ip4_text("n").alias("ip"), "count")


def top_names(packets: DataFrame, column: str, k: int | None) -> DataFrame:
    """(key, count): packets by a name that is not empty."""
    return top(packets.where(F.col(column) != ""), column, F.lit(1).cast("long"), k)


def sketched(df: DataFrame, key: str, weight: Column, capacity: int) -> DataFrame:
    """Space-Saving sketches of the partitions of ``df``: (key, count, error, floor) of at most ``capacity`` keys each.

    A key's true weight in its partition lies between count - error and count; that of a key that is not held is at
    most floor. Evicted is the key of smallest count; bounded memory, one pass, no shuffle.
    """
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    rows = df.select(F.col(key).alias("key"), weight.cast("long").alias("weight")).where("key is not null and weight > 0")
    kind = rows.schema["key"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sketch(capacity)
        for b in batches:
            # equal keys of a batch count once, heavy ones first: fewer evictions
            summed = pa.Table.from_batches([b]).group_by("key").aggregate([("weight", "sum")]).sort_by([("weight_sum", "descending"), ("key", "ascending")])
            for k, n in zip(summed["key"].to_pylist(), summed["weight_sum"].to_pylist()):
                held.add(k, n)
        found = held.top()
        floor = held.floor()
        # the row without a key tells what a key may weigh that the partition does not hold
        columns = [[None, *(k for k, _, _ in found)], [0, *(n for _, n, _ in found)], [0, *(e for _, _, e in found)], [floor] * (len(found) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [arrow[kind], *[pa.int64()] * 3])], ["key", "count", "error", "floor"])

    return rows.mapInArrow(stream, f"key {kind}, count long, error long, floor long")


def merged_sketches(parts: DataFrame, k: int | None = None) -> DataFrame:
    """(key, count, error) of the whole from sketches of its parts: the true weight lies between count - error and count.

    A part that does not hold a key may have up to its floor of it: the sum of all floors, less those of the parts that
    hold the key, is added to count and error alike. ``k``: the largest counts, equal ones by key.
    """
    floors = parts.where("key is null").agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("floors"))
    each = parts.where("key is not null").groupBy("key").agg(F.sum(F.col("count") - F.col("floor")).alias("count"), F.sum(F.col("error") - F.col("floor")).alias("error"))
    out = each.join(F.broadcast(floors)).select("key", (F.col("count") + F.col("floors")).alias("count"), (F.col("error") + F.col("floors")).alias("error"))  # one row
    return out if k is None else out.orderBy(F.desc("count"), "key").limit(k)


def approx_top(df: DataFrame, column: str, k: int, items: int = 10_000) -> DataFrame:
    """(key, count, error) by mergeable sketches of ``items`` counters: for keys too many to count exactly."""
    return merged_sketches(sketched(df.where(F.col(column) != ""), column, F.lit(1), items), k)


def pruned(df: DataFrame, capacity: int) -> DataFrame:
    """The largest ``capacity`` entries of a sketch (key, count, error)."""
    return df.orderBy(F.desc("count"), "key").limit(capacity)


def merged_top(lists: DataFrame, k: int, name: str = "key") -> DataFrame:
    """The heavy hitters of several lists of (name, count)."""
    return top(lists, name, F.col("count"), k, name)


def app_name(packets: DataFrame) -> Column:
    return F.when(F.col("is_dns"), "DNS").when(F.col("is_http"), "HTTP").when(F.col("is_tls"), "TLS").when(F.col("is_dhcp"), "DHCP").otherwise("")


def flows(packets: DataFrame) -> DataFrame:
    """Directed flows: first and last times and the application are those of their first and last packets in file order."""
    key = ["is_ipv6", "src_ip", "dst_ip", "src_port", "dst_port", "l4"]
    made = (
        packets.where("is_ipv4 or is_ipv6").withColumn("app_proto", app_name(packets)).groupBy(*key)
        .agg(
            F.count("*").alias("packets"), F.sum(F.col("raw_len").cast("long")).alias("bytes"), F.min_by("ts", "packet_id").alias("first_ts"),
            F.max_by("ts", "packet_id").alias("last_ts"), F.min_by("app_proto", "packet_id").alias("app_proto"),
        )
    )
    return made.select("src_ip", "dst_ip", "src_port", "dst_port", c.proto_name(other="0").alias("proto"), "packets", "bytes", "first_ts", "last_ts", "app_proto")


def conversations(flow: DataFrame) -> DataFrame:
    """Flows of both directions as one row, from the side of the smaller end."""
    one, two = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    forth = one <= two
    of = lambda cond, x: F.sum(F.when(cond, F.col(x)).otherwise(F.lit(0)))
    return (
        flow.withColumn("a", F.least(one, two)).withColumn("b", F.greatest(one, two)).groupBy("a", "b", "proto")
        .agg(
            of(forth, "packets").alias("packets"), of(forth, "bytes").alias("bytes"), of(~forth, "packets").alias("packets_rev"), of(~forth, "bytes").alias("bytes_rev"),
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        )
        .select(F.col("a.ip").alias("src_ip"), F.col("a.port").alias("src_port"), F.col("b.ip").alias("dst_ip"), F.col("b.port").alias("dst_port"), "proto", "packets", "bytes", "packets_rev", "bytes_rev", "first_ts", "last_ts")
    )


class Sketch:
    """Weighted Space-Saving counters: at most ``capacity`` keys; a new key takes the place and the count of the least.

    Keys lie in buckets of equal counts, the counts in a heap, so that an addition costs a few steps whatever the
    capacity.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.held: dict[object, list[int]] = {}
        self.buckets: dict[int, dict[object, None]] = {}
        self.counts: list[int] = []
        self.evicted = False

    def _put(self, key: object, count: int) -> None:
        if count not in self.buckets:
            self.buckets[count] = {}
            heapq.heappush(self.counts, count)
        self.buckets[count][key] = None

    def _least(self) -> int:
        while not self.buckets.get(self.counts[0]):
            self.buckets.pop(heapq.heappop(self.counts), None)
        return self.counts[0]

    def add(self, key: object, weight: int) -> None:
        if weight <= 0 or not self.capacity:
            self.evicted = self.evicted or weight > 0
            return
        if key in self.held:
            entry = self.held[key]
            del self.buckets[entry[0]][key]
            entry[0] += weight
        elif len(self.held) < self.capacity:
            entry = self.held[key] = [weight, 0]
        else:
            least = self._least()
            out = next(iter(self.buckets[least]))
            del self.buckets[least][out], self.held[out]
            entry = self.held[key] = [least + weight, least]
            self.evicted = True
        self._put(key, entry[0])

    def top(self, k: int | None = None) -> list[tuple[object, int, int]]:
        """(key, count, error), the largest counts first, equal ones by key."""
        return sorted(((key, n, e) for key, (n, e) in self.held.items()), key=lambda x: (-x[1], str(x[0])))[:k]

    def floor(self) -> int:
        """What a key that is not held may weigh at most."""
        return self._least() if self.evicted and self.held else 0


def space_saving(pairs: list[tuple[object, int]], k: int) -> list[tuple[object, int, int]]:
    """(key, count, error) of one pass over ``pairs`` with ``k`` counters."""
    sketch = Sketch(k)
    for key, weight in pairs:
        sketch.add(key, weight)
    return sketch.top()
