"""Indicator lists and their joins with packets: addresses, networks, domains, keywords.

Lists are small tables beside the packets. Containment and suffix tests are rewritten to equality: an address is looked
up once for each prefix length in the list, a name once for each of its label suffixes, so that every join is an
equi-join. A list within BROADCAST_ROWS is broadcast; a longer one is joined by shuffle.
"""

from __future__ import annotations

import functools
import ipaddress
import itertools
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import columns as c

BROADCAST_ROWS = 1_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): entries of a text file."""
    return entries(spark.read.text(path))


def entries(text: DataFrame) -> DataFrame:
    """(n, value): trimmed lines of column value in their order, without blanks and comments."""
    trimmed = text.select(c.trim_blank("value").alias("value"), F.monotonically_increasing_id().alias("n"))
    return trimmed.where("value <> '' and not startswith(value, '#')")


@dataclass(frozen=True)
class Indicators:
    """networks (prefix, network), domains (domain), and the keywords in order."""

    networks: DataFrame
    domains: DataFrame
    keywords: tuple[str, ...] = ()


def networks(entries: DataFrame) -> DataFrame:
    """(prefix, network) of IPv4 addresses and networks in column value; any other entry is an error."""
    parts = F.split("value", "/")
    prefix = F.when(F.size(parts) == 1, 32).when((F.size(parts) == 2) & parts[1].rlike("^[0-9]{1,2}$"), parts[1].try_cast("int"))
    ip = c.parse_ip4(parts[0])
    sound = ip.isNotNull() & prefix.between(0, 32)
    checked = F.when(sound, ip).otherwise(F.raise_error(F.concat(F.lit("not an IPv4 address or network: "), "value")).cast("long"))
    shift = (32 - prefix).cast("int")
    return entries.select(prefix.cast("int").alias("prefix"), F.call_function("shiftright", checked, shift).alias("network")).distinct()


def domains(entries: DataFrame) -> DataFrame:
    name = F.regexp_replace(c.ascii_lower("value"), "\\.$", "")
    return entries.select(name.alias("domain")).where("domain <> ''").distinct()


def keywords(entries: DataFrame) -> tuple[str, ...]:
    """Keywords in file order, as they are, repeats kept. Their number bounds what a scan's expression holds."""
    return tuple(r.value for r in entries.orderBy("n").select("value").collect())


def loaded(spark: SparkSession, ips: str | None = None, names: str | None = None, words: str | None = None) -> Indicators:
    """Indicator lists from text files; none for no path."""
    none = spark.createDataFrame([], "value string, n long")
    of = lambda p: lines(spark, p) if p else none
    return Indicators(networks(of(ips)), domains(of(names)), keywords(of(words)) if words else ())


def of_lists(spark: SparkSession, ips: tuple[str, ...] = (), names: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> Indicators:
    """Indicator lists from values; addresses are checked here."""
    nets = {(n.prefixlen, int(n.network_address) >> (32 - n.prefixlen)) for n in (ipaddress.IPv4Network(x, strict=False) for x in ips)}
    rows = lambda values, schema: spark.createDataFrame(sorted(values), schema)
    return Indicators(
        rows(nets, "prefix int, network long"),
        rows({(x.strip().translate(str.maketrans(c.UPPER, c.LOWER)).removesuffix("."),) for x in names}, "domain string"), tuple(words),
    )


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def blocked(packets: DataFrame, nets: DataFrame, *sides: str) -> DataFrame:
    """``packets`` with blocked_<side> for each address column <side>_ip4: whether a listed network holds it.

    Each distinct address is looked up once, under its network of every length in the list; packets are then joined
    with the addresses found.
    """
    lengths = [r["prefix"] for r in nets.select("prefix").distinct().orderBy("prefix").collect()]  # at most 33
    none = F.lit(False)
    if not lengths:
        return packets.withColumns({f"blocked_{side}": none for side in sides})
    each = None
    for side in sides:
        own = packets.select(F.col(f"{side}_ip4").alias("ip")).where("ip is not null").distinct()
        each = own if each is None else each.unionByName(own)
    places = F.array(*(F.struct(F.lit(p).alias("prefix"), F.shiftright("ip", 32 - p).alias("network")) for p in lengths))
    looked = each.distinct().select("ip", F.explode(places).alias("x")).select("ip", "x.*")
    found = small(looked.join(small(nets), ["prefix", "network"], "left_semi").select("ip").distinct())
    for side in sides:
        flag = f"blocked_{side}"
        hit = found.select(F.col("ip").alias(f"hit {side}"))
        packets = packets.join(hit, F.col(f"{side}_ip4") == F.col(f"hit {side}"), "left").withColumn(flag, F.col(f"hit {side}").isNotNull()).drop(f"hit {side}")
    return packets


def suffixes(name: Column) -> Column:
    """The name and what is left of it behind each of its dots."""
    labels = F.split(name, "\\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))


def listed_domains(names: DataFrame, listed: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Rows of ``names`` (key, name, ...) whose name is listed or ends with a dot and a listed name; once each."""
    each = names.withColumn("suffix", F.explode(suffixes(F.col(name)))).where("suffix <> ''")
    return each.join(small(listed), F.col("suffix") == F.col("domain"), "left_semi").drop("suffix").dropDuplicates([key, name])


#: Keywords up to which one expression tests each; more are searched by an automaton in one pass.
FEW_WORDS = 64


@functools.lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds all words in one pass over Latin-1 text; of equal words the first listed."""
    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        w8 = w.encode().decode("latin-1")
        if w8 and w8 not in out:
            out.add_word(w8, k)
    out.make_automaton()
    return out


def keyword(payload: Column, words: tuple[str, ...], limit: int) -> Column:
    """The keyword that ends first in the first ``limit`` bytes, of those the longest, then the first listed; or null."""
    if not any(words) or limit <= 0:
        return F.lit(None).cast("string")
    text = c.latin1(c.bytes_at(payload, 0, limit))
    if len(words) > FEW_WORDS:

        @F.pandas_udf("string")
        def first(texts: pd.Series) -> pd.Series:
            found = automaton(words)
            # of the words that end at one place the longest comes first
            return pd.Series([None if t is None else next((words[k] for _, k in found.iter(t)), None) for t in texts], dtype=object)

        return first(text)
    found = []
    for k, w in enumerate(words):
        w8 = w.encode().decode("latin-1")
        at = F.instr(text, w8) if w8 else F.lit(0)
        found.append(F.when(at > 0, F.struct((at + len(w8)).alias("end"), F.lit(-len(w8)).alias("size"), F.lit(k).alias("id"), F.lit(w).alias("word"))))
    return F.array_min(F.array(*found))["word"]


def keyword_matches(payload: Column, words: tuple[str, ...], limit: int | None = None, most: int | None = None) -> Column:
    """Array of (id, stop) of all matches of all keywords, overlapping ones too, in one pass: by where they stop, the
    longest first; the first ``limit`` bytes and ``most`` matches, None for all. Null for no payload."""

    @F.pandas_udf("array<struct<id: int, stop: int>>")
    def matches(texts: pd.Series) -> pd.Series:
        found = automaton(words)
        each = lambda t: [{"id": k, "stop": end + 1} for end, k in itertools.islice(found.iter(t), most)] if len(found) else []
        return pd.Series([None if t is None else each(t) for t in texts], dtype=object)

    return matches(c.latin1(payload if limit is None else c.bytes_at(payload, 0, limit)))
