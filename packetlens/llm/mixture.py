"""Mixing sources to target weights by Efraimidis-Spirakis sampling to word budgets.

Each document gets an exponential key, -ln(u) / quality weight, with u from a hash of its id and text: ascending keys
are a weighted sample without replacement, the same in every run. A source's budget is whole epochs of all its
documents, then the documents of smallest keys up to the rest, the last one in part.

The sorted prefix sums need no sorted source in one task: keys are whole numbers (log2 of the exponential key in
steps of 2^-32), and the budget's place is found digit by digit. Each level sums the sizes of at most a few hundred
bins a source, pre-aggregated, takes the prefix sums of the bins and goes on inside the one bin that the budget ends
in. So a source with a third of all rows costs no more than its share of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.llm.common import WORD, durable

#: Bits dropped from the keys at each level; the first leaves 16 bins an octave, each further one splits a bin in 64.
SHIFTS = (28, 22, 16, 10, 4)
WEIGHTS = (3, 1, 2)
#: Sources up to which the plan (one row a source) is broadcast; beyond it, a shuffled join that splits hot sources.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality(text: Column) -> Column:
    """Weight of a document: a quarter, and the share of its code points that are no ASCII signs, digits or space."""
    share = F.length(F.regexp_replace(text, "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]", "")) / F.length(text)
    return F.lit(0.25) + F.when(F.length(text) > 0, share).otherwise(F.lit(0.0))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, sample_key (long) and sample_tie (hash of id and text)."""
    text = F.col("text")
    tie = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring("sample_tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    w = F.greatest(weight if weight is not None else quality(text), F.lit(1e-9))
    key = F.floor(F.log2(-F.log(u) / F.col("sample_weight")) * float(1 << 32))
    return (
        docs.withColumn("size", words(text)).withColumn("sample_tie", tie).withColumn("sample_weight", w)
        .withColumn("sample_key", key.cast("long")).drop("sample_weight")
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with target: ``share`` of all sizes by weight, each at most ``most`` times its size.

    Weights go round the sources by code point, null last. What a source can't take is shared anew among the others,
    one pass over the table of sources a round; the driver sees sums only.
    """
    spark = sources.sparkSession
    ordered = sources.orderBy(F.asc_nulls_last("source")).select("source", "source_size").rdd.zipWithIndex()
    ranked = durable(
        spark.createDataFrame(ordered.map(lambda x: (x[0][0], x[0][1], x[1])), "source string, source_size long, rank long")
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
    )
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget = share * (total or 0)
    level, capped = budget / all_w if all_w else 0.0, -1
    while all_w:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        n, held, free = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not free:
            level = level if free else float("inf")
            break
        level, capped = (budget - held) / free, n
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def plan(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source_size, target, epochs, and the fraction's end: cut_key, cut_tie, part.

    ``keys``: source, size, sample_key, sample_tie. Documents before (cut_key, cut_tie) are taken once more, the one
    at it gives ``part`` words more; rows alike in all of these share what is left evenly.
    """
    sources = durable(keys.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = F.round("target").cast("long")
    whole = targets(sources, weights, share, most)
    budget = durable(
        whole.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (goal - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    few = budget.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    open_ = budget.where("rest > 0").select(F.col("source").alias("of"), F.col("rest").alias("left"), F.lit(None).cast("long").alias("bin"))
    # first[k] is the bin of a level that the budget ends in, and what of the budget is left when it begins
    before = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    last = None
    for shift in SHIFTS:
        same = F.col("source").eqNullSafe(F.col("of"))
        if last is not None:
            same = same & (F.shiftright("sample_key", last) == F.col("bin"))
        bins = keys.join(small(open_), same).groupBy("source", "left", F.shiftright("sample_key", shift).alias("next")).agg(F.sum("size").alias("words"))
        sums = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        open_ = durable(
            sums.where("before < left and before + words >= left")
            .select(F.col("source").alias("of"), (F.col("left") - F.col("before")).alias("left"), F.col("next").alias("bin"))
        )
        last = shift
    same = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("sample_key", last) == F.col("bin"))
    rows = keys.join(small(open_), same).groupBy("source", "left", "sample_key", "sample_tie").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("sample_key", "sample_tie").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        rows.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .where("before < left and before + words >= left")
        .select(
            F.col("source").alias("of"), F.col("sample_key").alias("cut_key"), F.col("sample_tie").alias("cut_tie"),
            F.floor((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("part"),
        )
    )
    out = budget.join(small(cut), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest")
    return durable(out.withColumnRenamed("source", "plan_source"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, weight: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with size, source_size, target, taken and copies.

    taken: words that the mix takes of the document, repeats counted; a source's taken words add up to its target,
    rounded. copies: the same in whole documents, the cut one rounded. Null and empty texts have size 0 and
    nothing is taken; they are copied with their epochs. A null source is a source, the last one. Repeated rows are
    documents of their own and share alike. An empty table gives no rows. New columns replace equally named ones.
    """
    new = ("size", "source_size", "target", "taken", "copies", "sample_key", "sample_tie", "epochs", "cut_key", "cut_tie", "part", "plan_source")
    keep = [c for c in (keep or docs.columns) if c not in new]
    whole = keyed(docs.select([c for c in docs.columns if c not in new]), weight)
    slim = durable(whole.select("doc_id", "source", "size", "sample_key", "sample_tie"))
    by_source = plan(slim, weights, share, most)
    by_source = F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source
    rows = slim if set(keep) <= set(slim.columns) else whole
    joined = rows.join(by_source, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    earlier = (F.col("sample_key") < F.col("cut_key")) | ((F.col("sample_key") == F.col("cut_key")) & (F.col("sample_tie") < F.col("cut_tie")))
    here = (F.col("sample_key") == F.col("cut_key")) & (F.col("sample_tie") == F.col("cut_tie"))
    more = F.when(earlier, F.col("size")).when(here, F.col("part")).otherwise(F.lit(0).cast("long"))
    once = F.when(earlier | (here & (2 * F.col("part") >= F.col("size"))), 1).otherwise(0)
    return joined.select(
        *keep, "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + more).alias("taken"), (F.col("epochs") + once).alias("copies"),
    )


def oracle() -> str:
    """DuckDB SQL for ``mixed`` with its defaults: one window over each whole source instead of levels of bins."""
    return r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as tie,
    0.25::double + case when length(text) > 0
      then length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::double / length(text) else 0.0::double end as w
  from documents),
k as (
  select *, floor(log2(-ln((('0x' || substr(tie, 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / w) * 4294967296.0::double)::bigint as key from d),
s0 as (select source, sum(size)::bigint as source_size from k group by source),
s1 as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as sw, 2 * source_size as cap from s0),
s2 as (
  select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as held,
    row_number() over o as nth, sum(sw) over (o rows between current row and unbounded following) as free, (select 1.5::double * sum(source_size) from s0) as budget
  from s1 window o as (order by cap::double / sw, source nulls last)),
lv as (select arg_min((budget - held::double) / free::double, nth) filter (where cap::double > (budget - held::double) / free::double * sw) as level from s2),
s3 as (select source, source_size, case when level is null then cap::double else least(cap::double, level * sw) end as target from s2, lv),
s4 as (select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as epochs from s3),
c as (
  select k.*, s4.source_size, s4.target, s4.epochs, round(s4.target)::bigint - s4.epochs * s4.source_size as rest,
    coalesce(sum(size) over (partition by k.source order by key, tie rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from k join s4 on k.source is not distinct from s4.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from c
"""
