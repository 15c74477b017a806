"""Mixing sources to target weights as a time-varying curriculum.

Training time runs from 0 to 1. A source with weight w follows the schedule
w * (1 + slope * (2t - 1)); its integral over the run is w, and its cumulative
token demand at t is target * ((1 - slope) * t + slope * t**2). Documents are
consumed in the order of a hash of their id; the position of a copy is the
time at which the source's demand reaches the tokens that stand before it,
found by inverting the demand in closed form. The result is range-sorted by
position.

Order within a source comes from distributed prefix sums: words are summed by
hash bucket (about the square root of the rows in number), bucket totals are
accumulated per source, and only then are rows accumulated inside each bucket.
A source that holds a third of all rows is thus spread over all its buckets.

Defined results
* null text has size 0; a null source is a source of its own, last in order;
* a null doc_id is hashed as the empty id; rows repeated with the same doc_id
  are documents of their own and follow one another;
* a document of size 0 takes 0 words; an empty table gives an empty result;
* targets are computed from one row per source (one small task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
BUDGET = 1.5
MOST = 2
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, slopes=SLOPES, budget=BUDGET, most=MOST) -> DataFrame:
    """Water-filling over (source, source_size): the level at which capped and
    uncapped sources together take ``budget`` times all words."""
    n = len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((F.col("r") - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("source", "source_size", "r", pick(weights).alias("weight"), pick(slopes).alias("slope"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "r").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("r"), F.col("level").alias("level")))).over(every)["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size", "weight", "slope", F.when(F.col("weight") * F.col("final") > F.col("cap"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target")
    )


def _sized(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
        F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")).alias("key"),
        *more,
    )


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, slopes=SLOPES, budget=BUDGET, most=MOST) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source): size,
    source_size, target, taken, copies and the training position of each copy
    (``positions``, ascending; empty if the mix leaves the document out)."""
    rows = workspace.materialise(_sized(docs), "mix-sizes")
    out = _mix(rows, rows, weights, slopes, budget, most)
    # Left-out documents follow the run, spread by their hash.
    when = F.coalesce(F.try_element_at("positions", F.lit(1)), 1.0 + F.conv(F.substring("place", 1, 12), 16, 10).cast("double") / float(1 << 48))
    return out.select("doc_id", "size", "source_size", "target", "taken", "positions", when.alias("when")).orderBy("when", "doc_id").drop("when")


def mixed_documents(docs: DataFrame, *, weights=WEIGHTS, slopes=SLOPES, budget=BUDGET, most=MOST) -> DataFrame:
    """The rows of ``docs``, all columns, once per copy that the mix takes, in
    training order. Documents of size 0 take no part in training."""
    small = workspace.materialise(_sized(docs), "mix-sizes")
    out = _mix(small, _sized(docs, F.struct("*").alias("row")), weights, slopes, budget, most, "row")
    return out.select("row", "doc_id", F.explode("positions").alias("position")).orderBy("position", "doc_id").select("row.*")


def _mix(small: DataFrame, rows: DataFrame, weights, slopes, budget, most, *extra) -> DataFrame:
    """Copies and positions of ``rows``; ``small`` is the same table without its texts."""
    digits = max(1, min(8, math.ceil(math.log(max(1, small.count()), 16) / 2)))
    bucket = F.substring("place", 1, digits)
    rows = rows.withColumn("bucket", bucket)
    totals = workspace.materialise(small.withColumn("bucket", bucket).groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, slopes=slopes, budget=budget, most=most)
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n"))).drop("source")
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(sources, "key").select(
        "key", "bucket", "ahead", "source_size", "target", "slope"
    )
    within = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["key", "bucket"]).withColumn("start", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = (F.col("passes") < most) & (F.col("size") > 0) & (F.col("start") + F.col("size") / 2.0 < rest)
    taken = placed.withColumn("passes", passes).withColumn("copies", (F.col("passes") + F.when(more, 1).otherwise(0)).cast("long"))

    def position(copy):
        share = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("start")) / F.col("target"))
        flat = 1.0 - F.col("slope")
        return 2.0 * share / (flat + F.sqrt(flat * flat + 4.0 * F.col("slope") * share))

    copies = F.when((F.col("copies") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")), position)).otherwise(F.array().cast("array<double>"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), copies.alias("positions"), "place", *extra)


def training_order(mixed: DataFrame) -> DataFrame:
    """(doc_id, copy, position), one row for each copy, in training order."""
    return mixed.select("doc_id", F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(cast(doc_id as varchar), '')) as place
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select source, source_size, row_number() over (order by source nulls last) as r from s),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((r - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as cap from r),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0.0::double))
              / (sum(weight) over () - coalesce(sum(weight) over b, 0.0::double)) as level
      from w window b as (order by cap / weight, r rows between unbounded preceding and 1 preceding)),
f as (select level as final from l where cap / weight >= level order by cap / weight, r limit 1),
t as (select source, source_size, case when weight * final > cap then cap else weight * final end as target from l, f),
p as (select d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) over (partition by d.source order by d.place, d.doc_id, d.size rows unbounded preceding) - d.size as start
      from d join t on d.source is not distinct from t.source),
q as (select *, case when source_size > 0 then least(2, floor(target / source_size)) else 0 end as passes from p)
select doc_id, size, source_size, target,
       cast(size * (passes + case when passes < 2 and size > 0 and start + size / 2.0::double < target - passes * source_size then 1 else 0 end) as bigint) as taken
from q
"""
