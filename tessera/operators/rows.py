"""Dense numbering and duplicate removal without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sorted_parts(df: DataFrame, order: list, folder: str) -> DataFrame:
    """``df`` stored in the given order; ``_at`` is partition and place in it."""
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _with_offsets(placed: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``placed`` with ``_before``, the sum of the sizes of the partitions before its
    own; only one number per written partition passes the driver."""
    before, table = 0, []
    for part, size in sorted(sizes):
        table.append((part, before))
        before += size
    offsets = F.broadcast(placed.sparkSession.createDataFrame(table, "_part long, _before long"))  # one row per partition
    return placed.withColumn("_part", F.shiftright("_at", 33).cast("long")).join(offsets, "_part")


def _numbered(placed: DataFrame, sizes: list[tuple[int, int]], name: str) -> DataFrame:
    return _with_offsets(placed, sizes).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def dense_numbers(df: DataFrame, order: list, name: str, folder: str, measures: dict | None = None):
    """``df`` numbered 0..n-1 in the given order. The sorted rows are written to
    ``folder`` once; only the row count of each written partition reaches the
    driver, and the numbers are offset + place. With ``measures`` (name to
    aggregate) a list of one row for each partition comes too, from the same pass."""
    placed = _sorted_parts(df, order, folder)
    more = [c.alias(k) for k, c in (measures or {}).items()]
    found = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), *more).collect()
    out = _numbered(placed, [(r["_part"], r["_rows"]) for r in found], name)
    return out if measures is None else (out, found)


def prefix_sums(df: DataFrame, order: list, size: str, name: str, folder: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before each one in the given
    order: inside each sorted partition, and over the partitions before it."""
    placed = _sorted_parts(df, order, folder)
    part = F.shiftright("_at", 33)
    found = placed.groupBy(part.alias("_part")).agg(F.sum(size).alias("_rows")).collect()
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_offsets(placed, [(r["_part"], r["_rows"] or 0) for r in found])
    return joined.withColumn(name, F.col("_before") + F.sum(size).over(within) - F.col(size)).drop("_part", "_before", "_at")


def drop_duplicates(df: DataFrame, text: str, seq: str) -> DataFrame:
    """The first row (lowest ``seq``, unique) of each distinct text. Only digests
    are grouped, with partial aggregation, so a text that is a third of all rows
    is one row per task."""
    firsts = df.groupBy(F.sha2(F.col(text), 256).alias("_digest")).agg(F.min(seq).alias(seq)).select(seq)
    return df.join(firsts, seq, "left_semi")
