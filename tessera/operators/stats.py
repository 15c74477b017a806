"""Percentiles, latency lines and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import dense_numbers


def nearest_ranks(df: DataFrame, groups: list[str], column: str, ps: dict[str, float], folder: str) -> DataFrame:
    """One row per group with a column for each of ``ps`` (name to percentile): the
    value at place ceil(p / 100 * n), clamped to 1..n. Values are sorted and
    numbered over the cluster; no group is gathered anywhere. Nulls do not count."""
    kept = df.where(F.col(column).isNotNull()).select(*groups, column)
    numbered = dense_numbers(kept, [*groups, column], "_row", folder)
    starts = numbered.groupBy(*groups).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    pick = {k: F.col("_first") + F.greatest(F.lit(1), F.ceil(F.lit(min(max(p, 0.0), 100.0)) * F.col("_n") / 100.0)).cast("long") - 1 for k, p in ps.items()}
    if not groups:
        return numbered.join(F.broadcast(starts)).groupBy().agg(*[F.max(F.when(F.col("_row") == at, F.col(column))).alias(k) for k, at in pick.items()])
    # Groups meet their rows by number alone: one row per group and percentile is asked for.
    asked = starts.select(*groups, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), at.alias("_row")) for k, at in pick.items()])).alias("x")).select(*groups, "x.name", "x._row")
    found = asked.join(numbered.select("_row", column), "_row")
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == k, F.col(column))).alias(k) for k in ps])


def latency_report(df: DataFrame, column: str, folder: str) -> DataFrame:
    """p50, p99, n and queries per second (n over the sum) of a column of seconds."""
    ranks = nearest_ranks(df, [], column, {"p50": 50, "p99": 99}, folder)
    total = F.sum(column)
    totals = df.agg(F.count(column).alias("n"), F.when(total > 0, F.count(column) / total).otherwise(0.0).alias("qps"))
    return ranks.join(F.broadcast(totals)).select("p50", "p99", "n", "qps")  # one row each


def rate(count, seconds) -> Column:
    """count / seconds, 0 where no time passed."""
    c, s = (F.col(x) if isinstance(x, str) else x for x in (count, seconds))
    return F.when(s > 0, c / s).otherwise(0.0)


def with_rates(report: DataFrame) -> DataFrame:
    """A report with tokens, chunks and MiB a second and microseconds a vector."""
    return (
        report.withColumn("tokens_per_sec", rate("tokens", "seconds"))
        .withColumn("chunks_per_sec", rate("chunks", "seconds"))
        .withColumn("mib_per_sec", rate(F.col("bytes") / 1048576.0, F.col("seconds")))
        .withColumn("micros_per_vector", F.when(F.col("embedded") > 0, F.col("embed_nanos") / 1000.0 / F.col("embedded")).otherwise(0.0))
    )
