"""Multiplicity adjustment and step-to-step differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.operators.linking import null_safe_join
from trialstats.sources.tables import written


def holm_values(p: Column) -> Column:
    """Holm-adjusted values of a short array of p-values (the terms of one model), in its order."""

    def steps_up_to(limit: Column) -> Column:
        smaller = F.filter(p, lambda q: q <= limit)
        known = F.size(F.filter(p, lambda q: q.isNotNull()))
        return F.array_max(
            F.transform(smaller, lambda q: q * (known - F.size(F.filter(p, lambda other: other < q))))
        )

    return F.transform(p, lambda v: F.when(v.isNotNull(), F.least(F.lit(1.0), steps_up_to(v))))


def holm_adjust(df: DataFrame, p: str, family: Sequence[str] = (), name: str = "p_adj") -> DataFrame:
    """Add Holm-adjusted p-values within each family (missing keys are one), for families of any size.

    The adjusted value is the running maximum of (n - number of smaller p) * p, capped at one. It depends on distinct
    p-values only, so ties collapse first. These are dealt over partitions by ranges of family and p, of even size
    whatever the values; each partition ranks its own, and one row per family and partition carries counts and
    maxima across. The rows and the distinct values are written once, so p-values are computed once and the ranges
    are fixed.
    """
    family = list(family)
    base = written(df)
    value = F.col(p)
    distinct = base.filter(value.isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_rows"))
    distinct = written(distinct.repartitionByRange(*family, p).withColumn("_part", F.spark_partition_id()))
    over_parts = Window.partitionBy(*family).orderBy("_part")
    whole = Window.partitionBy(*family)
    before = over_parts.rowsBetween(Window.unboundedPreceding, -1)
    parts = distinct.groupBy(*family, "_part").agg(F.sum("_rows").alias("_in_part"))
    parts = parts.select(
        *family,
        "_part",
        F.coalesce(F.sum("_in_part").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_part").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*family, "_part").orderBy(p)
    earlier = F.coalesce(F.sum("_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = null_safe_join(distinct, parts, [*family, "_part"]).withColumn(
        "_step", (F.col("_total") - F.col("_before") - earlier) * value
    )
    ranked = ranked.withColumn(
        "_running", F.max("_step").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    peaks = ranked.groupBy(*family, "_part").agg(F.max("_step").alias("_peak"))
    peaks = peaks.select(*family, "_part", F.max("_peak").over(before).alias("_earlier_peak"))
    adjusted = null_safe_join(ranked, peaks, [*family, "_part"]).select(
        *family, p, F.least(F.lit(1.0), F.greatest("_running", "_earlier_peak")).alias(name)
    )
    return null_safe_join(base, adjusted, [*family, p], "left").select(*df.columns, name)


def lag_difference(df: DataFrame, value: str, order_by: str, keys: Sequence[str] = (), name: str = "diff") -> DataFrame:
    """Value minus the value of the previous step of its group, in a named order.

    Meant for step tables (one row per group and step), whose groups are as short as the step list.
    """
    window = Window.partitionBy(*keys).orderBy(order_by)
    return df.withColumn(name, F.col(value) - F.lag(value).over(window))
