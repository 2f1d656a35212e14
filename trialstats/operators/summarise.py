"""Grouped aggregation operators. Missing inputs make a result missing unless stated otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.functions.columns import correlation, ratio, strict_avg, strict_sd, strict_se, strict_sum
from trialstats.functions.distributions import t_p_value
from trialstats.functions.products import pair_moments
from trialstats.operators.linking import null_safe_join, one_row
from trialstats.sources.tables import written

# Fixed value: makes the median absolute deviation estimate a normal standard deviation.
MAD_SCALE = 1.4826


def mean_by(df: DataFrame, keys: Sequence[str], **values: str) -> DataFrame:
    """Strict mean per group; ``values`` maps result name to input column."""
    return df.groupBy(*keys).agg(*[strict_avg(c).alias(name) for name, c in values.items()])


def score(df: DataFrame, keys: Sequence[str], value: str = "value", name: str | None = None) -> DataFrame:
    """Strict sum of item values per group, tagged with the instrument's name if given."""
    out = df.groupBy(*keys).agg(strict_sum(value).alias("score"))
    return out if name is None else out.withColumn("ques", F.lit(name))


def demographics(df: DataFrame, subject: str, male: str, age: str) -> DataFrame:
    """Subjects, male count, mean and sd of age over the distinct subjects of a trial log."""
    return (
        df.select(subject, male, age)
        .distinct()
        .agg(
            F.count(F.lit(1)).alias("n"),
            strict_sum(male).cast("long").alias("male"),
            strict_avg(age).alias("mean_age"),
            strict_sd(age).alias("sd_age"),
        )
    )


def missing_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Missing values per group, most first."""
    counts = df.filter(F.col(value).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *keys)


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; a missing key is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def levels_by_appearance(df: DataFrame, label: str, order_by: str) -> DataFrame:
    """Labels with their rank of first appearance in a named order (one row per label).

    There may be as many labels as subjects, so no task ranks them all: they are dealt over partitions by ranges of
    first appearance, ranked within each, and shifted by the numbers of labels before.
    """
    first = df.groupBy(label).agg(F.min(order_by).alias("first"))
    dealt = written(first.repartitionByRange("first", label).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("first", label))
    ranked = dealt.withColumn("_inside", inside).join(F.broadcast(parts), "_part")
    return ranked.select(label, "first", (F.col("_before") + F.col("_inside")).cast("int").alias("rank"))


def any_by(df: DataFrame, keys: Sequence[str], condition: Column, name: str) -> DataFrame:
    """Whether any row of a group satisfies a condition."""
    return df.groupBy(*keys).agg(F.bool_or(condition).alias(name))


def tally_summary(df: DataFrame, unit: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows per unit, then mean and sd of those counts; units without rows do not enter."""
    counts = df.groupBy(*by, *unit).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.avg("_n").alias("mean"), F.stddev_samp("_n").alias("sd"))


def two_level(
    df: DataFrame, by: Sequence[str], unit: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Trials to unit means, then mean and sd of the unit means (never one pooled mean)."""
    units = df.groupBy(*by, *unit).agg(*[strict_avg(v).alias(v) for v in values])
    stats = [fn(v).alias(f"{v}_{name}") for v in values for name, fn in (("mean", strict_avg), ("sd", strict_sd))]
    return units.groupBy(*by).agg(*stats)


def mean_se(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error, and the mean +/- one standard error, over non-missing values."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), strict_se(value).alias("se")
    )
    return out.withColumn("low", F.col("mean") - F.col("se")).withColumn("high", F.col("mean") + F.col("se"))


def robust_summary(df: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """Mean, median, sd, scaled MAD, min and max of counts per group (missing keys are a group).

    The counts are first reduced to a histogram per group, so the exact medians weigh distinct values. The medians,
    one row per group, are joined back to the histogram for the deviations; no group is gathered in one row.
    """
    histogram = df.groupBy(*by, count).agg(F.count(F.lit(1)).alias("_freq"))
    x, freq = F.col(count), F.col("_freq")
    first = histogram.groupBy(*by).agg(
        F.percentile(x, 0.5, freq).alias("_median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.sum(x * freq) / F.sum(freq)).alias("_mean"),
        F.sum(freq).alias("_n"),
    )
    keep = ["_median", "min", "max", "_mean", "_n"]
    deviation = F.abs(x - F.col("_median"))
    joined = null_safe_join(histogram, first, by) if by else histogram.join(F.broadcast(one_row(first)))
    out = joined.groupBy(*by, *keep).agg(
        (F.percentile(deviation, 0.5, freq) * MAD_SCALE).alias("mad"),
        F.sum(freq * F.pow(x - F.col("_mean"), 2)).alias("_ss"),
    )
    return out.select(
        *by,
        F.col("_mean").alias("mean"),
        F.col("_median").alias("median"),
        F.when(F.col("_n") > 1, F.sqrt(ratio("_ss", F.col("_n") - 1))).alias("sd"),
        "mad",
        "min",
        "max",
    )


def _pair_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str], stats) -> DataFrame:
    pairs = list(combinations(columns, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), *stats(a, b)) for a, b in pairs])
    return df.groupBy(*keys).agg(cells.alias("_pairs")).select(*keys, F.inline("_pairs"))


#: Columns from which pairs come from blocked matrix products; the expressions of one aggregate grow with their square.
WIDE = 12


def _wide_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Moments of every pair x before y, with the columns' names."""
    name = lambda place: F.get(F.array(*[F.lit(c) for c in columns]), F.col(place))
    return pair_moments(df, columns, keys).filter("i < j").withColumns({"x": name("i"), "y": name("j")})


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), wide: int = WIDE) -> DataFrame:
    """Pearson correlation of every column pair over its complete rows, with n and p.

    All pairs come from one aggregate over one scan; from ``wide`` columns on, from blocked matrix products, which also
    take NaN as missing.
    """

    def stats(a: str, b: str) -> list[Column]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return [
            F.count(F.when(both, F.lit(1))).alias("n"),
            correlation(a, b).alias("r"),
        ]

    if len(columns) < wide:
        out = _pair_table(df, columns, keys, stats)
    else:
        r = F.when(F.col("n") > 1, ratio("sxy", F.sqrt("sxx") * F.sqrt("syy")))
        out = _wide_pairs(df, columns, keys).select(*keys, "x", "y", "n", r.alias("r"))
    dof = F.col("n") - 2
    t = F.col("r") * F.sqrt(ratio(dof, 1 - F.col("r") * F.col("r")))
    usable = (dof > 0) & (F.abs(F.col("r")) < 1)
    return out.withColumn("t", F.when(usable, t)).withColumn("p_value", t_p_value(F.col("t"), dof))


def pair_regressions(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), wide: int = WIDE) -> DataFrame:
    """Fitted line of every column pair (y on x): slope, intercept and r squared; wide tables as in ``correlations``."""
    if len(columns) >= wide:
        slope = F.when(F.col("n") > 1, ratio("sxy", "sxx"))
        r2 = F.when(F.col("n") > 1, ratio(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
        intercept = F.col("mean_y") - slope * F.col("mean_x")
        return _wide_pairs(df, columns, keys).select(*keys, "x", "y", "n", slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"))

    def stats(a: str, b: str) -> list[Column]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        slope = ratio(F.covar_samp(x, y), F.var_samp(x))
        return [
            F.count(F.when(both, F.lit(1))).alias("n"),
            slope.alias("slope"),
            (F.avg(y) - slope * F.avg(x)).alias("intercept"),
            F.pow(correlation(a, b), 2).alias("r2"),
        ]

    return _pair_table(df, columns, keys, stats)
