"""Paired comparisons: one t-test per group, all groups in one aggregate."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col, ratio
from trialstats.functions.distributions import noncentral_t_limits, t_p_value
from trialstats.functions.text import paired_sentence
from trialstats.operators.reshape import pivot_wider


def _moments(difference: Column) -> list[Column]:
    return [
        F.count(difference).alias("n"),
        F.avg(difference).alias("mean_diff"),
        F.stddev_samp(difference).alias("sd_diff"),
    ]


def _test(moments: DataFrame, keys: Sequence[str], alternative: str) -> DataFrame:
    n, mean, sd = F.col("n"), F.col("mean_diff"), F.col("sd_diff")
    # differences that are constant up to rounding have no t
    varies = (sd > 0) & (sd > 10 * sys.float_info.epsilon * F.abs(mean) * F.sqrt(n))
    out = moments.select(
        *keys,
        "n",
        "mean_diff",
        "sd_diff",
        F.when(varies, ratio(mean * F.sqrt(n), sd)).alias("t"),
        F.when(n >= 2, n - 1).alias("df"),
        F.when(varies, ratio(mean, sd)).alias("dz"),
    )
    return out.withColumn("p_value", t_p_value("t", "df", alternative))


def paired_t(
    df: DataFrame, x: ColumnLike, y: ColumnLike, keys: Sequence[str] = (), alternative: str = "two.sided"
) -> DataFrame:
    """Paired t-test of x against y per group, with dz; incomplete pairs drop out.

    Fewer than two pairs, or constant differences, give NULL statistics.
    """
    difference = as_col(x) - as_col(y)
    return _test(df.groupBy(*keys).agg(*_moments(difference)), keys, alternative)


def paired_t_long(
    df: DataFrame,
    unit: Sequence[str],
    condition: str,
    value: str,
    levels: tuple[str, str],
    keys: Sequence[str] = (),
    alternative: str = "two.sided",
) -> DataFrame:
    """Paired t-test on long data: first level minus second, paired by unit, not by row order."""
    rows = df.filter(F.col(condition).isin(*levels))  # the test is between these two
    wide = pivot_wider(rows, [*keys, *unit], condition, value, levels)
    return paired_t(wide, levels[0], levels[1], keys, alternative)


def with_effect_limits(tests: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the confidence limits of dz, from the noncentrality limits of t."""
    out = tests.withColumn("_limits", noncentral_t_limits("t", "df", level))
    root = F.sqrt("n")
    return (
        out.withColumn("dz_low", ratio("_limits.low", root))
        .withColumn("dz_high", ratio("_limits.high", root))
        .drop("_limits")
    )


def paired_report(tests: DataFrame) -> DataFrame:
    """Add the one-line report text to a paired test with effect limits."""
    if "dz_low" not in tests.columns:
        tests = with_effect_limits(tests)
    return tests.withColumn("report", paired_sentence("df", "t", "p_value", "dz", "dz_low", "dz_high"))
