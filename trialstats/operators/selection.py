"""Exact ranks, medians and median deviations per group, by narrowing intervals of values.

No group is sorted, gathered or kept as a histogram. Every group has an open interval that holds the value of its rank.
A round sketches the values inside (a bounded quantile sketch), takes four points around the rank, and counts exactly
how many values lie below and on each. The rank is then on a point, which ends the search, or between two of them: about a
hundredth of the values, whatever their distribution, and never a value of more than that share of them, as such a value is
a point itself. The values inside are written and the next round reads only them. At most SMALL values are put in one array.

All counts are plain aggregates with map-side sums, so a hot group costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col
from trialstats.operators.linking import group_join, null_safe_join, one_row
from trialstats.sources.tables import written

#: Values of one group that are sorted in one array.
SMALL = 8192
#: Points of a sketch, and its rank accuracy.
POINTS = 128
ACCURACY = 10_000
#: Fixed value: makes the median absolute deviation estimate a normal standard deviation.
MAD_SCALE = 1.4826
NEAR = range(4)


def _joined(rows: DataFrame, state: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    return group_join(rows, state, list(keys), size)


def _by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables of one row per group, side by side; a missing key is a key."""
    return null_safe_join(left, right, keys) if keys else left.crossJoin(F.broadcast(one_row(right)))


def _counts(point: Column) -> list[Column]:
    x = F.col("_x")
    return [F.count(F.when(x < point, 1)), F.count(F.when(x == point, 1))]


def value_at_rank(df: DataFrame, keys: Sequence[str], value: ColumnLike, rank: Column, small: int = SMALL) -> DataFrame:
    """``keys, n, rank, at`` and ``upto``: the value of ``rank`` (from 0, an expression of ``n``) among a group's non-missing
    values, and how many values are at most it.

    NaN counts as the largest value. A group without values has no row.
    """
    keys = list(keys)
    rows = df.select(*keys, as_col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    shares = [i / POINTS for i in range(POINTS + 1)]
    sketch = F.percentile_approx("_x", shares, ACCURACY).alias("_grid")
    inside = rows.filter(~F.isnan("_x"))
    number = F.count(F.when(~F.isnan("_x"), 1)).alias("_inside")
    sketch_of_numbers = F.percentile_approx(F.when(~F.isnan("_x"), F.col("_x")), shares, ACCURACY).alias("_grid")
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), number, sketch_of_numbers)
    state = written(state.withColumns({"rank": rank.cast("long"), "_below": F.lit(0).cast("long")}))
    none = state.filter(F.col("rank") >= F.col("_inside")).select(*keys, "n", "rank", F.lit(float("nan")).alias("at"), F.col("n").alias("upto"))
    state, done = state.filter(F.col("rank") < F.col("_inside")), [none]
    while True:
        few = state.filter(F.col("_inside") <= small)
        many = state.filter(F.col("_inside") > small)
        done.append(_sorted(inside, few, keys))
        if many.isEmpty():
            break
        cell = F.floor((F.col("rank") - F.col("_below")) / F.col("_inside") * POINTS).cast("int")
        chosen = [F.get("_grid", F.greatest(F.least(cell + (j - 1), F.lit(POINTS)), F.lit(0))).alias(f"_p{j}") for j in NEAR]
        points = written(many.select(*keys, "n", "rank", "_below", "_inside", *chosen))
        met = _joined(inside, points.select(*keys, "_inside", *[f"_p{j}" for j in NEAR]), keys, "_inside")
        sums = [c.alias(f"_{name}{j}") for j in NEAR for name, c in zip(("less", "equal"), _counts(F.col(f"_p{j}")), strict=True)]
        told = written(_by(points, met.groupBy(*keys).agg(*sums), keys))
        seen = F.col("rank") - F.col("_below")
        hit = F.lit(None).cast("struct<at:double,upto:bigint>")
        for j in NEAR:
            on = (seen >= F.col(f"_less{j}")) & (seen < F.col(f"_less{j}") + F.col(f"_equal{j}"))
            hit = F.when(on, F.struct(F.col(f"_p{j}").alias("at"), (F.col("_below") + F.col(f"_less{j}") + F.col(f"_equal{j}")).alias("upto"))).otherwise(hit)
        told = told.withColumn("_hit", hit)
        done.append(told.filter("_hit IS NOT NULL").select(*keys, "n", "rank", "_hit.at", "_hit.upto"))
        # the open interval between the last point passed and the next
        left = told.filter("_hit IS NULL")
        lower, upper, before, upto = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long"), F.col("_inside")
        for j in NEAR:
            passed = seen >= F.col(f"_less{j}") + F.col(f"_equal{j}")
            lower, before = F.when(passed, F.col(f"_p{j}")).otherwise(lower), F.when(passed, F.col(f"_less{j}") + F.col(f"_equal{j}")).otherwise(before)
        for j in reversed(NEAR):
            ahead = seen < F.col(f"_less{j}")
            upper, upto = F.when(ahead, F.col(f"_p{j}")).otherwise(upper), F.when(ahead, F.col(f"_less{j}")).otherwise(upto)
        narrow = written(left.select(*keys, "n", "rank", (F.col("_below") + before).alias("_below"), (upto - before).alias("_inside"), lower.alias("_lo"), upper.alias("_hi")))
        if narrow.isEmpty():
            break
        met = _joined(inside, narrow.select(*keys, "_inside", "_lo", "_hi"), keys, "_inside")
        between = (F.col("_lo").isNull() | (F.col("_x") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi")))
        inside = written(met.filter(between).select(*keys, "_x"))
        state = written(_by(narrow.drop("_lo", "_hi"), inside.groupBy(*keys).agg(sketch), keys))
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out


def _sorted(inside: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value of the rank for groups with a small array's worth of values left."""
    met = _joined(inside, few.select(*keys, "n", "rank", "_below", "_inside"), keys, "_inside")
    gathered = met.groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_all"), *[F.first(c).alias(c) for c in ("n", "rank", "_below")])
    at = F.get("_all", (F.col("rank") - F.col("_below")).cast("int"))
    upto = F.col("_below") + F.size(F.filter("_all", lambda v: v <= at))
    return gathered.filter("n IS NOT NULL").select(*keys, "n", "rank", at.alias("at"), upto.alias("upto"))


def medians(df: DataFrame, keys: Sequence[str], value: ColumnLike, name: str = "median", small: int = SMALL) -> DataFrame:
    """``keys``, ``n`` and the exact median of a group's non-missing values."""
    keys = list(keys)
    rows = df.select(*keys, as_col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    lower = written(value_at_rank(rows, keys, "_x", F.floor((F.col("n") - 1) / 2), small))
    # with an even number, the next value counts too: the same one again, or the smallest larger one
    short = lower.filter((F.col("n") % 2 == 0) & (F.col("upto") <= F.col("rank") + 1)).select(*keys, "n", "at")
    larger = F.min(F.when(F.col("_x") > F.col("at"), F.col("_x"))).alias("_next")
    following = _joined(rows, short, keys, "n").groupBy(*keys).agg(larger)
    both = null_safe_join(lower, following, keys, "left") if keys else lower.join(following, F.lit(True), "left")
    middle = F.col("at") + (F.coalesce("_next", "at") - F.col("at")) / 2
    return both.select(*keys, "n", F.when(F.col("at") == F.col("_next"), F.col("at")).otherwise(middle).alias(name))


def robust_summary(df: DataFrame, by: Sequence[str], value: ColumnLike, small: int = SMALL) -> DataFrame:
    """Mean, median, sd, scaled MAD, min and max per group, for any number of distinct values; missing values are left out.

    ``summarise.robust_summary`` gives the same in one pass for counts with few distinct values per group.
    """
    by = list(by)
    rows = df.select(*by, as_col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    middle = written(medians(rows, by, "_x", small=small))
    apart = _joined(rows, middle.withColumnRenamed("median", "_median"), by, "n").select(*by, F.abs(F.col("_x") - F.col("_median")).alias("_d"))
    spread = medians(apart, by, "_d", "_mad", small).drop("n")
    plain = rows.groupBy(*by).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    out = _by(_by(middle, spread, by), plain, by)
    return out.select(*by, "mean", "median", "sd", (F.col("_mad") * MAD_SCALE).alias("mad"), "min", "max")
