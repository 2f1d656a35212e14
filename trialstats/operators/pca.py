"""Principal components of standardised columns, per group.

One aggregate gives every group's means, deviations and correlation matrix; the eigenvectors of that
small matrix come from one batched call per Arrow batch of groups; scores are a join of the group table
back to the rows. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.columns import correlation, ratio
from trialstats.functions.linalg import decompose_correlations
from trialstats.functions.products import pair_moments
from trialstats.operators.linking import HOT_ROWS, group_join


def _complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


#: Columns from which the correlations come from blocked matrix products.
WIDE = 12


def fit_pca(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), wide: int = WIDE) -> DataFrame:
    """One row per group: n, means, sds, corr (flattened), variances, loadings (one array per component)."""
    columns = list(columns)
    if len(columns) >= wide:
        stats = _wide_stats(_complete_rows(df, columns), columns, keys)
        return stats.withColumn("_fit", decompose_correlations("corr")).select("*", "_fit.*").drop("_fit")
    upper = {(i, j): correlation(columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))}

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        return upper[(min(i, j), max(i, j))]

    size = range(len(columns))
    stats = _complete_rows(df, columns).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.stddev_samp(c) for c in columns]).alias("sds"),
        F.array(*[cell(i, j) for i in size for j in size]).alias("corr"),
    )
    return stats.withColumn("_fit", decompose_correlations("corr")).select("*", "_fit.*").drop("_fit")


def _wide_stats(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """n, means, sds and corr of complete rows from pair moments; p^2 numbers of a group meet in its one row."""
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(ratio("sxy", F.sqrt("sxx") * F.sqrt("syy")))
    both = F.array_distinct(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    cells = pair_moments(rows, columns, keys).select(
        *keys, "n", F.col("mean_x").alias("mean"), F.sqrt(ratio("sxx", F.col("n") - 1)).alias("sd"), r.alias("r"), F.explode(both).alias("at")
    )
    ordered = lambda value, where=None: F.transform(F.array_sort(F.collect_list(F.when(where, value) if where is not None else value)), lambda c: c["v"])
    own = F.col("at.i") == F.col("at.j")
    out = cells.groupBy(*keys).agg(
        F.max("n").alias("n"),
        ordered(F.struct("at.i", F.col("mean").alias("v")), own).alias("means"),
        ordered(F.struct("at.i", F.col("sd").alias("v")), own).alias("sds"),
        ordered(F.struct("at.i", "at.j", F.col("r").alias("v"))).alias("corr"),
    )
    return out.filter("n IS NOT NULL")


def importance(fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per component: standard deviation, share of variance, cumulative share."""
    total = F.aggregate("variances", F.lit(0.0), lambda acc, v: acc + v)
    rows = fit.withColumn("_total", total).select(
        *keys, "_total", "variances", F.posexplode("variances").alias("_pos", "_variance")
    )
    running = F.aggregate(F.slice("variances", F.lit(1), F.col("_pos") + 1), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        *keys,
        (F.col("_pos") + 1).alias("component"),
        F.sqrt("_variance").alias("sdev"),
        ratio("_variance", "_total").alias("proportion"),
        ratio(running, "_total").alias("cumulative"),
    )


def loadings(fit: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long table of loadings per component and variable, with the arrow length (loading x sdev)."""
    rows = fit.select(*keys, "variances", F.posexplode("loadings").alias("_pos", "_vector"))
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col("_vector")[i].alias("loading")) for i, c in enumerate(columns)]
    )
    return rows.select(
        *keys,
        (F.col("_pos") + 1).alias("component"),
        F.sqrt(F.get("variances", F.col("_pos"))).alias("sdev"),
        F.inline(cells),
    ).withColumn("arrow", F.col("loading") * F.col("sdev"))


def reconstruct(fit: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of every variable pair rebuilt from the components, whatever their signs."""
    parts = F.arrays_zip(F.col("variances").alias("v"), F.col("loadings").alias("w"))

    def rebuilt(i: int, j: int) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda acc, c: acc + c["v"] * c["w"][i] * c["w"][j])

    size = range(len(columns))
    cells = [
        F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), rebuilt(i, j).alias("r"))
        for i in size
        for j in size
        if i <= j
    ]
    return fit.filter(F.col("variances").isNotNull()).select(*keys, F.inline(F.array(*cells)))


def scores(
    df: DataFrame,
    fit: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    components: int | None = None,
    prefix: str = "pc",
    scaled: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the component scores of every complete row; ``scaled`` divides by the component's sdev (biplot)."""
    columns, keys = list(columns), list(keys)
    table = fit.select(*keys, "n", "means", "sds", "variances", "loadings")
    joined = group_join(_complete_rows(df, columns), table, keys, "n", hot_rows)
    standard = [ratio(F.col(c) - F.col("means")[i], F.col("sds")[i]) for i, c in enumerate(columns)]
    out = joined
    for k in range(components or len(columns)):
        value = sum((z * F.col("loadings")[k][i] for i, z in enumerate(standard)), F.lit(0.0))
        out = out.withColumn(f"{prefix}{k + 1}", ratio(value, F.sqrt(F.col("variances")[k])) if scaled else value)
    return out.drop("means", "sds", "variances", "loadings")
