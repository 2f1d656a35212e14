"""Ordinary least squares per group, all groups and all models from one aggregate.

The rows are reduced once to counts, means and centred cross-products of the outcome and every term any
model uses. Each model is then solved from its own sub-matrix, so nested models, their comparison and
several outcomes share one scan and one shuffle. Cross-products come from ``covar_samp``, which centres
as it merges, so large means do not cancel.

Cross-products square the condition number of a design. Where its columns are nearly dependent, ``method="qr"``
reduces the rows to triangular factors instead (``functions.factors``): one scan and one shuffle as well, in Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col, ratio
from trialstats.functions.digits import rounded
from trialstats.functions.distributions import f_p_value, t_table
from trialstats.functions.factors import group_factors, solve_factor
from trialstats.functions.linalg import solve_least_squares
from trialstats.functions.text import (
    coefficient_sentence,
    comparison_sentence,
    fit_sentence,
    format_p_cell,
    interval,
    slope_sentence,
)
from trialstats.operators.adjust import holm_values
from trialstats.operators.linking import HOT_ROWS, group_join

INTERCEPT = "(Intercept)"
NORMAL_95 = 1.96  # fixed value: half width, in standard errors, of the report intervals


@dataclass(frozen=True)
class Term:
    """A design column. Only ``numeric`` terms have a standardised slope; the others report the raw one."""

    name: str
    column: Column
    kind: str = "numeric"

    @staticmethod
    def numeric(name: str, value: ColumnLike | None = None) -> Term:
        return Term(name, as_col(name if value is None else value).cast("double"))

    @staticmethod
    def contrast(name: str, factor: ColumnLike, levels: tuple[str, str]) -> Term:
        """Two-level factor as -1/2 for the first level and +1/2 for the second."""
        factor = as_col(factor)
        return Term(name, F.when(factor == levels[0], -0.5).when(factor == levels[1], 0.5), "factor")

    def interact(self, other: Term) -> Term:
        return Term(f"{self.name}:{other.name}", self.column * other.column, "interaction")


def fit_models(
    df: DataFrame, outcome: ColumnLike, models: Mapping[str, Sequence[Term]], keys: Sequence[str] = (), method: str = "moments"
) -> DataFrame:
    """One row per group with a struct column per model: ``coef, unscaled_cov, rss, means, sds, terms, kinds``.

    Also has ``n``, ``tss`` and ``sd_y``. Rows with a missing value in any column a model uses drop out, of
    all models alike, as nested comparison needs. ``method`` is ``moments`` or ``qr``.
    """
    if method not in ("moments", "qr"):
        raise ValueError(f"no method {method}")
    terms = _all_terms(models)
    names = [f"_x{i}" for i in range(len(terms))] + ["_y"]
    design = df.select(
        *keys, *[t.column.alias(n) for t, n in zip(terms, names, strict=False)], as_col(outcome).cast("double").alias("_y")
    ).dropna(how="any", subset=names)
    if method == "qr":
        return _fit_factors(design, names, terms, models, keys)
    width = len(names)
    upper = {
        (i, j): (F.var_samp(names[i]) if i == j else F.covar_samp(names[i], names[j])).alias(f"_c{i}_{j}")
        for i in range(width)
        for j in range(i, width)
    }
    moments = design.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)], *upper.values()
    )
    return models_from_moments(moments, models, keys)


def _all_terms(models: Mapping[str, Sequence[Term]]) -> list[Term]:
    terms: list[Term] = []
    for model in models.values():
        terms += [t for t in model if t.name not in {u.name for u in terms}]
    return terms


def models_from_moments(moments: DataFrame, models: Mapping[str, Sequence[Term]], keys: Sequence[str] = ()) -> DataFrame:
    """``fit_models`` of groups that are reduced already: ``n``, means ``_m<i>`` and covariances ``_c<i>_<j>`` (i <= j) of the terms
    in the order in which the models first name them, and of the outcome behind them."""
    terms = _all_terms(models)
    width = len(terms) + 1
    dof = F.col("n") - 1
    out = moments
    for model, members in models.items():
        index = [next(i for i, t in enumerate(terms) if t.name == m.name) for m in members] + [width - 1]
        cross = [F.col(f"_c{min(i, j)}_{max(i, j)}") * dof for i in index for j in index]
        fit = solve_least_squares("n", F.array(*[F.col(f"_m{i}") for i in index]), F.array(*cross))
        out = out.withColumn(model, fit)
        out = out.withColumn(
            model,
            F.struct(
                f"{model}.*",
                F.array(*[F.col(f"_m{i}") for i in index[:-1]]).alias("means"),
                F.array(*[F.sqrt(F.col(f"_c{i}_{i}")) for i in index[:-1]]).alias("sds"),
                F.array(*[F.lit(t.name) for t in members]).alias("terms"),
                F.array(*[F.lit(t.kind) for t in members]).alias("kinds"),
            ),
        )
    last = width - 1
    return out.select(
        *keys,
        "n",
        (F.col(f"_c{last}_{last}") * dof).alias("tss"),
        F.sqrt(F.col(f"_c{last}_{last}")).alias("sd_y"),
        *models,
    )


def _fit_factors(
    design: DataFrame, names: Sequence[str], terms: Sequence[Term], models: Mapping[str, Sequence[Term]], keys: Sequence[str]
) -> DataFrame:
    """``fit_models`` from one triangular factor per group; each model's columns are a selection of the factor's."""
    width = len(names)
    out = group_factors(design, keys, names)

    def length(i: int) -> Column:
        """Length of a centred column: what is above the factor's diagonal, and it."""
        cells = [F.pow(F.col("factor")[j * width + i], 2) for j in range(i + 1)]
        return F.sqrt(sum(cells[1:], cells[0]))

    dof = F.sqrt(F.col("n") - 1)
    for model, members in models.items():
        index = [next(i for i, t in enumerate(terms) if t.name == m.name) for m in members]
        out = out.withColumn(model, solve_factor("n", "means", "factor", F.array(*[F.lit(i) for i in [*index, width - 1]])))
        out = out.withColumn(
            model,
            F.struct(
                f"{model}.*",
                F.array(*[F.col("means")[i] for i in index]).alias("means"),
                F.array(*[ratio(length(i), dof) for i in index]).alias("sds"),
                F.array(*[F.lit(t.name) for t in members]).alias("terms"),
                F.array(*[F.lit(t.kind) for t in members]).alias("kinds"),
            ),
        )
    last = length(width - 1)
    return out.select(*keys, "n", F.pow(last, 2).alias("tss"), ratio(last, dof).alias("sd_y"), *models)


def _size(model: str) -> Column:
    return F.size(F.col(f"{model}.terms"))


def _rank(model: str) -> Column:
    """Slopes that could be told apart; aliased terms don't count."""
    return F.col(f"{model}.rank")


def _residual_df(model: str) -> Column:
    return F.col("n") - 1 - F.coalesce(_rank(model), _size(model))


def coefficients(
    fits: DataFrame, model: str | Sequence[str], keys: Sequence[str] = (), level: float = 0.95, holm: bool = False
) -> DataFrame:
    """Long coefficient table: estimate, se, t, p, t and normal intervals, beta; ``holm`` adds Holm p-values per model.

    ``beta`` is the slope in standard deviations for numeric terms and the raw slope for factors and
    interactions (``std_kind`` says which); the intercept has none. A list of models gives one table with a
    ``model`` column, from the same rows of ``fits``. Aliased terms, and all terms of groups without a fit, have
    missing values. A group's terms stay one array until everything is known of them, so nothing is shuffled.
    """
    several = not isinstance(model, str)
    models = list(model) if several else [model]
    rows = fits.select(*keys, "sd_y", *[_coefficient_rows(m).alias(f"_r{i}") for i, m in enumerate(models)])
    rows = rows.withColumn("_rows", F.concat(*[f"_r{i}" for i in range(len(models))]))
    statistic = F.transform("_rows", lambda r: ratio(r["estimate"], F.sqrt(r["s2"] * r["unscaled"])))
    rows = rows.withColumn("_t", statistic)
    dofs = F.transform("_rows", lambda r: r["df"].cast("double"))
    rows = rows.withColumn("_tails", t_table(F.col("_t"), dofs, (1 + level) / 2))
    if holm:
        start = F.lit(1)
        parts = []
        for i in range(len(models)):
            parts.append(holm_values(F.slice("_tails.p", start, F.size(f"_r{i}"))))
            start = start + F.size(f"_r{i}")
        rows = rows.withColumn("_holm", F.concat(*parts))

    def full(r: Column, i: Column) -> Column:
        estimate, se = r["estimate"], F.sqrt(r["s2"] * r["unscaled"])
        numeric = r["kind"] == "numeric"
        half = F.get("_tails.quantile", i) * se
        fields = {
            **({"model": r["model"]} if several else {}),
            "term_index": r["term_index"],
            "term": r["term"],
            "estimate": estimate,
            "std_error": se,
            "df": r["df"],
            "beta": F.when(numeric, ratio(estimate * r["sd"], F.col("sd_y"))).when(~numeric, estimate),
            "std_kind": F.when(numeric, "standardised").when(~numeric, "raw"),
            "statistic": F.get("_t", i),
            "p_value": F.get("_tails.p", i),
            "ci_t_low": estimate - half,
            "ci_t_high": estimate + half,
            "ci_z_low": estimate - NORMAL_95 * se,
            "ci_z_high": estimate + NORMAL_95 * se,
            **({"p_adj": F.get("_holm", i)} if holm else {}),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return rows.select(*keys, F.inline(F.transform("_rows", full)))


def _coefficient_rows(model: str) -> Column:
    """Array of one struct per coefficient of a model."""
    width = _size(model) + 1
    part = lambda name: F.col(f"{model}.{name}")

    def row(i: Column) -> Column:
        return F.struct(
            F.lit(model).alias("model"),
            i.alias("term_index"),
            F.when(i == 0, F.lit(INTERCEPT)).otherwise(F.get(part("terms"), i - 1)).alias("term"),
            F.get(part("coef"), i).alias("estimate"),
            F.get(part("unscaled_cov"), i * width + i).alias("unscaled"),
            F.get(part("sds"), i - 1).alias("sd"),
            F.get(part("kinds"), i - 1).alias("kind"),
            F.when(part("coef").isNotNull(), _residual_df(model)).alias("df"),
            ratio(part("rss"), _residual_df(model)).alias("s2"),
        )

    return F.transform(F.sequence(F.lit(0), _size(model)), row)


def with_holm(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add Holm-adjusted p-values within each model's table of terms or slopes, where it isn't made with them.

    A family is one model's terms, so it fits in one small array.
    """
    order = [c for c in table.columns if c not in keys]
    grouped = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term_index", *[c for c in order if c != "term_index"]))).alias("_rows"))
    adjusted = holm_values(F.col("_rows.p_value"))
    paired = F.zip_with("_rows", adjusted, lambda row, p: F.struct(row.alias("row"), p.alias("p_adj")))
    return grouped.select(*keys, F.inline(paired)).select(*keys, *[F.col(f"row.{c}") for c in order], "p_adj")


def report_table(fits: DataFrame, model: str | Sequence[str], keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Regression table for reading: rounded estimate and beta, interval text, p and Holm p as text."""
    by = [*keys] if isinstance(model, str) else [*keys, "model"]
    table = coefficients(fits, model, keys, holm=True)
    return table.select(
        *by,
        "term",
        rounded("estimate", digits).alias("estimate"),
        interval("ci_z_low", "ci_z_high").alias("ci"),
        rounded("beta", digits).alias("beta"),
        format_p_cell("p_value").alias("p_value"),
        format_p_cell("p_adj").alias("p_adj"),
    )


def side_by_side(table: DataFrame, smaller: str, larger: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two models' rows of one coefficient table next to each other, suffixed ``_x`` and ``_y``.

    Every term of the larger model is kept, as a right join of the two tables would; both come from one
    table, so the join is an aggregate by term.
    """
    values = [c for c in table.columns if c not in (*keys, "model", "term")]
    cells = [
        F.max(F.when(F.col("model") == model, F.col(c))).alias(f"{c}{suffix}")
        for model, suffix in ((smaller, "_x"), (larger, "_y"))
        for c in values
    ]
    in_larger = F.bool_or(F.col("model") == larger).alias("_kept")
    return table.groupBy(*keys, "term").agg(*cells, in_larger).filter("_kept").drop("_kept")


def coefficient_report(table: DataFrame) -> DataFrame:
    """Add the one-line text of each coefficient, with its t interval."""
    return table.withColumn("report", coefficient_sentence("estimate", "ci_t_low", "ci_t_high", "beta", "p_value"))


def _adjusted_r_squared(model: str) -> Column:
    rss, dof = F.col(f"{model}.rss"), _residual_df(model)
    return 1 - ratio(rss * (F.col("n") - 1), dof * F.col("tss"))


def _overall_f(model: str) -> Column:
    rss = F.col(f"{model}.rss")
    return ratio((F.col("tss") - rss) * _residual_df(model), rss * _rank(model))


def _gain_f(smaller: str, larger: str) -> Column:
    rss1, rss2 = F.col(f"{smaller}.rss"), F.col(f"{larger}.rss")
    return ratio((rss1 - rss2) * _residual_df(larger), rss2 * _extra_terms(smaller, larger))


def _extra_terms(smaller: str, larger: str) -> Column:
    return (_rank(larger) - _rank(smaller)).cast("long")


def fit_stats(fits: DataFrame, model: str, keys: Sequence[str] = ()) -> DataFrame:
    """R squared, adjusted R squared, F, its degrees of freedom and p, per group, with the report text."""
    out = fits.select(
        *keys,
        "n",
        (1 - ratio(f"{model}.rss", "tss")).alias("r_squared"),
        _adjusted_r_squared(model).alias("adj_r_squared"),
        _overall_f(model).alias("f_value"),
        F.coalesce(_rank(model), _size(model).cast("long")).alias("df_model"),
        _residual_df(model).alias("df_resid"),
    )
    out = out.withColumn("p_value", f_p_value("f_value", "df_model", "df_resid"))
    return out.withColumn("report", fit_sentence("adj_r_squared", "df_model", "df_resid", "f_value", "p_value"))


def compare(fits: DataFrame, smaller: str, larger: str, keys: Sequence[str] = ()) -> DataFrame:
    """F test of a model against one nested in it; both sit in the same row, so there is no join."""
    out = fits.select(
        *keys,
        F.col(f"{smaller}.rss").alias("rss_smaller"),
        F.col(f"{larger}.rss").alias("rss_larger"),
        _extra_terms(smaller, larger).alias("df_diff"),
        _residual_df(larger).alias("df_resid"),
        _gain_f(smaller, larger).alias("f_value"),
    )
    out = out.withColumn("p_value", f_p_value("f_value", "df_diff", "df_resid"))
    return out.withColumn("report", comparison_sentence("df_diff", "df_resid", "f_value", "p_value"))


def step_stats(fits: DataFrame, steps: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per group and step: adjusted R squared, its p, gain over the previous step, and the last gain's p.

    All of a group's steps come from its one row, in step order.
    """
    last = f_p_value(_gain_f(*steps[-2:]), _extra_terms(*steps[-2:]), _residual_df(steps[-1]))
    flat = fits.select(
        *keys,
        last.alias("_p_diff"),
        *[_adjusted_r_squared(m).alias(f"_r{i}") for i, m in enumerate(steps)],
        *[f_p_value(_overall_f(m), _rank(m), _residual_df(m)).alias(f"_p{i}") for i, m in enumerate(steps)],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.col(f"_r{i}").alias("r_adj"),
            F.col(f"_p{i}").alias("p_adj"),
            (F.col(f"_r{i}") - F.col(f"_r{i - 1}") if i else F.lit(None).cast("double")).alias("r_diff"),
            F.col("_p_diff").alias("p_diff"),
        )
        for i in range(len(steps))
    ]
    return flat.select(*keys, F.inline(F.array(*rows)))


def simple_slopes(
    fits: DataFrame,
    model: str,
    terms: Sequence[Term],
    predictor: str,
    moderator: str,
    keys: Sequence[str] = (),
    at: Mapping[str, float] | None = None,
) -> DataFrame:
    """Slope of the predictor at given moderator values: se, t, p, Holm p, normal interval.

    ``at`` names fixed moderator points; without it the points are one standard deviation below and
    above the moderator's mean.
    """
    names = [t.name for t in terms]
    both = f"{moderator}:{predictor}" if f"{moderator}:{predictor}" in names else f"{predictor}:{moderator}"
    b, inter, mod = names.index(predictor) + 1, names.index(both) + 1, names.index(moderator)
    width = len(names) + 1
    coef, cov = F.col(f"{model}.coef"), F.col(f"{model}.unscaled_cov")
    if at is not None:
        points = [F.struct(F.lit(name).alias("level"), F.lit(float(v)).alias("at")) for name, v in at.items()]
    else:
        mean, sd = F.col(f"{model}.means")[mod], F.col(f"{model}.sds")[mod]
        points = [
            F.struct(F.lit("low").alias("level"), (mean - sd).alias("at")),
            F.struct(F.lit("high").alias("level"), (mean + sd).alias("at")),
        ]
    dof = _residual_df(model)
    slope = lambda at: coef[b] + coef[inter] * at
    variance = lambda at: cov[b * width + b] + at * at * cov[inter * width + inter] + 2 * at * cov[b * width + inter]
    s2 = ratio(f"{model}.rss", dof)
    rows = fits.filter(coef.isNotNull()).select(
        *keys,
        F.transform(
            F.array(*points),
            lambda point: F.struct(
                point["level"].alias("level"),
                point["at"].alias("at"),
                slope(point["at"]).alias("slope"),
                F.sqrt(s2 * variance(point["at"])).alias("std_error"),
                dof.alias("df"),
            ),
        ).alias("_rows"),
    )
    rows = rows.withColumn("_t", F.transform("_rows", lambda r: ratio(r["slope"], r["std_error"])))
    rows = rows.withColumn("_tails", t_table(F.col("_t"), F.transform("_rows", lambda r: r["df"].cast("double")), 0.975))
    rows = rows.withColumn("_holm", holm_values(F.col("_tails.p")))

    def full(r: Column, i: Column) -> Column:
        return F.struct(
            *[r[c].alias(c) for c in ("level", "at", "slope", "std_error", "df")],
            F.get("_t", i).alias("t"),
            F.get("_tails.p", i).alias("p_value"),
            (r["slope"] - NORMAL_95 * r["std_error"]).alias("ci_z_low"),
            (r["slope"] + NORMAL_95 * r["std_error"]).alias("ci_z_high"),
            F.get("_holm", i).alias("p_adj"),
        )

    out = rows.select(*keys, F.inline(F.transform("_rows", full)))
    return out.withColumn("report", slope_sentence("slope", "ci_z_low", "ci_z_high", "p_value"))


def leave_one_out(
    df: DataFrame,
    outcome: ColumnLike,
    terms: Sequence[Term],
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    method: str = "moments",
) -> DataFrame:
    """Leave-one-out mean squared error per group in two passes, without refitting.

    Each row's left-out residual is its residual over one minus its leverage; leverages come from the
    group's fit joined back to the rows, which stay where they are if there are few groups.
    """
    keys = list(keys)
    names = [f"_x{i}" for i in range(len(terms))]
    rows = df.select(
        *keys, *[t.column.alias(n) for t, n in zip(terms, names, strict=True)], as_col(outcome).cast("double").alias("_y")
    ).dropna(how="any", subset=[*names, "_y"])
    fits = fit_models(rows, "_y", {"m": [Term.numeric(n) for n in names]}, keys, method)
    known = F.col("m.unscaled_cov") if method == "moments" else F.struct("n", "m.means", "m.white")
    table = fits.select(*keys, "n", F.col("m.coef").alias("_coef"), known.alias("_cov"))
    joined = group_join(rows, table, keys, "n", hot_rows)
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    width = len(x)
    # an aliased term takes no part; a group without a fit has no error
    entry = lambda name, i: F.when(F.col(name).isNotNull(), F.coalesce(F.col(name)[i], F.lit(0.0)))
    fitted = sum((entry("_coef", i) * v for i, v in enumerate(x)), F.lit(0.0))
    if method == "moments":
        leverage = sum(
            (entry("_cov", i * width + j) * x[i] * x[j] for i in range(width) for j in range(width)), F.lit(0.0)
        )
    else:  # squares of independent columns: nothing cancels
        away = [v - F.col("_cov.means")[i] for i, v in enumerate(x[1:])]
        turned = [sum((F.col("_cov.white")[i * (width - 1) + j] * v for j, v in enumerate(away)), F.lit(0.0)) for i in range(width - 1)]
        leverage = sum((v * v for v in turned), 1 / F.col("_cov.n"))
    left_out = ratio(F.col("_y") - fitted, 1 - leverage)
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(left_out * left_out).alias("loo_mse"))
