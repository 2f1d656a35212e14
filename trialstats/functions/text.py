"""Report texts next to the numeric columns. The numbers are the contract; the texts are for reading."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col
from trialstats.functions.digits import fixed

# Report formats.
PAIRED_FORMAT = "_t_(%d) = %.2f, %s, _dz_ = %.2f, 95%% CI [%.2f, %.2f]"
FIT_FORMAT = "$R^2_{adj}$ = %.2f, _F_(%d, %d) = %.2f, %s"
COEFFICIENT_FORMAT = "_B_ = %.2f, 95%% CI [%.2f, %.2f], $\\beta$ = %.2f, %s"
COMPARISON_FORMAT = "_F_(%d, %d) = %.2f, %s"
SLOPE_FORMAT = "B = %.2f, 95%% CI [%.2f, %.2f], %s"
INTERVAL_FORMAT = "[%.2f,%.2f]"
P_BELOW, P_EQUAL, P_ABOVE = "_p_ < .001", "_p_ = ", "_p_ > .999"
CELL_BELOW, CELL_ABOVE = "< .001", "> .999"


def _three_digits(p: Column) -> Column:
    return F.substring(fixed(p, 3), 2, 4)


def format_p(p: ColumnLike) -> Column:
    """A p-value in running text. Values that would round to one read as above .999."""
    p = as_col(p)
    return (
        F.when(p.isNull(), None)
        .when(p < 0.001, F.lit(P_BELOW))
        .when(fixed(p, 3) == "1.000", F.lit(P_ABOVE))
        .otherwise(F.concat(F.lit(P_EQUAL), _three_digits(p)))
    )


def format_p_cell(p: ColumnLike) -> Column:
    """A p-value in a table cell; missing stays missing."""
    p = as_col(p)
    return (
        F.when(p.isNull(), None)
        .when(p < 0.001, F.lit(CELL_BELOW))
        .when(p > 0.999, F.lit(CELL_ABOVE))
        .otherwise(_three_digits(p))
    )


def _sentence(pattern: str, *values: ColumnLike) -> Column:
    """The pattern with its values, doubles rounded as C rounds them; a missing double reads NA."""
    columns = [as_col(v) for v in values]
    kinds = re.findall(r"%(%|d|s|\.2f)", pattern)
    shown = [F.coalesce(fixed(c, 2), F.lit("NA")) if k == ".2f" else c for k, c in zip((k for k in kinds if k != "%"), columns, strict=True)]
    return F.when(columns[0].isNotNull(), F.format_string(pattern.replace("%.2f", "%s"), *shown))


def paired_sentence(df: ColumnLike, t: ColumnLike, p: ColumnLike, dz: ColumnLike, low: ColumnLike, high: ColumnLike):
    df, t = as_col(df).cast("long"), as_col(t)
    return F.when(t.isNotNull(), _sentence(PAIRED_FORMAT, df, t, format_p(p), dz, low, high))


def fit_sentence(adj_r2: ColumnLike, df1: ColumnLike, df2: ColumnLike, f: ColumnLike, p: ColumnLike):
    return _sentence(FIT_FORMAT, adj_r2, as_col(df1).cast("long"), as_col(df2).cast("long"), f, format_p(p))


def coefficient_sentence(b: ColumnLike, low: ColumnLike, high: ColumnLike, beta: ColumnLike, p: ColumnLike):
    """Missing for the intercept, which has no standardised slope."""
    return F.when(as_col(beta).isNotNull(), _sentence(COEFFICIENT_FORMAT, b, low, high, beta, format_p(p)))


def comparison_sentence(df1: ColumnLike, df2: ColumnLike, f: ColumnLike, p: ColumnLike):
    f = as_col(f)
    text = _sentence(COMPARISON_FORMAT, as_col(df1).cast("long"), as_col(df2).cast("long"), f, format_p(p))
    return F.when(f.isNotNull(), text)


def slope_sentence(b: ColumnLike, low: ColumnLike, high: ColumnLike, p: ColumnLike):
    return _sentence(SLOPE_FORMAT, b, low, high, format_p(p))


def interval(low: ColumnLike, high: ColumnLike):
    return _sentence(INTERVAL_FORMAT, low, high)
