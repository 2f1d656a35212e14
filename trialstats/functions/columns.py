"""Column expressions with strict missing-value rules.

Spark's aggregates skip NULL. The statistics here must not: one missing input makes the result
missing, unless the caller asks for ``skip_nulls=True``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: ColumnLike, bottom: ColumnLike) -> Column:
    """Quotient that is missing, not an error, where the divisor is zero."""
    return F.try_divide(as_col(top), as_col(bottom))


def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation over complete pairs; missing, not an error, where either side is constant."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_samp(x, y), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)))


def strict_agg(
    fn: Callable[[Column], Column],
    value: ColumnLike,
    where: Column | None = None,
    skip_nulls: bool = False,
) -> Column:
    """``fn(value)`` over the rows of a group that satisfy ``where``; NULL if any of them is NULL."""
    value = as_col(value)
    if where is None:
        rows, picked = F.count(F.lit(1)), value
    else:
        rows, picked = F.count(F.when(where, F.lit(1))), F.when(where, value)
    result = fn(picked)
    return result if skip_nulls else F.when(rows == F.count(picked), result)


def strict_avg(value: ColumnLike, where: Column | None = None, skip_nulls: bool = False) -> Column:
    return strict_agg(F.avg, value, where, skip_nulls)


def strict_sum(value: ColumnLike, where: Column | None = None, skip_nulls: bool = False) -> Column:
    return strict_agg(F.sum, value, where, skip_nulls)


def strict_sd(value: ColumnLike, where: Column | None = None, skip_nulls: bool = False) -> Column:
    """Sample standard deviation; NULL for fewer than two rows."""
    return strict_agg(F.stddev_samp, value, where, skip_nulls)


def strict_se(value: ColumnLike) -> Column:
    """Standard error of the mean over the non-missing values (as an error bar shows it)."""
    value = as_col(value)
    return ratio(F.stddev_samp(value), F.sqrt(F.count(value)))


def if_else(condition: Column, yes: ColumnLike | int | float, no: ColumnLike | int | float) -> Column:
    """Two-way choice where a missing condition stays missing (plain ``when`` would take ``no``)."""
    return F.when(condition, _value(yes)).when(~condition, _value(no))


def _value(value):
    return value if isinstance(value, Column) else F.lit(value)


def binarise(outcome: ColumnLike) -> Column:
    """Outcome codes to 0/1: 0 stays 0, every other code is 1, missing stays missing."""
    return if_else(as_col(outcome) == 0, 0, 1)


def reverse_key(value: ColumnLike, key: ColumnLike, ceiling: int = 4, reversed_key: str = "r") -> Column:
    """Reverse-keyed items become ``ceiling - value``; a missing key makes the value missing."""
    value = as_col(value)
    return if_else(as_col(key) == reversed_key, F.lit(ceiling) - value, value)


def rebase_block(block: ColumnLike) -> Column:
    """Zero-based block label to a one-based number; labels that are no number become NULL."""
    return as_col(block).try_cast("int") + 1


def collapse_label(label: ColumnLike, contains: str, into: str) -> Column:
    """Every label that contains a text becomes one label; the rest stay."""
    label = as_col(label)
    return if_else(label.contains(contains), F.lit(into), label)


def recode(label: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace labels by a mapping; labels outside it stay."""
    label = as_col(label)
    out = label
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def level_rank(label: ColumnLike, levels: Sequence[str]) -> Column:
    """Position of a label in an explicit level list (1-based), NULL outside the list."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(label)), F.lit(0)).cast("int")


def relabel(label: ColumnLike, levels: Sequence[str], labels: Sequence[str]) -> Column:
    """Factor labels: the i-th level shows as the i-th label, anything else is missing."""
    label = as_col(label)
    out = F.lit(None).cast("string")
    for level, name in zip(levels, labels, strict=True):
        out = F.when(label == level, F.lit(name)).otherwise(out)
    return out


def not_in(value: ColumnLike, excluded: Sequence) -> Column:
    """Membership exclusion that keeps missing values and can be pushed to the scan."""
    value = as_col(value)
    if not excluded:
        return F.lit(True)
    return value.isNull() | ~value.isin(list(excluded))


def apply_all(fns: Mapping[str, Callable[[Column], Column]], columns: Sequence[str]) -> list[Column]:
    """The same functions over many columns, named ``<column>_<function>``."""
    return [fn(F.col(c)).alias(f"{c}_{name}") for c in columns for name, fn in fns.items()]
