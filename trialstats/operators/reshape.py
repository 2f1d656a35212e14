"""Long and wide reshaping as single aggregates.

Every pivot takes its output levels, so no extra job looks for them, and is one conditional
aggregate: the map side reduces each key to one row of constant size before the shuffle, however
many rows a hot key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.operators.linking import null_safe_join
from trialstats.sources.tables import written

Level = str | int | tuple
LEVEL_BLOCK = 4096
LEVEL_BYTES = 32 << 20


def _condition(names: Sequence[str], level: Level) -> Column:
    values = level if isinstance(level, tuple) else (level,)
    out = F.lit(True)
    for name, value in zip(names, values, strict=True):
        out = out & (F.col(name) == F.lit(value))
    return out


def level_name(level: Level, prefix: str = "", sep: str = "_") -> str:
    values = level if isinstance(level, tuple) else (level,)
    return prefix + sep.join(str(v) for v in values)


def single_value(value: Column, where: Column, what: str) -> Column:
    """The one value of a group's rows that satisfy ``where``; more than one such row is an error."""
    rows = F.count(F.when(where, F.lit(1)))
    message = F.concat(F.lit(f"duplicate rows for {what}: "), rows.cast("string"))
    return F.when(rows > 1, F.raise_error(message)).otherwise(F.max(F.when(where, value)))


def first_value(value: Column, where: Column, order: Column) -> Column:
    """The value of the group's first row, by ``order``, among those that satisfy ``where``."""
    return F.min_by(value, F.when(where, order))


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names: str | Sequence[str],
    value: str,
    levels: Sequence[Level],
    prefix: str = "",
    order_by: str | None = None,
    other: str = "error",
) -> DataFrame:
    """One output column per level of ``names`` (one column, or several joined by ``_``).

    Duplicate rows for one cell are an error unless ``order_by`` says which comes first. A row of a level that isn't
    listed is an error as well, unless ``other="drop"``.
    """
    names = [names] if isinstance(names, str) else list(names)
    cells = []
    for level in levels:
        where, name = _condition(names, level), level_name(level, prefix)
        cell = (
            first_value(F.col(value), where, F.col(order_by))
            if order_by
            else single_value(F.col(value), where, name)
        )
        cells.append(cell.alias(name))
    return _only_listed(df.groupBy(*ids).agg(*cells, *_unlisted(names, levels, other)))


def _unlisted(names: Sequence[str], levels: Sequence[Level], other: str) -> list[Column]:
    """The number of a group's rows whose level isn't among ``levels``, if they are an error."""
    if other not in ("error", "drop"):
        raise ValueError(f"other is 'error' or 'drop', not {other!r}")
    listed = reduce(or_, [_condition(names, level) for level in levels], F.lit(False))
    return [F.count(F.when(~F.coalesce(listed, F.lit(False)), F.lit(1))).alias("_unlisted")] if other == "error" else []


def _only_listed(grouped: DataFrame) -> DataFrame:
    if "_unlisted" not in grouped.columns:
        return grouped
    message = F.concat(F.col("_unlisted").cast("string"), F.lit(" rows of a level that is not listed"))
    fine = F.when(F.col("_unlisted") > 0, F.raise_error(message)).otherwise(F.lit(True))
    return grouped.filter(fine).drop("_unlisted")


def spread(
    df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str], other: str = "error"
) -> DataFrame:
    """``pivot_wider`` with its columns in sorted order; duplicate keys are an error."""
    return pivot_wider(df, ids, name, value, sorted(levels), other=other)


def pivot_aggregate(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    levels: Sequence[Level],
    fn: Callable[[Column, Column], Column],
    value: str,
    prefix: str = "",
) -> DataFrame:
    """Aggregate and pivot in one step: ``fn(value, where)`` per level, one shuffle."""
    return df.groupBy(*ids).agg(
        *[fn(F.col(value), _condition([name], level)).alias(level_name(level, prefix)) for level in levels]
    )


def pivot_longer(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """One row per named column; missing values are kept."""
    return df.unpivot(list(ids), list(columns), name, value)


def pivot_longer_split(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    names: Sequence[str],
    sep: str = "_",
    value: str = "value",
) -> DataFrame:
    """``pivot_longer`` whose name column is split into several."""
    long = df.unpivot(list(ids), list(columns), "_name", value)
    parts = F.split("_name", sep)
    return long.select(*ids, *[parts[i].alias(n) for i, n in enumerate(names)], value)


def separate(df: DataFrame, column: str, into: Sequence[str], pattern: str = "[^A-Za-z0-9]+") -> DataFrame:
    """Split one text column into several at a pattern (default: anything not alphanumeric)."""
    parts = F.split(F.col(column), pattern)
    out = []
    for c in df.columns:
        out += [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)] if c == column else [F.col(c)]
    return df.select(*out)


def complete_counts(
    df: DataFrame, ids: Sequence[str], level: str, levels: Sequence | None = None, count: str = "n", other: str = "error"
) -> DataFrame:
    """Rows per id and level, with 0 for combinations that do not occur.

    Levels that occur nowhere are left out; without ``levels`` they are those of the data, however many: these are written
    and dealt into blocks of about LEVEL_BLOCK, and each id meets each block. With them the zero-filled table comes from one conditional aggregate, and rows of other levels are an error unless ``other="drop"``.
    """
    seen = df.select(level).distinct()
    if levels is None:
        counts = df.groupBy(*ids, level).agg(F.count(F.lit(1)).alias(count))
        every = _every_level(df.select(*ids).distinct(), written(seen), ids, level)
        filled = null_safe_join(every, counts, [*ids, level], "left")
        return filled.select(*ids, level, F.coalesce(count, F.lit(0)).alias(count))
    cells = F.array(
        *[F.struct(F.lit(v).alias(level), F.count(F.when(F.col(level) == F.lit(v), F.lit(1))).alias(count)) for v in levels]
    ).alias("_cells")
    wide = _only_listed(df.groupBy(*ids).agg(cells, *_unlisted([level], levels, other)))
    # at most one row per listed level
    known = F.broadcast(seen.filter(F.col(level).isin(list(levels))))
    return wide.select(*ids, F.inline("_cells")).join(known, level, "left_semi").select(*ids, level, count)


def _every_level(groups: DataFrame, seen: DataFrame, ids: Sequence[str], level: str) -> DataFrame:
    """Each group's keys with each level of a written table. A task holds one block of levels at a time."""
    measured = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(16 + F.coalesce(F.length(F.col(level).cast("string")), F.lit(0))), F.lit(0))).first()
    number = max(1, -(-measured[0] // LEVEL_BLOCK))
    block = F.pmod(F.xxhash64(level), F.lit(number)).cast("int")
    blocks = seen.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(level)).alias("_levels"))
    if measured[1] <= LEVEL_BYTES:
        blocks = F.broadcast(blocks)
    met = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(blocks, "_block")
    return met.select(*ids, F.inline("_levels"))
