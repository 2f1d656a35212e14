"""Projection, filtering and typing operators over whole frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.functions import digits as digits_

from trialstats.functions.columns import not_in

NO_KEY_SPLITS = 10_000


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop named columns; an unknown name is an error (``DataFrame.drop`` would ignore it)."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*columns)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column through another, in frame order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def map_columns(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each named column by ``fn`` of it, in place."""
    chosen = set(columns)
    return df.select(*[fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def map_columns_of_type(df: DataFrame, data_type: type[T.DataType], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace every column of a type by ``fn`` of it."""
    return map_columns(df, [f.name for f in df.schema.fields if isinstance(f.dataType, data_type)], fn)


def round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every double column by its exact binary value, half to even."""
    return map_columns_of_type(df, T.DoubleType, lambda c: digits_.rounded(c, digits))


def compute_consuming(df: DataFrame, used: Sequence[str], **computed: Column) -> DataFrame:
    """Add computed columns and drop the columns they were computed from."""
    kept = [c for c in df.columns if c not in set(used)]
    return df.select(*kept, *[value.alias(name) for name, value in computed.items()])


def exclude(df: DataFrame, key: str, excluded: Sequence | DataFrame | None) -> DataFrame:
    """Remove rows whose key is excluded; rows with a missing key stay.

    A list becomes a filter that reaches the scan. A DataFrame of keys becomes an anti join, whose
    strategy is left to the optimiser because its size is not known here; rows without a key are dealt
    over many join keys by their place, as they match nothing and could otherwise all land in one task.
    """
    if excluded is None:
        return df
    if not isinstance(excluded, DataFrame):
        return df.filter(not_in(key, list(excluded)))
    spread = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NO_KEY_SPLITS))).otherwise(F.lit(0))
    gone = excluded.select(F.col(excluded.columns[0]).alias(key), F.lit(0).cast("long").alias("_salt"))
    kept = df.withColumn("_salt", spread.cast("long")).join(gone, [key, "_salt"], "left_anti")
    return kept.select(*df.columns)


def rename_select(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select with rename; the mapping goes from new name to old name."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])
