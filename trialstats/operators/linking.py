"""Joins, unions and key checks.

All joins are equi-joins by key; rows are never paired by position. A missing key is a key of its own, as in the
studied analyses, unless ``na_matches="never"``. Trial-by-trial joins with a table of unique keys read each side
once and are left to adaptive execution, whose split of a skewed side repeats that one partition of the table only.
Per-group tables meet their rows through ``group_join``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.sources.tables import written

HOT_ROWS = 1_000_000
HOT_FACTOR = 4
BUCKETS = 4096
BROADCAST_BYTES = 32 << 20
#: Assumed bytes of a per-group row: a fit of up to about a dozen terms with its matrix.
GROUP_ROW_BYTES = 2048


def unique_lookup(df: DataFrame, keys: Sequence[str], values: Sequence[str], order_by: str | None = None) -> DataFrame:
    """One row per key. A second row for a key is an error unless ``order_by`` picks the first.

    Rows that tie in ``order_by`` are told apart by their values, so that all columns come from one row. A single
    column needs no such order; it then aggregates by hash if it is a number.
    """
    if order_by and len(values) == 1:
        return df.groupBy(*keys).agg(F.min_by(values[0], order_by).alias(values[0]))
    if order_by:
        first = F.min(F.struct(F.col(order_by).alias("_order"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]))
        rows = df.groupBy(*keys).agg(first.alias("_first"))
        return rows.select(*keys, *[F.col(f"_first._v{i}").alias(v) for i, v in enumerate(values)])
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("lookup key is not unique")))
    return df.groupBy(*keys).agg(*[single.otherwise(F.first(v)).alias(v) for v in values])


def key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def bucket_splits(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, rows: str | None = None) -> DataFrame:
    """Buckets of keys that hold far more than their share of rows, and into how many parts to split each.

    Keys, a missing one included, are hashed into ``BUCKETS`` buckets and counted, which a map task reduces to one
    number per bucket (``rows`` names a column of counts when the input is counted already). A bucket is hot above
    ``HOT_FACTOR`` times the larger of ``hot_rows`` and the average bucket, and is split into parts of that
    size. The table has at most ``BUCKETS`` rows, is exact, and is the same however often it is computed.
    """
    weight = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counts = df.groupBy(key_bucket(keys).alias("_bucket")).agg(weight.alias("_rows"))
    everything = Window.partitionBy(F.lit(0))  # over at most BUCKETS rows
    part = F.greatest(F.lit(float(hot_rows)), F.sum("_rows").over(everything) / BUCKETS)
    sized = counts.select("_bucket", "_rows", part.alias("_part"))
    hot = sized.filter(F.col("_rows") > HOT_FACTOR * F.col("_part"))
    return hot.select("_bucket", F.ceil(F.col("_rows") / F.col("_part")).cast("int").alias("_splits"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a missing key equals a missing key. The right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") if c in keys else c for c in right.columns])
    matches = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(other, matches, how).drop(*[f"_of_{k}" for k in keys])


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join of any kind in which a missing key equals a missing key: keys, then the other columns of both sides."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") if c in keys else c for c in right.columns])
    matches = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = left.join(other, matches, how)
    rest = [c for frame in (left, right) for c in frame.columns if c not in keys]
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_of_{k}")).alias(k) for k in keys], *rest)


def one_row(table: DataFrame) -> DataFrame:
    """The table, which must have one row at most; two are looked at."""
    two = table.limit(2)
    many = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > 1
    checked = F.when(many, F.raise_error(F.lit("a lookup without keys has one row"))).otherwise(F.lit(True))
    return two.withColumn("_one", checked).filter("_one").drop("_one")


def lookup_join(
    left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", na_matches: str = "na"
) -> DataFrame:
    """Attach the columns of a table with one row per key to every left row.

    ``na_matches="na"`` lets a missing key match a missing key, ``"never"`` nothing. Without keys the lookup must
    have one row.
    """
    keys = list(keys)
    if not keys:
        return left.join(F.broadcast(one_row(lookup)), F.lit(True), how)
    types = {f.name: f.dataType for f in left.schema.fields}
    lookup = lookup.select(*[F.col(c).try_cast(types[c]).alias(c) if c in keys else c for c in lookup.columns])
    names = [*left.columns, *[c for c in lookup.columns if c not in keys]]
    if na_matches == "never":
        return left.join(lookup, keys, how).select(*names)
    return null_safe_join(left, lookup, keys, how).select(*names)


def group_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach each group's one row (missing keys are a group) to the group's rows.

    The table is written, so that it is computed once, and counted. Up to ``BROADCAST_BYTES`` it goes to every task
    and the rows stay where they are. Beyond, rows of hot groups (``weight`` has their numbers) are dealt over
    parts by their place in the scan, not by their content, and the group's row is repeated once per part; the
    table at most doubles.
    """
    keys = list(keys)
    if not keys:
        return lookup_join(rows, table.drop(weight), [], "inner")
    table = written(table)
    names = [*rows.columns, *[c for c in table.columns if c not in (*keys, weight)]]
    if table.count() * GROUP_ROW_BYTES <= BROADCAST_BYTES:
        return null_safe_join(rows, F.broadcast(table), keys).select(*names)
    splits = F.broadcast(bucket_splits(table, keys, hot_rows, weight))  # <= BUCKETS rows
    dealt = rows.withColumn("_bucket", key_bucket(keys)).join(splits, "_bucket", "left")
    place = F.pmod(F.monotonically_increasing_id(), F.coalesce("_splits", F.lit(1)))
    dealt = dealt.withColumn("_salt", place.cast("int")).drop("_bucket", "_splits")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_splits") - 1, F.lit(0)))
    repeated = table.withColumn("_bucket", key_bucket(keys)).join(splits, "_bucket", "left")
    repeated = repeated.withColumn("_salt", F.explode(parts)).drop("_bucket", "_splits", weight)
    return null_safe_join(dealt, repeated, [*keys, "_salt"]).select(*names)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys, rows, and how many keys repeat."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.when(F.col("_n") > 1, F.lit(1))).alias("n_duplicated"),
        F.max("_n").alias("max_rows"),
    )


def inherit_column(
    df: DataFrame,
    keys: Sequence[str],
    receives: Column,
    gives: Column,
    values: Mapping[str, str],
    order_by: str | None = None,
) -> DataFrame:
    """Rows that satisfy ``receives`` take columns from the one row of their key that satisfies ``gives``."""
    source = unique_lookup(df.filter(gives), keys, list(values.values()), order_by)
    source = source.select(*keys, *[F.col(old).alias(new) for new, old in values.items()])
    return lookup_join(df.filter(receives), source, keys)


def join_all(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], how: str = "left") -> DataFrame:
    """Chain of joins of per-key summaries on the same key; a missing key is a key."""
    for other in others:
        base = join_by(base, other, keys, how)
    return base


def pair_by_key(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on_missing: str = "error"
) -> DataFrame:
    """Put two per-key frames side by side.

    ``on_missing="error"`` fails if either side lacks a key of the other (a bind by position would
    fail on unequal lengths); ``"drop"`` keeps common keys only.
    """
    if on_missing == "drop":
        return join_by(left, right, keys, "inner")
    joined = join_by(left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True)), keys, "full")
    both = F.when(F.col("_l") & F.col("_r"), True).otherwise(F.raise_error(F.lit("key present on one side only")))
    return joined.filter(both).drop("_l", "_r")


def join_suffixed(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Join two tables of the same layout; shared non-key columns get a suffix per side."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    for name in shared:
        left = left.withColumnRenamed(name, name + suffixes[0])
        right = right.withColumnRenamed(name, name + suffixes[1])
    return join_by(left, right, keys, how)


def bind_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks are NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def bind_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """``bind_rows`` with a column that names the source of each row."""
    return bind_rows([frame.withColumn(tag, F.lit(name)) for name, frame in frames.items()])
