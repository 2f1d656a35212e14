"""Counts, means and centred products per key, kept as a table that new logs are merged into.

A state is what paired tests, correlations, components and regressions need of the rows: per key ``n`` and, of the named
values, ``means`` and ``products`` (centred sums of products, upper triangle by rows). Two states merge exactly, by the pairwise
formula that adds the products of the differences of means, so a log of any length is read once, batch by
batch. Rows with a missing value don't count, as in a fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.columns import ColumnLike, as_col, ratio
from trialstats.operators.linking import join_by


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def state_of(df: DataFrame, keys: Sequence[str], values: Mapping[str, ColumnLike]) -> DataFrame:
    """One row per key: ``n``, ``means``, ``products``. One aggregate, combined before the shuffle."""
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.select(*keys, *[as_col(c).cast("double").alias(n) for n, c in zip(names, values.values(), strict=True)]).dropna(subset=names)
    n = F.count(F.lit(1))
    spread = [F.coalesce(F.covar_pop(names[i], names[j]), F.lit(0.0)) * n for i, j in _pairs(len(names))]
    out = rows.groupBy(*keys).agg(n.alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*spread).alias("products"))
    return out if keys else out.filter("n > 0")


def merge(first: DataFrame, second: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The state of both states' rows. Keys of one side stay as they are."""
    columns = ["n", "means", "products"]
    keys = list(keys)
    if not keys:
        first, second = first.withColumn("_all", F.lit(0)), second.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    left = first.select(*by, F.struct(*columns).alias("_a"))
    right = second.select(*by, F.struct(*columns).alias("_b"))
    both = join_by(left, right, by, "full")
    n = F.col("_a.n") + F.col("_b.n")
    apart = [F.col("_b.means")[i] - F.col("_a.means")[i] for i in range(width)]
    means = F.array(*[F.col("_a.means")[i] + apart[i] * F.col("_b.n") / n for i in range(width)])
    weight = F.col("_a.n").cast("double") * F.col("_b.n") / n
    products = F.array(
        *[F.col("_a.products")[k] + F.col("_b.products")[k] + apart[i] * apart[j] * weight for k, (i, j) in enumerate(_pairs(width))]
    )
    merged = F.struct(n.alias("n"), means.alias("means"), products.alias("products"))
    state = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(merged)
    return both.select(*keys, state.alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in columns])


def summary(state: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``n``, and ``<name>_mean``, ``<name>_sd``, ``<name>_se`` of each value; no spread of fewer than two rows."""
    at = {pair: k for k, pair in enumerate(_pairs(len(names)))}
    cells = []
    for i, name in enumerate(names):
        sd = F.sqrt(ratio(F.col("products")[at[i, i]], F.col("n") - 1))
        cells += [F.col("means")[i].alias(f"{name}_mean"), sd.alias(f"{name}_sd"), (sd / F.sqrt("n")).alias(f"{name}_se")]
    return state.select(*keys, "n", *cells)


def moments(state: DataFrame, keys: Sequence[str], order: Sequence[int]) -> DataFrame:
    """The state as ``ols.models_from_moments`` reads it: the values of ``order`` (terms, then the outcome)."""
    width = len(order)
    size = F.size("means")

    def product(a: int, b: int) -> Column:
        i, j = min(a, b), max(a, b)  # place in the upper triangle by rows
        return F.get("products", F.lit(i) * size - F.lit(i * (i - 1) // 2) + F.lit(j - i))

    cells = [F.col("means")[o].alias(f"_m{i}") for i, o in enumerate(order)]
    cells += [ratio(product(order[i], order[j]), F.col("n") - 1).alias(f"_c{i}_{j}") for i, j in _pairs(width)]
    return state.select(*keys, "n", *cells)


class StateTable:
    """A state in a folder, merged batch by batch; a batch that comes again changes nothing.

    Every batch writes a new version: the merged state, then the ids of all batches in it, and the version counts only when
    both are there. So a batch that fails half way is as if it had not come, and is sent again. One writer at a time
    (``foreachBatch`` of one stream, with its batch id, is such a writer); readers keep the version they opened. Older
    versions stay until ``tidy``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], values: Mapping[str, ColumnLike]):
        self.spark, self.path, self.keys, self.values = spark, path.rstrip("/"), list(keys), dict(values)

    def _folder(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(conf), place

    def _versions(self) -> list[str]:
        """Names of the whole versions, oldest first."""
        path_of, files, place = self._folder()
        if not files.exists(place):
            return []
        names = sorted(f.getPath().getName() for f in files.listStatus(place))
        return [n for n in names if files.exists(path_of(f"{self.path}/{n}/batches/_SUCCESS"))]

    def state(self) -> DataFrame | None:
        """The state of all batches so far, None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}/state") if versions else None

    def batches(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}/batches") if versions else None

    def add(self, rows: DataFrame, batch: str | int) -> bool:
        """Merge a batch in; False if it was there before."""
        batch = str(batch)
        known, before = self.batches(), self.state()
        if known is not None and known.filter(F.col("batch") == batch).count():
            return False
        new = state_of(rows, self.keys, self.values)
        out = new if before is None else merge(before, new, self.keys, len(self.values))
        ledger = self.spark.range(1).select(F.lit(batch).alias("batch"))
        ledger = ledger if known is None else ledger.unionByName(known)
        number = int(self._versions()[-1].split("-")[1]) + 1 if known is not None else 0
        version = f"{self.path}/v-{number:012d}-{uuid.uuid4().hex}"
        out.write.parquet(f"{version}/state")
        ledger.coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{version}/batches")
        return True

    def tidy(self) -> None:
        """Delete all but the newest version, and what failed batches left."""
        path_of, files, place = self._folder()
        versions = self._versions()
        for found in files.listStatus(place) if versions else []:
            if found.getPath().getName() != versions[-1]:
                files.delete(found.getPath(), True)
