"""Intermediate and exported tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.session import shared_dir


def written(df: DataFrame) -> DataFrame:
    """The rows as a parquet table in the cluster's shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/trialstats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_facts(df: DataFrame, path: str, partition_by: Sequence[str] = ("expt", "phase")) -> None:
    """Write a fact table as parquet, split by its low-cardinality scan columns.

    Small per-subject logs should pass through here once: later scans then prune by dataset and phase and
    read the columns they use. Rows are rebalanced by those columns first, so that each writes few files of
    even size: adaptive execution cuts a large phase into several tasks and merges small ones.
    """
    columns = [c for c in partition_by if c in df.columns]
    rows = df.hint("rebalance", *[F.col(c) for c in columns]) if columns else df
    rows.write.mode("overwrite").partitionBy(*columns).parquet(path)


def save_bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None, hot_factor: float = 4.0
) -> bool:
    """Write a fact table to the catalog, one sorted file per bucket of ``keys``; whether it was bucketed.

    Summaries and pivots by the keys (or by more columns, the keys among them), and lookups with
    ``na_matches="never"`` between tables of the same buckets, then read ``spark.table(name)`` without an exchange of
    rows. A bucket is one task, so a key must not outgrow it: when one holds more than ``hot_factor`` even buckets
    of rows, the table is written plain, and its summaries combine on the map side as always. Missing keys are
    a key. ``path`` places the files outside the warehouse.
    """
    rows = written(df)
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    most, total = per_key.agg(F.max("_rows"), F.sum("_rows")).first()
    even = (most or 0) * buckets <= hot_factor * (total or 0)
    writer = (rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys) if even else rows.write).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return even


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a wide table as CSV with a header per part file, for an outside statistics program."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) as Spark sees them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def export_ordered_csv(df: DataFrame, path: str, order_by: Sequence[str], missing: str = "") -> None:
    """Write one CSV table whose parts, in the order of their names, are in key order under one header.

    Joined in that order the parts are one file, as an outside program reads it; nothing goes through the driver. The header
    is a row of its own that sorts before all others. Everything is written beside ``path`` and takes its place at
    the end, so a failed task leaves what was there and nothing else. (Where renaming a folder isn't one step, as
    in object stores, that holds up to the rename.) Rows of equal keys come in any order.
    """
    spark = df.sparkSession
    options = {"nullValue": missing, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    keys = [f"_k{i}" for i in range(len(order_by))]
    text = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("_line")
    rows = df.select(F.lit(1).alias("_part"), *[F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True)], text)
    names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), options)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    head = spark.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(kinds[k]).alias(k) for k in keys], names.alias("_line"))
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    files, source = _files(spark, staged)
    try:
        written(rows).unionByName(head).orderBy("_part", *keys).select("_line").write.text(staged)
        _, target = _files(spark, path)
        files.delete(target, True)
        if not files.rename(source, target):
            raise OSError(f"{staged} could not be renamed to {path}")
    finally:
        files.delete(source, True)
