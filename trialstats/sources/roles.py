"""Role views: plain event and order tables seen as trial logs and questionnaire items.

``SQL_TRIALS`` and ``SQL_ITEMS`` hold the same definitions as SQL text, for side-by-side checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type to condition, and the instrument each event type stands for.
CONDITIONS = {"view": "b", "click": "nt", "purchase": "t", "signup": "filler"}
INSTRUMENTS = {"view": "bdi", "click": "rrs", "purchase": "stais", "signup": "stait", "error": "other"}
PRE_ENDS = "2024-01-16"


# Fixed schemas: reading starts without a job that looks for them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _map(column, mapping, otherwise):
    out = otherwise
    for old, new in reversed(list(mapping.items())):
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a trial log: one row per presentation of an item to a subject."""
    return as_trials(table(spark, sf_dir, "events"))


def _props_k():
    # one flat number: a pattern reads it at a third of the cost of a JSON parse
    return F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).try_cast("int")


def as_trials(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    k = _props_k()
    day_block = F.floor((F.dayofmonth("ts") - 1) / 3).cast("int")
    new = F.when(e % 2 == 1, F.lit("post_new")).otherwise(F.lit("pre_new"))
    return events.select(
        e.alias("event_id"),
        F.col("user_id").alias("subj"),
        F.when(e % 19 != 0, F.col("user_id")).alias("subj_raw"),
        F.when(F.col("user_id") % 2 == 0, F.lit("ds")).otherwise(F.lit("ts")).alias("expt"),
        _map(F.col("event_type"), CONDITIONS, new).alias("cond"),
        (k % 10).alias("item"),
        (day_block + 1).alias("block"),
        F.when(e % 29 == 0, F.lit("prac")).otherwise(day_block.cast("string")).alias("block_raw"),
        F.when(_is_pre(), F.lit("pre")).otherwise(F.lit("post")).alias("time"),
        F.when(e % 4 != 3, (e % 4).cast("int")).alias("outcome"),
        F.when(e % 11 == 0, None).when(e % 5 == 0, 0).otherwise(1).alias("correct"),
        F.when(e % 13 != 0, F.col("value")).alias("val"),
        F.when(e % 17 != 0, ((e * 7) % 9 + 1).cast("int")).alias("aro"),
    )


def _is_pre():
    return F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{PRE_ENDS}'")


def phase(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """One phase of ``trials``; the filter on ``ts`` reaches the scan."""
    events = table(spark, sf_dir, "events")
    return as_trials(events.filter(_is_pre() if which == "pre" else ~_is_pre()))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a questionnaire item log: instrument, item, key and value."""
    e = F.col("event_id")
    k = _props_k()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subj"),
        F.when(F.col("user_id") % 2 == 0, F.lit("ds")).otherwise(F.lit("ts")).alias("expt"),
        _map(F.col("event_type"), INSTRUMENTS, F.lit(None).cast("string")).alias("ques"),
        k.alias("item"),
        F.when(k % 2 == 1, F.lit("r")).otherwise(F.lit("n")).alias("cond"),
        (e % 5).cast("int").alias("value"),
    )


SQL_TRIALS = f"""trials AS (
  SELECT event_id, user_id AS subj,
    CASE WHEN event_id % 19 <> 0 THEN user_id END AS subj_raw,
    CASE WHEN user_id % 2 = 0 THEN 'ds' ELSE 'ts' END AS expt,
    CASE event_type WHEN 'view' THEN 'b' WHEN 'click' THEN 'nt' WHEN 'purchase' THEN 't'
      WHEN 'signup' THEN 'filler' ELSE CASE WHEN event_id % 2 = 1 THEN 'post_new' ELSE 'pre_new' END END AS cond,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS INTEGER) AS item,
    CAST(floor((day(ts) - 1) / 3e0) AS INTEGER) + 1 AS block,
    CASE WHEN event_id % 29 = 0 THEN 'prac'
      ELSE CAST(CAST(floor((day(ts) - 1) / 3e0) AS INTEGER) AS VARCHAR) END AS block_raw,
    CASE WHEN ts < TIMESTAMP '{PRE_ENDS}' THEN 'pre' ELSE 'post' END AS time,
    CASE WHEN event_id % 4 <> 3 THEN CAST(event_id % 4 AS INTEGER) END AS outcome,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS correct,
    CASE WHEN event_id % 13 <> 0 THEN value END AS val,
    CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 7) % 9 + 1 AS INTEGER) END AS aro
  FROM events)"""

SQL_ITEMS = """items AS (
  SELECT user_id AS subj, CASE WHEN user_id % 2 = 0 THEN 'ds' ELSE 'ts' END AS expt,
    CASE event_type WHEN 'view' THEN 'bdi' WHEN 'click' THEN 'rrs' WHEN 'purchase' THEN 'stais'
      WHEN 'signup' THEN 'stait' WHEN 'error' THEN 'other' END AS ques,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS item,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 1 THEN 'r' ELSE 'n' END AS cond,
    CAST(event_id % 5 AS INTEGER) AS value
  FROM events)"""
