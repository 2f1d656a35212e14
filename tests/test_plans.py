"""Plans: what reaches the scan, how often a table is read, and that nothing is multiplied out."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from trialstats.operators import clean
from trialstats.sources.roles import phase, table

QUERIES = driver.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phase_filter_and_column_pruning_reach_the_scan(spark, sf_dir):
    text = plan(phase(spark, sf_dir, "pre").select("subj", "correct"))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>", text)


def test_list_exclusion_reaches_the_scan(spark, sf_dir):
    text = plan(clean.exclude(table(spark, sf_dir, "events"), "user_id", [3, 5]).select("event_id"))
    assert "PushedFilters: [Or(IsNull(user_id),Not(In(user_id, [3,5])))]" in text
    assert "Join" not in text


@pytest.mark.parametrize("name", ["ols_model_compare", "model_compare_table", "step_tables", "join_right_suffix", "ols_nested_models"])
def test_nested_models_read_the_rows_once(spark, sf_dir, name):
    assert plan(QUERIES[name](spark, sf_dir)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["paired_t_long", "substitute_hit_rate", "score_spread", "robust_summary"])
def test_trial_pipelines_aggregate_by_hash(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in text


JOINING = ["join_chain_subject", "join_condition_on_pretest", "moderated_compare", "holm_adjust", "loocv_press", "pca_scores"]


@pytest.mark.parametrize("name", JOINING)
def test_joins_have_keys_or_attach_one_row(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert "CartesianProduct" not in plan(df)
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if re.search(r"Join (Inner|LeftOuter|Cross)(, \w+Hint=.*)?$", line):
            assert "rightHint=(strategy=broadcast)" in line


def test_strict_mean_is_one_partial_aggregate(spark, sf_dir):
    from trialstats.functions.columns import strict_avg

    text = plan(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(strict_avg(F.col("l_tax")).alias("m")))
    assert text.count("Exchange") == 1 and "partial_avg" in text


@pytest.mark.parametrize("name", ["loocv_press", "pca_regression"])
def test_few_groups_leave_the_rows_in_place(spark, sf_dir, name):
    """With Spark's own broadcasts off, no exchange lies between the rows' scan and the partial aggregate behind the join."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in text
    if name == "loocv_press":
        assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") <= 1


def test_lookup_reads_its_left_side_once(spark, sf_dir):
    assert plan(QUERIES["join_condition_on_pretest"](spark, sf_dir)).count("FileScan") == 2


def test_holm_computes_its_values_once(spark, sf_dir):
    text = plan(QUERIES["holm_adjust"](spark, sf_dir))
    assert not any(x in text for x in ("ArrowEvalPython", "BatchEvalPython"))


@pytest.mark.parametrize("name", ["simple_slopes", "ols_report", "moderated_coefficients"])
def test_coefficient_tables_need_no_shuffle_of_their_own(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    if name != "moderated_coefficients":
        assert len(re.findall(r"Exchange (hash|single|range)", text)) == 1
        assert text.count("ArrowEvalPython") <= 3  # the solves, and all tails at once
    assert "collect_list" not in text
