"""Scalar functions and strict aggregates, with missing values at every place."""

import pytest
from pyspark.sql import functions as F

from trialstats.functions import columns as C
from trialstats.functions import text
from trialstats.operators import clean, summarise


def values(df):
    return [tuple(r) for r in df.collect()]


def test_strict_aggregates_are_missing_with_a_missing_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None)], "g string, v double")
    out = df.groupBy("g").agg(
        C.strict_avg("v").alias("m"), C.strict_sum("v").alias("s"), C.strict_avg("v", skip_nulls=True).alias("k")
    )
    assert sorted(values(out)) == [("a", 2.0, 4.0, 2.0), ("b", None, None, 2.0)]


def test_strict_with_a_condition_only_looks_at_its_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None)], "w int, v double")
    got = df.agg(C.strict_avg("v", F.col("w") == 1), C.strict_avg("v", F.col("w") == 2), C.strict_avg("v", F.col("w") == 3))
    assert values(got) == [(1.5, None, None)]


def test_if_else_keeps_a_missing_condition_missing(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    assert values(df.select(C.binarise("x"))) == [(0,), (1,), (1,), (None,)]


def test_reverse_key(spark):
    df = spark.createDataFrame([(1, "r"), (4, "r"), (3, "n"), (3, None), (None, "r")], "v int, k string")
    assert values(df.select(C.reverse_key("v", "k"))) == [(3,), (0,), (3,), (None,), (None,)]


def test_rebase_collapse_recode_levels(spark):
    df = spark.createDataFrame([("prac",), ("0",), ("9",), (None,)], "b string")
    assert values(df.select(C.rebase_block("b"))) == [(None,), (1,), (10,), (None,)]
    df = spark.createDataFrame([("pre_new",), ("b",), (None,)], "c string")
    assert values(df.select(C.collapse_label("c", "new", "new"))) == [("new",), ("b",), (None,)]
    df = spark.createDataFrame([("1",), ("2",), ("7",)], "c string")
    assert values(df.select(C.recode("c", {"1": "val", "2": "aro"}))) == [("val",), ("aro",), ("7",)]
    df = spark.createDataFrame([("nt",), ("t",), ("x",), (None,)], "c string")
    assert values(df.select(C.level_rank("c", ["t", "nt"]), C.relabel("c", ["t", "nt"], ["Think", "No-Think"]))) == [
        (2, "No-Think"),
        (1, "Think"),
        (None, None),
        (None, None),
    ]


def test_p_text(spark):
    df = spark.createDataFrame([(0.0005,), (0.0396851,), (0.5,), (0.9994,), (0.9997,), (1.0,), (None,)], "p double")
    assert [r[0] for r in values(df.select(text.format_p("p")))] == [
        "_p_ < .001", "_p_ = .040", "_p_ = .500", "_p_ = .999", "_p_ > .999", "_p_ > .999", None,
    ]
    assert [r[0] for r in values(df.select(text.format_p_cell("p")))] == [
        "< .001", ".040", ".500", "> .999", "> .999", "> .999", None,
    ]


def test_exclusion_keeps_missing_keys_in_both_forms(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "s int")
    gone = spark.createDataFrame([(2,)], "other int")
    assert sorted(values(clean.exclude(df, "s", [2])), key=str) == [(1,), (None,)]
    assert sorted(values(clean.exclude(df, "s", gone)), key=str) == [(1,), (None,)]
    assert clean.exclude(df, "s", None).count() == clean.exclude(df, "s", []).count() == 3


def test_drop_of_an_unknown_column_is_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.drop_columns(df, ["b"]).columns == ["a"]
    with pytest.raises(ValueError, match="no such columns"):
        clean.drop_columns(df, ["c"])


def test_column_choice_helpers(spark):
    df = spark.createDataFrame([(1, 0.125, 2.5, 0.375)], "k int, b double, nt double, t double")
    assert clean.column_range(df, "b", "nt") == ["b", "nt"]
    assert clean.columns_with_prefix(df, "n") == ["nt"]
    assert values(clean.round_doubles(df)) == [(1, 0.12, 2.5, 0.38)]
    assert values(clean.compute_consuming(df, ["b", "t"], d=F.col("t") - F.col("b"))) == [(1, 2.5, 0.25)]


def test_zero_divisors_give_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = summarise.correlations(df, ["x", "y"]).first()
    assert (row.n, row.t, row.p_value) == (3, None, None)
    empty = summarise.mean_se(df.filter("x > 5"), [], "x").first()
    assert (empty.n, empty["mean"], empty.se) == (0, None, None)


def test_counts_treat_a_missing_key_as_a_group(spark):
    df = spark.createDataFrame([(1, None), (1, 0), (None, None)], "s int, v int")
    assert sorted(values(summarise.count_by(df, ["s"])), key=str) == [(1, 2), (None, 1)]
    assert sorted(values(summarise.missing_count(df, ["s"], "v")), key=str) == [(1, 1), (None, 1)]


def test_demographics_count_distinct_subjects(spark):
    rows = [(1, 1, 20)] * 5 + [(2, 0, 22)] * 3
    got = summarise.demographics(spark.createDataFrame(rows, "s int, m int, a int"), "s", "m", "a").first()
    assert (got.n, got.male, got.mean_age) == (2, 1, 21.0)
    assert got.sd_age == pytest.approx(2**0.5)


def test_two_level_means_weigh_subjects_equally(spark):
    df = spark.createDataFrame([("c", 1, 1.0)] * 9 + [("c", 2, 0.0)], "g string, s int, v double")
    got = summarise.two_level(df, ["g"], ["s"], ["v"]).first()
    assert got.v_mean == 0.5


def test_robust_summary_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 501)
    df = spark.createDataFrame([("g", int(v)) for v in x] + [("one", 3)], "g string, n int")
    got = {r.g: r for r in summarise.robust_summary(df, ["g"], "n").collect()}
    med = np.median(x)
    assert got["g"].median == med
    assert got["g"].mad == pytest.approx(1.4826 * np.median(np.abs(x - med)))
    assert got["g"].sd == pytest.approx(x.std(ddof=1))
    assert (got["g"].min, got["g"].max) == (x.min(), x.max())
    assert got["one"].sd is None
