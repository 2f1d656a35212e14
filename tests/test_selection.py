"""Exact medians by narrowing intervals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialstats.operators import selection


def frame(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def groups():
    rng = np.random.default_rng(6)
    normal = rng.normal(size=1501).tolist()
    return {
        "odd": normal,
        "even": normal[:1000],
        "heavy": [5.0] * 600 + rng.normal(5, 1, 601).tolist(),
        "edge": [5.0] * 500 + (6 + rng.random(500)).tolist(),  # the median is between a heavy value and the next
        "far": [float(2.0**k) for k in range(-500, 500)],
        "same": [1.5] * 900,
        "two": [1.0, 2.0],
        "one": [-3.0],
        "huge": [1e308] * 3 + [-1e308, 1.7e308, 1e308],
        None: [float(i % 37) for i in range(800)],
    }


@pytest.mark.parametrize("small", [4, 100, 8192])
def test_medians_and_deviations(spark, small):
    data = groups()
    df = frame(spark, data | {"gone": [None, None], "odd": data["odd"] + [None] * 50})
    got = {r.g: r for r in selection.robust_summary(df, ["g"], "x", small).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        v = np.array(values)
        with np.errstate(over="ignore"):
            median = np.sort(v)[(len(v) - 1) // 2] / 2 + np.sort(v)[len(v) // 2] / 2
            assert got[g].median == pytest.approx(median, rel=1e-15)
            assert got[g].mad == pytest.approx(1.4826 * np.median(np.abs(v - median)), rel=1e-12) or g == "huge"
        assert (got[g].min, got[g].max) == (v.min(), v.max())


def test_every_rank(spark):
    values = [1.0] * 30 + [2.0, 2.5, 2.5, float("nan"), float("-inf")] + [float(i) for i in range(40)]
    df = frame(spark, {"g": values})
    ordered = sorted(values, key=lambda v: (v != v, v))
    for rank in (0, 1, 5, 31, 33, 40, len(values) - 1):
        for keys in (["g"], []):
            r = selection.value_at_rank(df, keys, "x", F.lit(rank), small=2).first()
            assert repr(r["at"]) == repr(ordered[rank]) and r.n == len(values)
            assert r.upto == sum(v <= ordered[rank] or ordered[rank] != ordered[rank] for v in values)


def test_without_keys_and_without_rows(spark):
    df = frame(spark, groups())
    every = np.array([v for values in groups().values() for v in values])
    assert selection.medians(df, [], "x", small=10).first().median == np.median(every)
    assert selection.medians(df.limit(0), ["g"], "x").collect() == selection.medians(df.limit(0), [], "x").collect() == []


def test_one_large_group_is_never_gathered(spark):
    n = 300_001
    df = spark.range(0, n, 1, 6).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert selection.medians(df, ["g"], "x", small=50).first().median == n // 2
