"""Pair moments by blocked matrix products against one aggregate per pair."""

import numpy as np
import pytest

from trialstats.functions import products
from trialstats.operators import pca, summarise


def wide_frame(spark, p, groups, rows, seed=8, missing=0.1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, p)) + rng.normal(size=(rows, 1)) + np.linspace(0, 1e6, p)
    base[rng.random((rows, p)) < missing] = np.nan
    names = [f"v{i}" for i in range(p)]
    data = [[groups[i % len(groups)], *(None if x != x else x for x in r)] for i, r in enumerate(base.tolist())]
    return spark.createDataFrame(data, "g string, " + ", ".join(f"{n} double" for n in names)).repartition(6), names, base


def same(a, b, by):
    a, b = ({tuple(r[k] for k in by): r for r in rows} for rows in (a, b))
    assert a.keys() == b.keys()
    for k, row in a.items():
        for name in row.asDict():
            want, got = row[name], b[k][name]
            assert (want is None) == (got is None) and (want is None or isinstance(want, str) or got == pytest.approx(want, rel=1e-6, abs=1e-9)), (k, name, want, got)


@pytest.mark.parametrize("block", [3, 64])
def test_equal_to_one_aggregate_per_pair(spark, monkeypatch, block):
    monkeypatch.setattr(products, "BLOCK", block)
    df, names, _ = wide_frame(spark, 7, ["a", "b", None], 120)
    df = df.selectExpr("*", "7.25D flat", "case when v1 is null then 1.5D end never", "cast(null as double) none", "cast(case when v0 is null then 1 else 3 end as int) whole")
    columns = [*names, "none", "whole"]
    for constant in ("flat", "never"):
        assert {(r.r, r.p_value) for r in summarise.correlations(df, ["v0", constant], ["g"], wide=0).collect()} == {(None, None)}
    for keys in (["g"], []):
        for operator in (summarise.correlations, summarise.pair_regressions):
            same(operator(df, columns, keys, wide=99).collect(), operator(df, columns, keys, wide=0).collect(), [*keys, "x", "y"])


def test_components_equal_the_small_path(spark):
    df, names, _ = wide_frame(spark, 6, ["a", "b"], 200, missing=0.01)
    one, two = ({r.g: r for r in pca.fit_pca(df, names, ["g"], wide=w).collect()} for w in (99, 0))
    for g, row in one.items():
        for name in ("n", "means", "sds", "corr", "variances"):
            assert two[g][name] == pytest.approx(row[name], rel=1e-7, abs=1e-9)
        assert np.allclose(two[g].loadings, row.loadings, atol=1e-6)
    scores = [sorted(r.pc1 for r in pca.scores(df, pca.fit_pca(df, names, ["g"], wide=w), names, ["g"], 1).collect()) for w in (99, 0)]
    assert scores[1] == pytest.approx(scores[0], abs=1e-6)


def test_five_hundred_columns(spark):
    df, names, base = wide_frame(spark, 500, ["a"], 300)
    got = {(r.x, r.y): r for r in summarise.correlations(df, names).collect()}
    assert len(got) == 500 * 499 // 2
    rng = np.random.default_rng(1)
    for i, j in np.sort(rng.integers(0, 500, (300, 2)), axis=1).tolist():
        if i < j:
            both = ~np.isnan(base[:, i]) & ~np.isnan(base[:, j])
            r = got[names[i], names[j]]
            assert r.n == both.sum() and r.r == pytest.approx(np.corrcoef(base[both, i], base[both, j])[0, 1], rel=1e-8)


def test_many_groups_flush_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(products, "OPEN_BYTES", 5000)
    df = spark.range(4000).selectExpr("id % 300 g", "cast(id as double) a", "cast(id * id as double) b", "cast(id % 7 as double) c").repartition(4)
    same(summarise.correlations(df, ["a", "b", "c"], ["g"], wide=9).collect(), summarise.correlations(df, ["a", "b", "c"], ["g"], wide=0).collect(), ["g", "x", "y"])
    assert summarise.correlations(df.limit(0), ["a", "b"], ["g"], wide=0).collect() == []
    assert pca.fit_pca(df.limit(0), ["a", "b"], ["g"], wide=0).collect() == []


def test_far_groups_keep_their_digits(spark):
    rows = [(g, 1e9 * k + i * 0.5, (i * 7) % 11 + 0.25) for k, g in enumerate("abc") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    want = np.corrcoef(np.arange(50) * 0.5, [(i * 7) % 11 for i in range(50)])[0, 1]
    assert [r.r for r in summarise.correlations(df, ["a", "b"], ["g"], wide=0).collect()] == pytest.approx([want] * 3, rel=1e-9)
