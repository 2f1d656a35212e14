"""Least squares by triangular factors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from trialstats.functions import factors
from trialstats.operators import ols


def exact(x, y):
    """Coefficients by elimination in fractions."""
    rows = [[Fraction(1), *map(Fraction, r)] for r in x]
    k = len(rows[0])
    a = [[sum(r[i] * r[j] for r in rows) for j in range(k)] + [sum(r[i] * Fraction(v) for r, v in zip(rows, y, strict=True))] for i in range(k)]
    for i in range(k):
        pivot = next(j for j in range(i, k) if a[j][i])
        a[i], a[pivot] = a[pivot], a[i]
        a[i] = [v / a[i][i] for v in a[i]]
        for j in range(k):
            if j != i:
                a[j] = [v - a[j][i] * w for v, w in zip(a[j], a[i], strict=True)]
    return [float(r[-1]) for r in a]


def design(rng, n, near):
    z = rng.normal(size=(n, 2))
    x = np.column_stack([z[:, 0], z[:, 0] + near * z[:, 1]])
    return x, 2 * z[:, 0] - 3 * z[:, 1] + rng.normal(size=n)


def test_merged_factors_stand_for_all_rows():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 4)) + [0, 1e6, -5, 0]
    cuts = [0, 1, 3, 4, 100, 101, 350, 500]
    parts = [factors.factor_of(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    n, means, r = factors.merged([factors.merged(parts[:3]), *parts[3:]])
    assert n == 500 and np.allclose(means, rows.mean(0), rtol=1e-14)
    centred = rows - rows.mean(0)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-9, atol=1e-8)


@pytest.mark.parametrize("near", [1e-4, 1e-7])
def test_ill_conditioned_design(spark, near):
    """Condition 1/near: right to 1e-8 at 1e7, where cross-products have lost their digits."""
    rng = np.random.default_rng(2)
    x, y = design(rng, 400, near)
    want = exact(x.tolist(), y.tolist())
    data = [("g", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(data, "g string, a double, b double, y double").repartition(5)
    terms = [ols.Term.numeric("a"), ols.Term.numeric("b")]
    for keys in ([], ["g"]):
        fits = ols.fit_models(df, "y", {"m": terms, "one": terms[:1]}, keys, method="qr")
        got = [r.estimate for r in ols.coefficients(fits, "m", keys).orderBy("term_index").collect()]
        assert got[1:] == pytest.approx(want[1:], rel=1e-8)
        assert got[0] == pytest.approx(want[0], rel=1e-6)  # the small rest of two large products
        one = [r.estimate for r in ols.coefficients(fits, "one", keys).orderBy("term_index").collect()]
        assert one == pytest.approx(exact(x[:, :1].tolist(), y.tolist()), rel=1e-10)
    if near == 1e-7:
        plain = [r.estimate for r in ols.coefficients(ols.fit_models(df, "y", {"m": terms}), "m").orderBy("term_index").collect()]
        assert None in plain or max(abs(p - w) / abs(w) for p, w in zip(plain, want, strict=True)) > 1e-6


def test_same_as_moments_on_plain_designs(spark):
    rng = np.random.default_rng(3)
    data = []
    for g in (None, float("nan"), 1.0, 2.0):
        for i in range(40):
            a, b, e = rng.normal(size=3).tolist()
            data.append((g, f"k{i % 2}", a, b, 1 + a - 2 * b + e, "F" if i % 3 else "O"))
    data += [(3.0, "k0", 1.0, 1.0, 1.0, "F"), (3.0, "k0", 2.0, 2.0, 1.0, "O"), (1.0, "k0", None, 2.0, 1.0, "O")]
    df = spark.createDataFrame(data, "g double, h string, a double, b double, y double, f string").repartition(4)
    a, b, f = ols.Term.numeric("a"), ols.Term.numeric("b"), ols.Term.contrast("f", "f", ("F", "O"))
    models = {"m": [a, b], "f": [f, a, b, f.interact(a)]}
    tables = []
    for method in ("moments", "qr"):
        fits = ols.fit_models(df, "y", models, ["g", "h"], method=method)
        rows = ols.coefficients(fits, ["m", "f"], ["g", "h"]).collect() + ols.fit_stats(fits, "f", ["g", "h"]).collect() + ols.compare(fits, "m", "f", ["g", "h"]).collect()
        tables.append({repr(tuple(v for v in r if not isinstance(v, float) or math.isnan(v))[:5]) + repr(r.g): [v for v in r if isinstance(v, float)] for r in rows})
    assert tables[0].keys() == tables[1].keys() and len(tables[0]) > 40
    for key, values in tables[0].items():
        assert tables[1][key] == pytest.approx(values, rel=1e-8, abs=1e-9, nan_ok=True)


def test_leave_one_out_of_an_ill_conditioned_design(spark):
    rng = np.random.default_rng(4)
    x, y = design(rng, 60, 1e-7)
    z = np.column_stack([np.ones(60), x[:, 0], (x[:, 1] - x[:, 0]) * 1e7])  # the same span
    hat = z @ np.linalg.solve(z.T @ z, z.T)
    want = np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y double")
    got = ols.leave_one_out(df, "y", [ols.Term.numeric("a"), ols.Term.numeric("b")], method="qr").first()
    assert got.n == 60 and got.loo_mse == pytest.approx(want, rel=1e-6)


def test_aliased_constant_and_short_groups(spark):
    rows = [("alias", float(i), 2.0 * i + 3, float(i % 5), float(i * i)) for i in range(30)]
    rows += [("flat", 7.0, float(i), float(i % 3), float(i)) for i in range(30)] + [("two", 1.0, 2.0, 3.0, 4.0), ("two", 2.0, 2.5, 1.0, 4.5)]
    rows += [("far", 1e9 + i, float((i * 7) % 11), float(i % 2), 2.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    terms = [ols.Term.numeric(n) for n in "abc"]
    fits = ols.fit_models(df, "y", {"m": terms}, ["g"], method="qr")
    got = {r.g: [x.estimate for x in sorted(rs, key=lambda r: r.term_index)] for r, rs in _by_group(ols.coefficients(fits, "m", ["g"]).collect())}
    assert [v is None for v in got["alias"]] == [False, False, True, False]
    assert [v is None for v in got["flat"]] == [False, True, False, False]
    assert got["two"] == [None] * 4
    assert got["far"][1:] == pytest.approx([2, 0, 0], abs=1e-6)
    plain = {r.g: r.loo_mse for r in ols.leave_one_out(df, "y", terms, ["g"]).collect()}
    by_factor = {r.g: r.loo_mse for r in ols.leave_one_out(df, "y", terms, ["g"], method="qr").collect()}
    assert by_factor["alias"] == pytest.approx(plain["alias"], rel=1e-8) and by_factor["two"] is None


def _by_group(rows):
    for g in {r.g for r in rows}:
        yield next(r for r in rows if r.g == g), [r for r in rows if r.g == g]


def test_many_groups_and_one_exchange(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("id % 7000 g", "cast(id % 13 as double) a", "cast(id % 13 + id % 7 as double) y").repartition(3)
    fits = ols.fit_models(df, "y", {"m": [ols.Term.numeric("a")]}, ["g"], method="qr")
    assert fits.count() == 7000
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(g") == 1


def test_empty_table_and_bad_values(spark):
    df = spark.createDataFrame([(1, float("inf"), 1.0), (1, 1.0, 2.0), (1, 2.0, 2.0), (1, 4.0, 2.0)], "g int, a double, y double")
    terms = {"m": [ols.Term.numeric("a")]}
    assert ols.fit_models(df, "y", terms, ["g"], method="qr").first().m.coef is None
    assert ols.fit_models(df.limit(0), "y", terms, ["g"], method="qr").collect() == []
    with pytest.raises(ValueError):
        ols.fit_models(df, "y", terms, method="other")
