"""Distribution functions, paired tests, Holm, components and regression against direct computation."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialstats.functions import distributions as D
from trialstats.operators import linking, ols, paired, pca
from trialstats.operators.adjust import holm_adjust, holm_values


def test_t_tail_known_values(spark):
    # t with 1 and 2 degrees of freedom have closed forms
    t = np.array([0.3, 1.0, 5.0, 50.0])
    assert D.upper_t(t, np.ones(4)) == pytest.approx(0.5 - np.arctan(t) / math.pi, rel=1e-11)
    assert D.upper_t(t, np.full(4, 2.0)) == pytest.approx(0.5 - t / (2 * np.sqrt(2 + t * t)), rel=1e-9)
    assert D.upper_t(-t, np.full(4, 7.0)) == pytest.approx(1 - D.upper_t(t, np.full(4, 7.0)), rel=1e-12)


def test_t_tail_meets_the_normal_at_large_df():
    z = np.array([0.5, 1.96, 4.0])
    normal = np.array([math.erfc(v / math.sqrt(2)) for v in z])
    assert D.two_sided_t(z, np.full(3, 9e6)) == pytest.approx(normal, rel=1e-4)
    below, above = D.two_sided_t(z, np.full(3, D.LARGE_DF)), D.two_sided_t(z, np.full(3, D.LARGE_DF * (1 + 1e-9)))
    assert below == pytest.approx(above, rel=1e-6)


def test_f_tail_is_the_squared_t(spark):
    df = spark.createDataFrame([(2.5, 17.0)], "t double, df double")
    p_t, p_f = df.select(D.t_p_value("t", "df"), D.f_p_value(F.col("t") * F.col("t"), F.lit(1), "df")).first()
    assert p_t == pytest.approx(p_f, rel=1e-12)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.01, 30), st.integers(1, 40), st.integers(1, 400))
def test_f_tail_against_the_finite_sum(f, half, df2):
    df1 = 2 * half
    x = df2 / (df2 + df1 * f)
    y = 1 - x
    terms = [math.exp(math.lgamma(df2 / 2 + j) - math.lgamma(j + 1) - math.lgamma(df2 / 2)) * y**j for j in range(half)]
    want = x ** (df2 / 2) * math.fsum(terms)
    got = D.beta_inc(*[np.array([v]) for v in (df2 / 2, df1 / 2, x, df1 * f / (df2 + df1 * f))])[0]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-14)


@pytest.mark.parametrize("df", [1, 2, 3, 7, 29, 600, 5000])
def test_t_quantile_inverts_the_tail(df):
    q = D.t_quantiles(0.975, np.array([float(df)]))
    assert D.upper_t(q, np.array([float(df)]))[0] == pytest.approx(0.025, rel=1e-10)


def test_noncentral_limits_known_values(spark):
    # fixed values: standardised mean difference limits for n = 27, 30, 30
    rows = [(-2.1657556, 26, -0.8068097, -0.0194496), (-0.5958340, 29, -0.4667785, 0.2510670), (-1.9533994, 29, -0.7230832, 0.0155613)]
    df = spark.createDataFrame(rows, "t double, df int, lo double, hi double")
    for r in df.select("*", D.noncentral_t_limits("t", "df").alias("ci")).collect():
        root = math.sqrt(r.df + 1)
        assert (r.ci.low / root, r.ci.high / root) == (pytest.approx(r.lo, abs=2e-7), pytest.approx(r.hi, abs=2e-7))


def test_paired_t_against_numpy_and_edge_groups(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=40), rng.normal(0.3, 1, 40)
    rows = [("g", float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [("g", 1.0, None), ("const", 1.0, 0.5), ("const", 2.0, 1.5), ("one", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in paired.paired_report(paired.paired_t(df, "x", "y", ["k"], "less")).collect()}
    d = x - y
    t = d.mean() / (d.std(ddof=1) / math.sqrt(40))
    assert got["g"].t == pytest.approx(t) and got["g"].df == 39
    assert got["g"].dz == pytest.approx(t / math.sqrt(40))
    assert got["g"].p_value == pytest.approx(1 - D.upper_t(np.array([t]), np.array([39.0]))[0])
    assert got["g"].dz_low < got["g"].dz < got["g"].dz_high
    assert got["g"].report.startswith("_t_(39) = ")
    for k in ("const", "one"):
        assert (got[k].t, got[k].p_value, got[k].dz, got[k].report) == (None, None, None, None)


def test_paired_long_pairs_by_unit_not_by_order(spark):
    rows = [(1, "nt", 1.0), (2, "nt", 2.0), (3, "nt", 4.0), (3, "b", 1.0), (1, "b", 5.0), (2, "b", 2.5)]
    df = spark.createDataFrame(rows, "s int, c string, v double")
    got = paired.paired_t_long(df, ["s"], "c", "v", ("nt", "b")).first()
    assert got.mean_diff == pytest.approx(np.mean([1 - 5, 2 - 2.5, 4 - 1]))


def holm_direct(p):
    n, order, out, top = len(p), np.argsort(p, kind="stable"), np.empty(len(p)), 0.0
    for rank, i in enumerate(order):
        top = max(top, (n - rank) * p[i])
        out[i] = min(1.0, top)
    return out


def test_holm_example(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,), (None,)], "p double")
    got = {r.p: r.p_adj for r in holm_adjust(df, "p").collect()}
    assert got == {0.01: pytest.approx(0.03), 0.04: pytest.approx(0.06), 0.03: pytest.approx(0.06), 0.005: pytest.approx(0.02), None: None}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.sampled_from([0.0, 0.01, 0.01, 1.0]), st.floats(0, 1))), min_size=1, max_size=60))
def test_holm_of_long_and_short_families(spark, rows):
    df = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(rows)], "id int, f string, p double")
    got = {r.id: r.p_adj for r in holm_adjust(df, "p", ["f"]).collect()}
    for family in "ab":
        ids = [i for i, (f, _) in enumerate(rows) if f == family]
        if ids:
            want = holm_direct(np.array([rows[i][1] for i in ids]))
            assert [got[i] for i in ids] == pytest.approx(list(want), abs=1e-12)
            array = F.array(*[F.lit(rows[i][1]) for i in ids])
            assert spark.range(1).select(holm_values(array)).first()[0] == pytest.approx(list(want), abs=1e-12)


def test_a_missing_group_is_a_group(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, *map(float, rng.normal(size=3))) for g in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id int, x double, z double, y double")
    scored = pca.scores(df, pca.fit_pca(df, ["x", "z", "y"], ["g"]), ["x", "z", "y"], ["g"])
    assert scored.count() == 40 and scored.filter("pc1 is null").count() == 0
    loo = {r.g: r.n for r in ols.leave_one_out(df, "y", [ols.Term.numeric("x"), ols.Term.numeric("z")], ["g"]).collect()}
    assert loo == {"a": 20, None: 20}
    p = spark.createDataFrame([("a", 0.01), ("a", 0.02), (None, 0.01), (None, 0.04), (None, None)], "f string, p double")
    got = {(r.f, r.p): r.p_adj for r in holm_adjust(p, "p", ["f"]).collect()}
    assert got == {("a", 0.01): 0.02, ("a", 0.02): 0.02, (None, 0.01): 0.02, (None, 0.04): 0.04, (None, None): None}


def test_tails_and_limits_at_their_borders(spark):
    x = np.linspace(-6, 26, 2001)
    assert np.allclose(D.erfc(x), [math.erfc(v) for v in x], rtol=2e-14, atol=0)
    t = np.array([0.5, 2.0, 5.0, 10.0, 30.0])
    below, above = (D.two_sided_t(t, np.full(5, v)) for v in (D.LARGE_DF, D.LARGE_DF * (1 + 1e-12)))
    assert np.allclose(below, above, rtol=1e-11, atol=0)
    assert np.allclose(D.two_sided_t(t[:3], np.full(3, 1e12)), [math.erfc(v / math.sqrt(2)) for v in t[:3]], rtol=1e-9, atol=0)
    mixed = D.two_sided_t(np.array([2.0, 3.0]), np.array([5.0, 99_999.0]))
    assert mixed[0] == D.two_sided_t(np.array([2.0]), np.array([5.0]))[0]  # whatever shares the batch
    quantiles = D.t_quantiles(0.975, np.array([999.0, 1000.0, 1001.0]))
    assert np.abs(D.upper_t(quantiles, np.array([999.0, 1000.0, 1001.0])) - 0.025).max() < 1e-13
    for value, df in ((2, 1), (200, 4), (500, 20), (2000, 1e4), (-3, 29), (0, 5)):
        low, high = D.noncentral_limits(np.array([float(value)]), np.array([float(df)]), 0.95)
        s = np.linspace(max(1e-12, 1 - 12 / math.sqrt(2 * df)), 1 + 12 / math.sqrt(2 * df), 200_001)
        density = np.exp((df - 1) * np.log(s) - df * (s * s - 1) / 2)
        for limit, want in ((low[0], 0.975), (high[0], 0.025)):
            below = np.trapezoid(density * D.erfc(-(value * s - limit) / math.sqrt(2)) / 2, s) / np.trapezoid(density, s)
            assert abs(below - want) < 1e-6


def test_components_against_numpy_per_group(spark):
    rng = np.random.default_rng(5)
    data = {g: rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) for g in ("x", "y")}
    rows = [(g, i, *map(float, v)) for g, m in data.items() for i, v in enumerate(m)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double, c double, d double")
    fit = pca.fit_pca(df, names, ["g"])
    share = {(r.g, r.component): r for r in pca.importance(fit, ["g"]).collect()}
    load = {(r.g, r.component, r.variable): r.loading for r in pca.loadings(fit, names, ["g"]).collect()}
    points = {(r.g, r.id): r for r in pca.scores(df, fit, names, ["g"], hot_rows=20).collect()}
    biplot = {(r.g, r.id): r for r in pca.scores(df, fit, names, ["g"], 2, scaled=True).collect()}
    for g, m in data.items():
        z = (m - m.mean(0)) / m.std(0, ddof=1)
        values, vectors = np.linalg.eigh(np.corrcoef(m.T))
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(4)])
        for k in range(4):
            assert share[g, k + 1].sdev == pytest.approx(math.sqrt(values[k]))
            assert share[g, k + 1].cumulative == pytest.approx(values[: k + 1].sum() / 4)
            assert [load[g, k + 1, n] for n in names] == pytest.approx(list(vectors[:, k]))
        want = z @ vectors
        assert [points[g, 7][f"pc{k + 1}"] for k in range(4)] == pytest.approx(list(want[7]))
        assert biplot[g, 7].pc2 == pytest.approx(want[7, 1] / math.sqrt(values[1]))


def direct_ols(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    leverage = np.einsum("ij,jk,ik->i", x, inv, x)
    return b, np.sqrt(s2 * np.diag(inv)), e @ e, np.mean((e / (1 - leverage)) ** 2), s2 * inv


@pytest.fixture(scope="module")
def moderation(spark):
    rng = np.random.default_rng(11)
    n = {"ds": 30, "ts": 41}
    frames, rows = [], []
    for g, size in n.items():
        pcs = rng.normal(1e4, 1.0, size=(size, 2))  # far from zero, to show that nothing cancels
        y = 0.5 + 0.3 * pcs[:, 0] - 0.2 * pcs[:, 1] + (0.4 if g == "ts" else 0) * pcs[:, 0] + rng.normal(size=size)
        frames.append((g, pcs, y))
        rows += [(g, float(a), float(b), float(v)) for (a, b), v in zip(pcs, y, strict=True)]
    rows.append(("ds", 1.0, None, 2.0))
    df = spark.createDataFrame(rows, "expt string, pc1 double, pc2 double, y double")
    code = np.concatenate([np.full(30, -0.5), np.full(41, 0.5)])
    pcs = np.vstack([f[1] for f in frames])
    return df, code, pcs, np.concatenate([f[2] for f in frames])


def test_regression_with_interactions_against_numpy(spark, moderation):
    df, code, pcs, y = moderation
    group = ols.Term.contrast("group1", "expt", ("ds", "ts"))
    pc1, pc2 = ols.Term.numeric("pc1"), ols.Term.numeric("pc2")
    models = {"step1": [group, pc1, pc2], "step2": [group, pc1, pc2, group.interact(pc1), group.interact(pc2)]}
    fits = ols.fit_models(df, "y", models)
    x1 = np.column_stack([code, pcs])
    x2 = np.column_stack([x1, code * pcs[:, 0], code * pcs[:, 1]])
    centred = pcs - pcs.mean(0)
    x2c = np.column_stack([code, centred, code[:, None] * centred])
    b1, se1, rss1, _, _ = direct_ols(np.column_stack([code, centred]), y)
    b2, se2, rss2, _, _ = direct_ols(x2c, y)
    table = {r.term: r for r in ols.with_holm(ols.coefficients(fits, "step1")).collect()}
    assert table["pc1"].estimate == pytest.approx(b1[2], rel=1e-6)
    assert table["group1"].std_error == pytest.approx(se1[1], rel=1e-6)
    assert table["pc2"].ci_t_high - table["pc2"].estimate == pytest.approx(
        D.t_quantiles(0.975, np.array([67.0]))[0] * se1[3], rel=1e-6
    )
    assert table["pc1"].beta == pytest.approx(b1[2] * pcs[:, 0].std(ddof=1) / y.std(ddof=1), rel=1e-6)
    assert (table["group1"].std_kind, table["group1"].beta) == ("raw", table["group1"].estimate)
    assert table["(Intercept)"].beta is None
    ps = [table[t].p_value for t in ("(Intercept)", "group1", "pc1", "pc2")]
    assert [table[t].p_adj for t in ("(Intercept)", "group1", "pc1", "pc2")] == pytest.approx(list(holm_direct(np.array(ps))))
    test = ols.compare(fits, "step1", "step2").first()
    assert (test.df_diff, test.df_resid) == (2, 65)
    assert test.f_value == pytest.approx(((rss1 - rss2) / 2) / (rss2 / 65), rel=1e-5)
    stats = ols.fit_stats(fits, "step2").first()
    tss = ((y - y.mean()) ** 2).sum()
    assert stats.adj_r_squared == pytest.approx(1 - (rss2 / 65) / (tss / 70), rel=1e-6)
    slopes = ols.simple_slopes(fits, "step2", models["step2"], "pc1", "group1", at={"ds": -0.5, "ts": 0.5}).collect()
    for row, keep in zip(slopes, (code < 0, code > 0), strict=True):
        alone = direct_ols(centred[keep], y[keep])[0]
        assert row.slope == pytest.approx(alone[1], rel=1e-6)
    spread_ = ols.simple_slopes(fits, "step2", models["step2"], "pc1", "group1").collect()
    assert [r["at"] for r in spread_] == pytest.approx([code.mean() - code.std(ddof=1), code.mean() + code.std(ddof=1)])


def test_leave_one_out_equals_refitting(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    y = x @ [0.5, -0.3] + rng.normal(size=30)
    errors = []
    for i in range(30):
        keep = np.arange(30) != i
        b = direct_ols(x[keep], y[keep])[0]
        errors.append((y[i] - b[0] - x[i] @ b[1:]) ** 2)
    df = spark.createDataFrame([("g", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "g string, a double, b double, y double")
    terms = [ols.Term.numeric("a"), ols.Term.numeric("b")]
    for keys, hot, limit in ((["g"], 10, -1), (["g"], 10, 1 << 25), ([], 1000, 1 << 25)):
        monkeypatch.setattr(linking, "BROADCAST_BYTES", limit)
        got = ols.leave_one_out(df, "y", terms, keys, hot_rows=hot).first()
        assert (got.n, got.loo_mse) == (30, pytest.approx(np.mean(errors)))


def test_aliased_terms_and_short_groups(spark):
    """An aliased term is missing, the others are those of the model without it; a short group has no fit."""
    rows = [("short", 1.0, 2.0, 1.0), ("short", 2.0, 1.0, 3.0)] + [("flat", float(i), 2.0 * i, float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    a, b = ols.Term.numeric("a"), ols.Term.numeric("b")
    fits = ols.fit_models(df, "y", {"m": [a, b], "one": [a], "turned": [b, a]}, ["g"])
    table = {(r.g, r.model, r.term): r for r in ols.coefficients(fits, ["m", "one", "turned"], ["g"], holm=True).collect()}
    assert len(table) == 16
    for term in ("(Intercept)", "a"):
        for name in ("estimate", "std_error", "df", "statistic", "p_value", "ci_t_low"):
            assert getattr(table["flat", "m", term], name) == pytest.approx(getattr(table["flat", "one", term], name))
    gone = table["flat", "m", "b"]
    assert (gone.estimate, gone.std_error, gone.p_value, gone.p_adj) == (None, None, None, None)
    assert table["flat", "turned", "a"].estimate is None and table["flat", "turned", "b"].estimate is not None
    assert {table["short", "m", t].estimate for t in ("(Intercept)", "a", "b")} == {None}
    stats = {r.g: r for r in ols.fit_stats(fits, "m", ["g"]).collect()}
    assert stats["short"].p_value is None and (stats["flat"].df_model, stats["flat"].df_resid) == (1, 7)
    loo = {r.g: r.loo_mse for r in ols.leave_one_out(df, "y", [a, b], ["g"]).collect()}
    alone = {r.g: r.loo_mse for r in ols.leave_one_out(df.filter("g = 'flat'"), "y", [a], ["g"]).collect()}
    assert loo["short"] is None and loo["flat"] == pytest.approx(alone["flat"])
