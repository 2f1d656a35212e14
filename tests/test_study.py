"""Published study results, recomputed from its per-subject logs.

Set ``TRIALSTATS_STUDY_DIR`` to a folder that holds the logs (anywhere below it) to run these. Datasets are
found by their phases: the first design has ``stai1`` files, the second ``staiS``.
"""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trialstats.operators import ols, paired, pca
from trialstats.plans import analyses as A
from trialstats.operators.linking import bind_rows
from trialstats.operators.clean import rename_select
from trialstats.operators.summarise import demographics
from trialstats.sources.logs import first_design, second_design

ROOT = os.environ.get("TRIALSTATS_STUDY_DIR")
pytestmark = pytest.mark.skipif(not ROOT, reason="TRIALSTATS_STUDY_DIR is not set")
SCORES = ["bdi", "rrs", "stais", "stait"]


def find(phase):
    """Folder and dataset name of the logs of a phase (the folder with most of them)."""
    files = sorted(Path(ROOT).rglob(f"*_{phase}_*.csv"))
    folder = max({f.parent for f in files}, key=lambda d: sum(f.parent == d for f in files))
    name = re.match(rf"\d+_{phase}_(.+)\.csv", next(f.name for f in files if f.parent == folder))[1]
    return str(folder), name


def questionnaires(spark, data, phases):
    logs = []
    for source in phases:
        log = data.load(spark, source, drop=False)
        cond = F.col("cond") if "cond" in log.columns else F.lit(None).cast("string")
        logs.append(log.select(F.col("subjID").alias("subj"), F.lit(source).alias("ques"), cond.alias("cond"), "value"))
    return bind_rows(logs)


def scores(spark, data, state, trait):
    rules = {
        "bdi": A.Instrument("bdi"),
        "rrs": A.Instrument("rrs", only_key="b"),
        "stais": A.Instrument(state, reverse=True),
        "stait": A.Instrument(trait, reverse=True),
    }
    return A.instrument_scores(questionnaires(spark, data, ["bdi", "rrs", state, trait]), rules)


@pytest.fixture(scope="module")
def first(spark):
    return scores(spark, first_design(*find("stai1")), "stai1", "stai2").cache()


@pytest.fixture(scope="module")
def second_data():
    return second_design(*find("staiS"))


@pytest.fixture(scope="module")
def stored(spark):
    """The stored wide result of the first design, found by its header."""
    for path in sorted(Path(ROOT).rglob("*.csv")):
        if path.open().readline().startswith("subjID,diff_aro_b"):
            schema = "subj int, aro_b double, aro_nt double, val_b double, val_nt double, bdi int, rrs int, stais int, stait int"
            df = spark.read.schema(schema).option("header", True).csv(str(path))
            return df.withColumns({"aro": F.col("aro_b") - F.col("aro_nt"), "val": F.col("val_nt") - F.col("val_b")}).cache()
    pytest.skip("no stored result")


def test_scores_of_the_first_design_equal_the_stored_ones(first, stored):
    got = {r.subj: tuple(r[s] for s in SCORES) for r in first.collect()}
    assert got == {r.subj: tuple(r[s] for s in SCORES) for r in stored.collect()}
    assert len(got) == 30


def test_scores_and_demographics_of_the_second_design(spark, second_data):
    got = scores(spark, second_data, "staiS", "staiT")
    stats = got.agg(*[f(s) for s in SCORES for f in (F.avg, F.stddev_samp)], F.count(F.lit(1))).first()
    want = [11.1, 6.9993, 12.8333, 3.3742, 36.4, 8.5121, 41.2667, 8.7570, 30]
    assert list(stats) == pytest.approx(want, abs=5e-5)
    people = demographics(second_data.load(spark, "encoding", drop=False), "subjID", "gender", "age").first()
    assert (people.n, people.male, people.mean_age, people.sd_age) == (30, 23, 21.0, pytest.approx(1.8003831))


def test_forced_choice_recognition_of_the_second_design(spark, second_data):
    log = second_data.load_tagged(spark, {"pre-rating": "pre", "post-rating": "post"})
    log = rename_select(log, {"subj": "subjID", "item": "itemID", "cond": "TNTcond", "time": "time", "correct": "correct"})
    rates = A.hit_rate(log, A.RATED)
    stats = {r.cond: (r.m, r.s, r.n) for r in rates.groupBy("cond").agg(
        F.avg("hit_rate").alias("m"), F.stddev_samp("hit_rate").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    assert stats["b"] == (pytest.approx(0.9613454, abs=1e-7), pytest.approx(0.0844247, abs=1e-7), 27)
    assert stats["nt"][:2] == (pytest.approx(0.9085470, abs=1e-7), pytest.approx(0.1168624, abs=1e-7))
    assert stats["t"][:2] == (pytest.approx(0.9291179, abs=1e-7), pytest.approx(0.0816195, abs=1e-7))
    test = paired.with_effect_limits(A.paired_by_condition(rates, "hit_rate")).first()
    assert (test.t, test.df, test.p_value) == (pytest.approx(-2.1657556, abs=1e-6), 26, pytest.approx(0.0396851, abs=1e-7))
    assert (test.dz, test.dz_low, test.dz_high) == (
        pytest.approx(-0.4167999, abs=1e-7), pytest.approx(-0.8068097, abs=2e-7), pytest.approx(-0.0194496, abs=2e-7),
    )
    less = A.paired_by_condition(rates, "hit_rate", alternative="less")
    text = paired.paired_report(less).first()
    assert less.first().p_value == pytest.approx(0.0198425, abs=1e-7)
    assert text.report == "_t_(26) = -2.17, _p_ = .020, _dz_ = -0.42, 95% CI [-0.81, -0.02]"


@pytest.mark.parametrize(
    "x, y, want",
    [
        ("val_nt", "val_b", (-0.5958340, 0.5559083, -0.1087839, -0.4667785, 0.2510670)),
        ("aro_nt", "aro_b", (-1.9533994, 0.0604805, -0.3566403, -0.7230832, 0.0155613)),
    ],
)
def test_change_comparisons_of_the_first_design(stored, x, y, want):
    r = paired.with_effect_limits(paired.paired_t(stored, x, y)).first()
    assert r.df == 29
    assert (r.t, r.p_value, r.dz, r.dz_low, r.dz_high) == pytest.approx(want, abs=2e-7)


def test_components_of_the_first_design(stored):
    fit = pca.fit_pca(stored, SCORES)
    share = pca.importance(fit).orderBy("component").collect()
    assert [r.sdev for r in share] == pytest.approx([1.7305162, 0.7939702, 0.4626418, 0.4011080], abs=1e-7)
    assert [r.proportion for r in share] == pytest.approx([0.7486716, 0.1575972, 0.0535094, 0.0402219], abs=1e-7)
    load = {(r.component, r.variable): r.loading for r in pca.loadings(fit, SCORES).collect()}
    assert [load[1, s] for s in SCORES] == pytest.approx([0.5255679, 0.4410518, 0.4914825, 0.5363736], abs=1e-7)
    assert [load[2, s] for s in SCORES] == pytest.approx([-0.3135250, 0.7729467, -0.5289764, 0.1563310], abs=1e-7)


WANT = {
    "val": ([-0.0316371, -0.0845044, 0.0127874], [0.0475270, 0.0279336, 0.0608832], 0.1988044, 4.5979531, 0.0191209, 0.0741908),
    "aro": ([0.1675543, -0.1180586, 0.0954877], [0.0787548, 0.0462874, 0.1008868], 0.1570052, 3.7005798, 0.0379904, 0.2116958),
}


def test_component_regression_of_the_first_design(stored):
    fits = A.component_regression(stored, SCORES)
    table = {(r.vars, r.term): r for r in ols.coefficients(fits, "m", ["vars"]).collect()}
    stats = {r.vars: r for r in ols.fit_stats(fits, "m", ["vars"]).collect()}
    long = A.measures_long(A.with_components(stored, SCORES), ["pc1", "pc2"])
    left_out = {r.vars: r.loo_mse for r in ols.leave_one_out(long, "value", A.component_terms(), ["vars"]).collect()}
    for measure, (b, se, r2, f, p, loo) in WANT.items():
        terms = [ols.INTERCEPT, "pc1", "pc2"]
        assert [table[measure, t].estimate for t in terms] == pytest.approx(b, abs=1e-7)
        assert [table[measure, t].std_error for t in terms] == pytest.approx(se, abs=1e-7)
        s = stats[measure]
        assert (s.adj_r_squared, s.f_value, s.p_value) == pytest.approx((r2, f, p), abs=1e-6)
        assert (s.df_model, s.df_resid) == (2, 27)
        assert left_out[measure] == pytest.approx(loo, abs=1e-7)
