"""Composed analyses on small study-shaped logs, against direct computation in pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialstats.operators import ols
from trialstats.operators.linking import bind_rows
from trialstats.plans import analyses as A

CONDS = ["t", "nt", "b", "filler"]


@pytest.fixture(scope="module")
def study():
    """A complete study: every subject sees every item once per phase, with some answers missing."""
    rng = np.random.default_rng(42)
    recog, trials, ratings = [], [], []
    for subj in range(12):
        for item in range(16):
            cond = CONDS[item % 4]
            for time in ("pre", "post"):
                correct = None if rng.random() < 0.03 else int(rng.random() < 0.8)
                recog.append((subj, item, cond, time, correct))
                val = None if rng.random() < 0.05 else int(rng.integers(1, 10))
                aro = None if val is None else int(rng.integers(1, 10))
                ratings.append((subj, item, cond, time, val, aro, int(rng.random() < 0.9)))
            if cond in ("t", "nt"):
                for block in range(1, 11):
                    outcome = None if rng.random() < 0.05 else int(rng.integers(0, 3))
                    trials.append((subj, item, cond, block, outcome))
    return {
        "recog": pd.DataFrame(recog, columns=["subj", "item", "cond", "time", "correct"]).astype({"correct": "Int64"}),
        "trials": pd.DataFrame(trials, columns=["subj", "item", "cond", "block", "outcome"]).astype({"outcome": "Int64"}),
        "ratings": pd.DataFrame(ratings, columns=["subj", "item", "cond", "time", "val", "aro", "correct"]).astype(
            {"val": "Int64", "aro": "Int64"}
        ),
    }


def spark_frame(spark, pdf, ddl):
    rows = [tuple(None if v is pd.NA else (v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def logs(spark, study):
    return {
        "recog": spark_frame(spark, study["recog"], "subj int, item int, cond string, time string, correct int"),
        "trials": spark_frame(spark, study["trials"], "subj int, item int, cond string, block int, outcome int"),
        "ratings": spark_frame(
            spark, study["ratings"], "subj int, item int, cond string, time string, val int, aro int, correct int"
        ),
    }


def strict(values):
    values = list(values)
    return None if any(v is pd.NA or v is None for v in values) else float(np.mean(values))


def passed(study):
    pre = study["recog"].query("time == 'pre'")
    return {(r.subj, r.item) for r in pre.itertuples() if r.correct is not pd.NA and r.correct == 1}


def near(want):
    return {k: None if v is None else pytest.approx(v) for k, v in want.items()}


def test_conditioned_rate_and_first_last(logs, study):
    pre = logs["recog"].filter("time = 'pre'")
    got = {(r.subj, r.block, r.cond): r.rate for r in A.conditioned_rate(logs["trials"], pre).collect()}
    ok, groups = passed(study), {}
    for r in study["trials"].itertuples():
        if r.outcome is not pd.NA and (r.subj, r.item) in ok:
            groups.setdefault((r.subj, r.block, r.cond), []).append(int(r.outcome != 0))
    assert got == near({k: float(np.mean(v)) for k, v in groups.items()})
    wide = {r.subj: (r.block1, r.block10) for r in A.first_last(logs["trials"], pre).collect()}
    assert wide[3] == (pytest.approx(got[3, 1, "nt"]), pytest.approx(got[3, 10, "nt"]))


def test_a_repeated_pretest_row_is_an_error(logs):
    pre = logs["recog"].filter("time = 'pre'")
    with pytest.raises(PySparkException, match="not unique"):
        A.conditioned_rate(logs["trials"], pre.union(pre)).collect()


def hits(study):
    wide = study["recog"].pivot(index=["subj", "cond", "item"], columns="time", values="correct").reset_index()
    keep = wide[(wide["pre"].fillna(0) == 1) & wide["cond"].isin(["nt", "b"])]
    return {(c, s): strict(g["post"]) for (c, s), g in keep.groupby(["cond", "subj"])}


def test_hit_rate_long_wide_and_dropped(logs, study):
    want = hits(study)
    got = {(r.cond, r.subj): r.hit_rate for r in A.hit_rate(logs["recog"]).collect()}
    assert got == near(want)
    wide = {r.subj: (r.nt, r.b) for r in A.hit_rate_wide(logs["recog"]).collect()}
    assert wide == {s: (near(want).get(("nt", s)), near(want).get(("b", s))) for s in wide}
    pre = study["recog"].query("time == 'pre' and cond in ['nt', 'b']")
    counts = pre[pre["correct"].fillna(1) == 0].groupby(["cond", "subj"]).size()
    got = {r.cond: (r["mean"], r.sd) for r in A.dropped_items(logs["recog"]).collect()}
    assert got == {c: (pytest.approx(g.mean()), pytest.approx(g.std())) for c, g in counts.groupby(level=0)}


def test_paired_comparison_of_conditions(logs, study):
    want = hits(study)
    d = [want["nt", s] - want["b", s] for s in range(12) if None not in (want.get(("nt", s)), want.get(("b", s)))]
    r = A.paired_by_condition(A.hit_rate(logs["recog"]), "hit_rate").first()
    assert (r.n, r.t) == (len(d), pytest.approx(np.mean(d) / np.std(d, ddof=1) * math.sqrt(len(d))))


def test_substitutes_take_the_condition_of_their_item(spark, logs, study):
    sub = logs["recog"].filter("time = 'post' and cond in ('t', 'nt')").withColumn("cond", F.lit("sub"))
    got = {(r.cond, r.subj): r.hit_rate for r in A.substitute_hits(bind_rows([logs["recog"], sub])).collect()}
    ok, groups = passed(study), {}
    for r in study["recog"].query("time == 'post' and cond in ['t', 'nt']").itertuples():
        if (r.subj, r.item) in ok:
            groups.setdefault((r.cond, r.subj), []).append(r.correct)
    assert got == near({k: strict(v) for k, v in groups.items()})


def test_skipped_trials_are_completed_with_zero(logs, study):
    skipped = study["ratings"].groupby(["subj", "item"])["val"].apply(lambda v: bool(v.isna().any())).reset_index(name="skipped")
    counts = skipped.groupby(["subj", "skipped"]).size().unstack(fill_value=0)
    got = {r.skipped: r for r in A.skipped_summary(logs["ratings"]).collect()}
    for level in (False, True):
        n = counts[level]
        assert (got[level]["mean"], got[level].median) == (pytest.approx(n.mean()), n.median())
        assert got[level].sd == pytest.approx(n.std())
        assert got[level].mad == pytest.approx(1.4826 * (n - n.median()).abs().median())
        assert (got[level].min, got[level].max) == (n.min(), n.max())


def change(study, only_correct):
    ok, rows = passed(study), study["ratings"]
    rows = rows[rows["correct"] == 1] if only_correct else rows
    out = {}
    for dim in ("val", "aro"):
        wide = rows.pivot(index=["subj", "cond", "item"], columns="time", values=dim).dropna().reset_index()
        for r in wide.itertuples():
            if r.cond != "filler" and (r.subj, r.item) in ok:
                out.setdefault((r.subj, r.cond, dim), []).append(int(r.post) - int(r.pre))
    return {k: float(np.mean(v)) for k, v in out.items()}


@pytest.mark.parametrize("only_correct", [False, True])
def test_rating_change(logs, study, only_correct):
    pairs = A.rating_pairs(logs["ratings"], logs["recog"].filter("time = 'pre'"), only_correct=only_correct)
    got = {(r.subj, r.cond, r.dim): r["diff"] for r in A.rating_change(pairs).collect()}
    assert got == near(change(study, only_correct))


def subject_scores(spark):
    rows = [(s, s * 3 % 7, s * 5 % 11, s * 2 % 13, s * 4 % 5) for s in range(12)]
    return spark.createDataFrame(rows, "subj int, bdi int, rrs int, stais int, stait int")


def test_individual_differences_export_and_links(spark, logs, study):
    pre = logs["recog"].filter("time = 'pre'")
    moved = A.rating_change(A.rating_pairs(logs["ratings"], pre))
    want, scores = change(study, False), subject_scores(spark)
    table = {r.subj: r for r in A.individual_differences(scores, moved).collect()}
    assert table[4].aro == pytest.approx(want[4, "b", "aro"] - want[4, "nt", "aro"])
    assert table[4].val == pytest.approx(want[4, "nt", "val"] - want[4, "b", "val"])
    with pytest.raises(PySparkException, match="one side only"):
        A.individual_differences(scores.filter("subj <> 4"), moved).collect()
    wide = A.wide_export(moved, scores, ("b", "nt"), other="drop")
    assert wide.columns == ["subj", "diff_aro_b", "diff_aro_nt", "diff_val_b", "diff_val_nt", "bdi", "rrs", "stais", "stait"]
    assert {r.subj: r.diff_val_b for r in wide.collect()}[7] == pytest.approx(want[7, "b", "val"])
    assert {"diff_aro_t", "diff_val_t"} <= set(A.wide_export(moved, scores).columns)
    rates = A.conditioned_rate(logs["trials"], pre)
    recall = A.hit_rate_wide(logs["ratings"], A.RATED)
    links = A.symptom_links(scores, A.hit_rate_wide(logs["recog"]), rates, recall)
    assert links.columns[-3:] == ["item_recog", "intrusion", "cued_recog"]
    by_block = [r.rate for r in rates.filter("cond = 'nt' and subj = 2").collect()]
    assert {r.subj: r.intrusion for r in links.collect()}[2] == pytest.approx(np.mean(by_block))


def test_change_tests_point_valence_up_and_arousal_down(logs):
    moved = A.rating_change(A.rating_pairs(logs["ratings"], logs["recog"].filter("time = 'pre'")))
    for r in A.change_tests(moved).collect():
        half = r.p_value / 2
        expected = half if (r.t > 0) == (r.dim == "val") else 1 - half
        assert r.p_directed == pytest.approx(expected)


def test_recognition_table_shape_and_rounding(spark):
    rows = []
    for subj, (a, b) in enumerate([(1, 0), (1, 1), (0, 1)]):
        for time in ("pre", "post"):
            rows += [(subj, 0, "t", time, a), (subj, 1, "t", time, b), (subj, 2, f"{time}_new", time, a), (subj, 3, "filler", time, 0)]
    out = A.recognition_table(spark.createDataFrame(rows, "subj int, item int, cond string, time string, correct int"))
    assert out.columns == ["time", "index", "t", "nt", "b", "new"]
    got = {(r.time, r["index"]): (r.t, r.nt, r.new) for r in out.collect()}
    assert got["pre", "mean"] == (0.67, None, 0.67)
    assert got["post", "sd"] == (0.29, None, 0.58)


def test_outcome_curve_of_two_datasets(logs, study):
    pre = logs["recog"].filter("time = 'pre'")
    counts = A.trial_outcomes(logs["trials"], pre, ["subj", "block", "cond"], None)
    got = A.outcome_curve({"one": counts, "two": counts}).collect()
    assert {(r.expt, r.status) for r in got} >= {(e, s) for e in ("one", "two") for s in ("Recognized", "Non-Recognized")}
    ok, groups = passed(study), {}
    for r in study["trials"].query("cond == 'nt' and block == 1").itertuples():
        if r.outcome is not pd.NA and (r.subj, r.item) in ok:
            groups.setdefault(r.subj, []).append(int(r.outcome != 0))
    means = [np.mean(v) for v in groups.values()]
    point = next(r for r in got if (r.expt, r.block, r.status) == ("one", 1, "Recognized"))
    assert (point.n, point["mean"]) == (len(means), pytest.approx(np.mean(means)))
    assert point.high - point["mean"] == pytest.approx(np.std(means, ddof=1) / math.sqrt(len(means)))


def test_moderated_regression_end_to_end(spark):
    rng = np.random.default_rng(8)
    rows = [(s, "ds" if s < 30 else "ts", *map(float, rng.normal(size=4)), *map(float, rng.normal(size=2))) for s in range(65)]
    ddl = "subj int, expt string, bdi double, rrs double, stais double, stait double, val double, aro double"
    subjects = spark.createDataFrame(rows, ddl)
    fits = A.moderated_regression(subjects, ["bdi", "rrs", "stais", "stait"])
    terms = [r.term for r in ols.coefficients(fits, "step2", ["vars"]).filter("vars = 'val'").orderBy("term_index").collect()]
    assert terms == [ols.INTERCEPT, "group1", "pc1", "pc2", "group1:pc1", "group1:pc2"]
    numeric = {(r.vars, r.type2): r for r in A.model_compare_table(fits, as_text=False).collect()}
    gain, step1 = numeric["val", "diff"], numeric["val", "adj"]
    assert gain.r_1 is None and gain.r_2 == pytest.approx(step1.r_2 - step1.r_1)
    assert gain.p_1 == gain.p_2 == pytest.approx(ols.compare(fits, "step1", "step2", ["vars"]).filter("vars = 'val'").first().p_value)
    text = {(r.vars, r.type2): r.p_2 for r in A.model_compare_table(fits).collect()}
    assert text["aro", "adj"].startswith(".") or text["aro", "adj"] in ("< .001", "> .999")
    both = A.step_tables(fits)
    assert both.count() == 12
    assert both.filter("term = 'group1:pc1' and estimate_x is null and estimate_y is not null").count() == 2
