import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.operators import formulas, ols
from trialstats.operators.formulas import Factor, expand, parse
from trialstats.plans import analyses as A


def _names(text, factors=None):
    return [t.name for t in parse(text, factors).terms]


def test_expansion():
    assert expand("a + b + a") == [("a",), ("b",)]
    assert expand("a * b * c") == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    assert expand("b:a + a") == [("a",), ("b", "a")]
    assert expand("(a + b):c + a") == [("a",), ("a", "c"), ("b", "c")]
    assert expand("a * b - a:b + 1") == [("a",), ("b",)]
    assert expand("(a + b) * c - c") == [("a",), ("b",), ("a", "c"), ("b", "c")]
    assert expand("a:a") == [("a",)]
    assert expand("`x 1` + y.2") == [("x 1",), ("y.2",)]
    assert expand("1") == []


@pytest.mark.parametrize("text", ["a ~", "~ a", "y ~ a +", "y ~ (a", "y ~ a)", "y ~ a b", "y ~ a - 1", "y ~ 2", "y ~ a ? b", "y + z ~ a", "y ~ y", "y"])
def test_bad_formulas(spark, text):
    with pytest.raises(ValueError):
        parse(text)


def test_marginality(spark):
    g = {"g": Factor(("a", "b", "c"))}
    assert _names("y ~ g * x", g) == ["gb", "gc", "x", "gb:x", "gc:x"]
    assert _names("y ~ g + g:x", g) == ["gb", "gc", "ga:x", "gb:x", "gc:x"]
    assert _names("y ~ x + g:x", g) == ["x", "x:gb", "x:gc"]
    two = {**g, "h": Factor(("u", "v"), "half")}
    # the margin of h is there, that of g isn't: g by contrasts, h in full
    assert _names("y ~ g + g:h", two) == ["gb", "gc", "ga:h1", "gb:h1", "gc:h1"]
    assert _names("y ~ g:h", two) == ["ga:hu", "gb:hu", "gc:hu", "ga:hv", "gb:hv", "gc:hv"]


def test_the_study_s_models_as_text(spark):
    levels = ("ds", "ts")
    factors = {"group": Factor(levels, "half", "expt")}
    texts = {"step1": "value ~ group + pc1 + pc2", "step2": "value ~ group + pc1 + pc2 + group:pc1 + group:pc2"}
    outcome, terms = formulas.models(texts, factors)
    draw = np.random.default_rng(3)
    n = 80
    data = pd.DataFrame({"expt": np.array(levels)[draw.integers(0, 2, n)], "pc1": draw.normal(size=n), "pc2": draw.normal(size=n)})
    data["value"] = data.pc1 * (data.expt == "ts") + draw.normal(size=n)
    rows = spark.createDataFrame(data)
    columns = ["model", "term", "estimate", "std_error", "beta", "std_kind"]
    ours = ols.coefficients(ols.fit_models(rows, outcome, terms), list(texts)).select(*columns).toPandas()
    known = ols.coefficients(ols.fit_models(rows, "value", A.moderation_terms(levels)), list(texts)).select(*columns).toPandas()
    pd.testing.assert_frame_equal(ours, known)


@pytest.mark.parametrize("coding", ["treatment", "sum", "half"])
def test_codings_against_least_squares(spark, coding):
    levels = ("a", "b", "c", "d")
    draw = np.random.default_rng(4)
    n = 200
    data = pd.DataFrame({"g": np.array([*levels, "other", None], object)[draw.integers(0, 6, n)], "x": draw.normal(size=n), "y": draw.normal(size=n)})
    model = parse("y ~ g * x", {"g": Factor(levels, coding)})
    out = ols.coefficients(ols.fit_models(spark.createDataFrame(data), model.outcome, {"m": model.terms}), "m").toPandas()
    known = data[data.g.isin(levels)]
    at = known.g.map(levels.index).to_numpy()
    contrasts = {
        "treatment": np.eye(4)[:, 1:],
        "sum": np.vstack([np.eye(3), -np.ones(3)]),
        "half": np.vstack([np.eye(3), -np.ones(3)]) / -2,
    }[coding]
    g, x = contrasts[at], known.x.to_numpy()[:, None]
    matrix = np.hstack([np.ones((len(known), 1)), g, x, g * x])
    expected = np.linalg.lstsq(matrix, known.y.to_numpy(), rcond=None)[0]
    assert np.allclose(out.estimate, expected)
    assert out.df.iloc[0] == len(known) - 8


def test_two_codings_of_one_name(spark):
    g = {"g": Factor(("a", "b", "c"), "sum")}
    formulas.models({"one": "y ~ g + x", "two": "y ~ g * x"}, g)
    clash = {"g": Factor((1, 2, 3), "sum")}  # full columns are named as the contrasts are
    with pytest.raises(ValueError):
        formulas.models({"one": "y ~ x + g:x", "two": "y ~ x:g"}, clash)
    with pytest.raises(ValueError):
        formulas.models({"one": "y ~ x", "two": "z ~ x"})


def test_backticked_column(spark):
    rows = spark.range(30).select(F.col("id").cast("double").alias("x 1"), (F.col("id") * 2 + 1).alias("y"))
    model = parse("y ~ `x 1`")
    out = ols.coefficients(ols.fit_models(rows, model.outcome, {"m": model.terms}), "m").collect()
    assert [round(r.estimate, 6) for r in out] == [1.0, 2.0]
