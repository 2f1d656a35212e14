import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.operators import ols, states

VALUES = {"a": "a", "b": "b", "y": "y"}


def _log(spark, seed=1, n=3000):
    draw = np.random.default_rng(seed)
    data = pd.DataFrame({"k": draw.integers(0, 7, n).astype(float), "a": draw.normal(1e6, 1, n), "b": draw.normal(size=n), "part": draw.integers(0, 3, n)})
    data["y"] = 2 * (data.a - 1e6) - data.b + draw.normal(size=n)
    data.loc[::50, "b"] = np.nan
    data.loc[:4, "k"] = 99.0  # a key of one batch
    data.loc[:4, "part"] = 2
    rows = spark.createDataFrame(data)
    return rows.withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).withColumn("k", F.when(F.col("k") != 3, F.col("k")))


def _same(left, right):
    a, b = (x.toPandas().sort_values("k", na_position="first").reset_index(drop=True) for x in (left, right))
    assert a.n.tolist() == b.n.tolist() and len(a) > 1
    for c in ("means", "products"):
        assert np.allclose(np.stack(a[c]), np.stack(b[c]), rtol=1e-9, atol=1e-6)


def test_merged_batches_equal_one_pass_and_repeats_change_nothing(spark, tmp_path):
    log = _log(spark)
    table = states.StateTable(spark, str(tmp_path / "state"), ["k"], VALUES)
    assert table.state() is None
    for part in (0, 1, 2):
        assert table.add(log.filter(F.col("part") == part), part)
    whole = states.state_of(log, ["k"], VALUES)
    _same(table.state(), whole)
    assert not table.add(log.filter("part = 1"), 1)
    _same(table.state(), whole)
    assert sorted(r.batch for r in table.batches().collect()) == ["0", "1", "2"]
    table.tidy()
    _same(table.state(), whole)
    assert len(list((tmp_path / "state").iterdir())) == 1


def test_a_failed_batch_leaves_the_state(spark, tmp_path):
    log = _log(spark)
    table = states.StateTable(spark, str(tmp_path / "state"), ["k"], VALUES)
    table.add(log.filter("part = 0"), "first")
    broken = log.withColumn("a", F.when(F.col("part") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="broken"):
        table.add(broken, "second")
    _same(table.state(), states.state_of(log.filter("part = 0"), ["k"], VALUES))
    assert table.add(log.filter("part > 0"), "second")
    _same(table.state(), states.state_of(log, ["k"], VALUES))
    table.add(log.limit(0), "empty")
    _same(table.state(), states.state_of(log, ["k"], VALUES))


def test_a_stream_s_batches(spark, tmp_path):
    log = _log(spark)
    log.select("k", "a", "b", "y").repartition(4).write.parquet(str(tmp_path / "in"))
    table = states.StateTable(spark, str(tmp_path / "state"), ["k"], VALUES)
    source = spark.readStream.schema("k double, a double, b double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = source.writeStream.foreachBatch(table.add).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert table.batches().count() == 4
    _same(table.state(), states.state_of(log, ["k"], VALUES))


def test_fits_and_summaries_from_states(spark):
    log = _log(spark)
    terms = [ols.Term.numeric("b"), ols.Term.numeric("a")]
    state = states.merge(*(states.state_of(log.filter(c), ["k"], VALUES) for c in ("part = 0", "part > 0")), ["k"], 3)
    fits = ols.models_from_moments(states.moments(state, ["k"], [1, 0, 2]), {"m": terms}, ["k"])
    columns = ["k", "term", "estimate", "std_error", "df", "beta"]
    ours = ols.coefficients(fits, "m", ["k"]).select(*columns).toPandas().sort_values(["k", "term"], ignore_index=True)
    known = ols.coefficients(ols.fit_models(log, "y", {"m": terms}, ["k"]), "m", ["k"]).select(*columns).toPandas()
    known = known.sort_values(["k", "term"], ignore_index=True)
    slopes = ours.term != "(Intercept)"
    pd.testing.assert_frame_equal(ours[slopes], known[slopes], rtol=1e-4)
    out = states.summary(states.state_of(log, [], VALUES), [], list(VALUES)).first()
    complete = log.dropna(subset=["a", "b", "y"]).toPandas()
    assert out.n == len(complete)
    assert abs(out.b_sd - complete.b.std()) < 1e-9 and abs(out.y_mean - complete.y.mean()) < 1e-9


def test_without_keys_and_empty(spark):
    log = _log(spark)
    parts = [states.state_of(log.filter(F.col("part") == p), [], VALUES) for p in (0, 1, 2)]
    merged = states.merge(states.merge(parts[0], parts[1], [], 3), parts[2], [], 3).first()
    assert merged.n == states.state_of(log, [], VALUES).first().n
    assert states.state_of(log.limit(0), [], VALUES).count() == 0
    one = states.state_of(log.filter("b IS NOT NULL").limit(1), ["k"], VALUES).first()
    assert one.n == 1 and list(one.products) == [0.0] * 6
