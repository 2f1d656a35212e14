"""Pivots, unions, joins: key checks, missing cells, and hot keys."""


import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialstats.operators import linking, reshape
from trialstats.operators.adjust import lag_difference


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LONG = [(1, "pre", 1), (1, "post", 0), (2, "pre", 1)]


def test_pivot_fills_absent_cells_with_missing(spark):
    df = spark.createDataFrame(LONG, "s int, time string, v int")
    assert values(reshape.pivot_wider(df, ["s"], "time", "v", ["pre", "post"])) == [(1, 1, 0), (2, 1, None)]


def test_pivot_of_duplicate_keys_is_an_error_unless_ordered(spark):
    df = spark.createDataFrame([(1, "pre", 5, 2), (1, "pre", 7, 1)], "s int, time string, v int, o int")
    with pytest.raises(PySparkException, match="duplicate rows for pre"):
        reshape.pivot_wider(df, ["s"], "time", "v", ["pre"]).collect()
    assert values(reshape.pivot_wider(df, ["s"], "time", "v", ["pre"], order_by="o")) == [(1, 7)]


def test_pivot_names(spark):
    df = spark.createDataFrame([(1, "val", "b", 2.0), (1, "aro", "nt", 3.0)], "s int, d string, c string, v double")
    out = reshape.pivot_wider(df, ["s"], ["d", "c"], "v", [("val", "b"), ("aro", "nt")], prefix="diff_")
    assert out.columns == ["s", "diff_val_b", "diff_aro_nt"]
    assert values(out) == [(1, 2.0, 3.0)]
    assert reshape.spread(df, ["s"], "d", "v", ["val", "aro"]).columns == ["s", "aro", "val"]


def test_longer_keeps_missing_values_and_splits_names(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "s int, pre_mean double, post_sd double")
    assert values(reshape.pivot_longer(df, ["s"], ["pre_mean", "post_sd"])) == [(1, "post_sd", None), (1, "pre_mean", 2.0)]
    got = reshape.pivot_longer_split(df, ["s"], ["pre_mean", "post_sd"], ["time", "stat"])
    assert values(got) == [(1, "post", "sd", None), (1, "pre", "mean", 2.0)]


def test_separate_splits_in_place(spark):
    df = spark.createDataFrame([(1, "pre-recog", 9), (2, "post", 8)], "a int, phase string, z int")
    out = reshape.separate(df, "phase", ["time", "task"])
    assert out.columns == ["a", "time", "task", "z"]
    assert values(out) == [(1, "pre", "recog", 9), (2, "post", None, 8)]


def test_complete_fills_zero_and_leaves_out_levels_that_never_occur(spark):
    df = spark.createDataFrame([(1, False), (1, True), (2, False), (2, False)], "s int, skipped boolean")
    want = [(1, False, 1), (1, True, 1), (2, False, 2), (2, True, 0)]
    assert values(reshape.complete_counts(df, ["s"], "skipped", [False, True])) == want
    assert values(reshape.complete_counts(df, ["s"], "skipped")) == want
    with pytest.raises(PySparkException, match="not listed"):
        reshape.complete_counts(df, ["s"], "skipped", [False]).collect()
    assert values(reshape.complete_counts(df, ["s"], "skipped", [False], other="drop")) == [(1, False, 1), (2, False, 2)]
    never = reshape.complete_counts(df.filter("not skipped"), ["s"], "skipped", [False, True])
    assert values(never) == [(1, False, 1), (2, False, 2)]


def test_lookup_keys_must_be_unique(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 7, 1)], "k int, v int, o int")
    with pytest.raises(PySparkException, match="not unique"):
        linking.unique_lookup(df, ["k"], ["v"]).collect()
    assert values(linking.unique_lookup(df, ["k"], ["v"], "o")) == [(1, 7)]
    assert values(linking.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert tuple(linking.key_uniqueness(df, ["k"]).first()) == (1, 2, 1, 2)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("key_type", ["int", "bigint"])
def test_lookup_join_and_missing_keys(spark, how, key_type):
    rows = [(i, 1 if i % 3 == 0 else i % 20) for i in range(600)] + [(1000, None), (1001, None)]
    left = spark.createDataFrame(rows, "id int, k int")
    lookup = spark.createDataFrame([*((k, f"v{k}") for k in range(15)), (None, "none")], f"k {key_type}, v string")
    never = linking.lookup_join(left, lookup, ["k"], how, na_matches="never")
    assert never.columns == ["id", "k", "v"]
    assert values(never) == values(left.join(lookup, "k", how).select("id", "k", "v"))
    both = linking.lookup_join(left, lookup, ["k"], how)
    assert values(both.filter("k is not null")) == values(never.filter("k is not null"))
    assert values(both.filter("k is null")) == [(1000, None, "none"), (1001, None, "none")]


def test_lookup_without_keys_has_one_row(spark):
    left, lookup = spark.range(3), spark.createDataFrame([("a",), ("b",)], "v string")
    assert values(linking.lookup_join(left, lookup.limit(1), [])) == [(0, "a"), (1, "a"), (2, "a")]
    with pytest.raises(PySparkException, match="has one row"):
        linking.lookup_join(left, lookup, []).collect()


def test_tied_lookup_rows_are_not_mixed(spark):
    df = spark.createDataFrame([(1, 0, "b", 1), (1, 0, "a", 2)], "k int, o int, x string, y int")
    assert values(linking.unique_lookup(df, ["k"], ["x", "y"], "o")) == [(1, "a", 2)]


def test_hot_bucket_is_split_by_its_share(spark):
    left = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    bucket = left.select(linking.key_bucket(["k"]).alias("b")).groupBy("b").count()
    top = bucket.orderBy(F.desc("count")).first()
    assert values(linking.bucket_splits(left, ["k"], hot_rows=100)) == [(top.b, -(-top["count"] // 100))]
    assert values(linking.bucket_splits(left, ["k"])) == []
    counted = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert values(linking.bucket_splits(counted, ["k"], 100, "n")) == [(top.b, -(-top["count"] // 100))]


@pytest.mark.parametrize("limit", [linking.BROADCAST_BYTES, -1])
def test_group_join_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(linking, "BROADCAST_BYTES", limit)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = linking.group_join(rows, table, ["k"], "n", hot_rows=10)
    tops = {r.k: r.top for r in table.collect()}
    assert got.columns == ["k", "id", "top"]
    assert {r.id: r.top for r in got.collect()} == {r.id: tops[r.k] for r in rows.collect()}


def test_equal_rows_of_a_hot_key_are_spread(spark, monkeypatch):
    """The tasks behind the join's exchange get even shares, though all rows are alike."""
    monkeypatch.setattr(linking, "BROADCAST_BYTES", -1)
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(7).alias("v"))
    joined = linking.group_join(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")), ["k"], "n", hot_rows=100)
    assert "_salt" in joined._jdf.queryExecution().toString()
    parts = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(200)).alias("part")).groupBy("part").count()
    sizes = [r["count"] for r in parts.collect()]
    assert len(sizes) == 200 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert joined.filter("m = 7").count() == 20_000


def test_inherit_takes_the_condition_of_the_other_row(spark):
    rows = [(1, 10, "sub", "post", 1), (1, 10, "nt", "pre", 0), (1, 11, "sub", "post", 0)]
    df = spark.createDataFrame(rows, "s int, i int, cond string, time string, ok int")
    got = linking.inherit_column(
        df, ["s", "i"], F.col("cond") == "sub", F.col("cond") != "sub", {"of": "cond", "passed": "ok"}
    )
    assert values(got.select("s", "i", "of", "passed")) == [(1, 10, "nt", 0), (1, 11, None, None)]


def test_pairing_by_key_needs_every_key_on_both_sides(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "s int, x int")
    b = spark.createDataFrame([(2, 5), (1, 4)], "s int, y int")
    assert values(linking.pair_by_key(a, b, ["s"])) == [(1, 2, 4), (2, 3, 5)]
    short = b.filter("s = 1")
    with pytest.raises(PySparkException, match="one side only"):
        linking.pair_by_key(a, short, ["s"]).collect()
    assert values(linking.pair_by_key(a, short, ["s"], "drop")) == [(1, 2, 4)]


def test_right_join_keeps_terms_of_the_larger_model(spark):
    a = spark.createDataFrame([("x", 1.0)], "term string, estimate double")
    b = spark.createDataFrame([("x", 2.0), ("x:y", 3.0)], "term string, estimate double")
    out = linking.join_suffixed(a, b, ["term"], "right")
    assert out.columns == ["term", "estimate_x", "estimate_y"]
    assert values(out) == [("x", 1.0, 2.0), ("x:y", None, 3.0)]


def test_bind_tags_sources_and_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "s int, x int")
    b = spark.createDataFrame([(3, 4)], "y int, s int")
    assert linking.bind_tagged({"ds": a, "ts": b}, "expt").columns == ["s", "x", "expt", "y"]
    assert values(linking.bind_tagged({"ds": a, "ts": b}, "expt")) == [(1, 2, "ds", None), (4, None, "ts", 3)]


def test_lag_difference_follows_the_named_order(spark):
    df = spark.createDataFrame([("v", 2, 0.5), ("v", 1, 0.2), ("a", 1, 0.1)], "d string, step int, r double")
    got = {(r.d, r.step): r["diff"] for r in lag_difference(df, "r", "step", ["d"]).collect()}
    assert got == {("v", 1): None, ("v", 2): pytest.approx(0.3), ("a", 1): None}


def test_complete_with_many_levels_in_blocks(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).alias("s"), F.when(F.col("id") > 0, F.col("id")).alias("level"))
    whole = rows.groupBy("s", "level").count()
    for block, size in ((4096, 32 << 20), (100, 32 << 20), (100, 0)):  # one block; several, broadcast or not
        monkeypatch.setattr(reshape, "LEVEL_BLOCK", block)
        monkeypatch.setattr(reshape, "LEVEL_BYTES", size)
        out = reshape.complete_counts(rows, ["s"], "level")
        assert out.count() == 9000 == out.select("s", "level").distinct().count()
        assert out.filter("n > 0").exceptAll(whole).count() == 0
        assert out.agg(F.sum("n")).first()[0] == 3000
        assert out.filter("level IS NULL").count() == 3
    assert reshape.complete_counts(rows.limit(0), ["s"], "level").count() == 0


def test_a_missing_key_is_a_key_in_every_join(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a'), (NULL, 'b') AS t(k, v)")
    right = spark.sql("SELECT * FROM VALUES (1, 'c'), (NULL, 'd') AS t(k, w)")
    assert values(linking.pair_by_key(left, right, ["k"])) == [(1, "a", "c"), (None, "b", "d")]
    assert values(linking.pair_by_key(left, right, ["k"], "drop")) == [(1, "a", "c"), (None, "b", "d")]
    assert values(linking.join_all(left, [right.filter("k IS NULL")], ["k"])) == [(1, "a", None), (None, "b", "d")]
    same = right.withColumnRenamed("w", "v")
    assert values(linking.join_suffixed(left.filter("k = 1"), same, ["k"], "right")) == [(1, "a", "c"), (None, None, "d")]
    with pytest.raises(PySparkException):
        linking.pair_by_key(left, right.filter("k = 1"), ["k"]).collect()
