"""Facts bucketed by subject: summaries, pivots and lookups leave the rows where they are."""

import uuid

import pytest
from pyspark.sql import functions as F

from trialstats.functions.columns import strict_avg
from trialstats.operators.linking import lookup_join
from trialstats.operators.reshape import pivot_aggregate
from trialstats.plans import analyses as A
from trialstats.plans.queries import ORDER
from trialstats.sources.roles import trials
from trialstats.sources.tables import save_bucketed


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture()
def bucketed(spark, tmp_path):
    names = []

    def make(df, keys, buckets=4, **options):
        names.append(f"facts_{uuid.uuid4().hex}")
        even = save_bucketed(df, names[-1], keys, buckets, str(tmp_path / names[-1]), **options)
        return spark.table(names[-1]), even

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture()
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rates_and_pivot_by_subject(spark, sf_dir, bucketed):
    plain = trials(spark, sf_dir)
    facts, even = bucketed(plain, ["subj"])
    assert even
    for make in (
        lambda t: A.pre_post(t, A.PAIRED, order_by=ORDER),
        lambda t: A.hit_rate_wide(t, order_by=ORDER),
        lambda t: pivot_aggregate(t.filter(F.col("cond").isin(*A.PAIRED)), ["subj"], "cond", list(A.PAIRED), strict_avg, "correct"),
    ):
        assert exchanges(make(plain)) >= 1 and exchanges(make(facts)) == 0
        assert rows(make(facts)) == rows(make(plain))


def test_lookup_between_tables_of_the_same_buckets(spark, sf_dir, bucketed, unbroadcast):
    plain = trials(spark, sf_dir)
    ages = plain.groupBy("subj").agg(F.count("*").alias("seen"))
    facts, lookup = bucketed(plain, ["subj"])[0], bucketed(ages, ["subj"])[0]

    def rate(t, seen):
        return lookup_join(t, seen, ["subj"], na_matches="never").groupBy("subj", "seen").agg(F.sum("correct").alias("n"))

    assert exchanges(rate(facts, lookup)) == 0 and exchanges(rate(plain, ages)) >= 2
    assert rows(rate(facts, lookup)) == rows(rate(plain, ages))


def test_hot_missing_and_no_keys(spark, bucketed):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("x"))
    facts, even = bucketed(hot, ["k"], 64)
    assert not even and rows(facts) == rows(hot)
    few, even = bucketed(hot, ["k"], 2)
    assert even and few.filter("k IS NULL").count() == 1000 and rows(few) == rows(hot)
    none, even = bucketed(hot.limit(0), ["k"])
    assert even and none.collect() == []
