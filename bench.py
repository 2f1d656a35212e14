"""Time the headline queries. Prints one JSON line.

``--skew FOLDER`` writes a copy of the tables to FOLDER (which must not exist), SKEW_COPIES times the rows with a third of them
under one key, and times SKEWED there instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from trialstats.plans.queries import QUERIES  # noqa: E402
from trialstats.session import local_session  # noqa: E402

HEADLINE = [
    "score_spread",
    "conditioned_rate",
    "first_last_paired",
    "paired_t_long",
    "change_score",
    "paired_effect_size",
    "two_level_table",
    "robust_summary",
    "self_join_inherit",
    "substitute_hit_rate",
    "join_condition_on_pretest",
    "export_wide",
    "paired_t",
    "corr_matrix",
    "pair_regression",
    "holm_adjust",
    "pca_importance",
    "pca_scores",
    "ols_two_predictors",
    "ols_step2",
    "ols_model_compare",
    "simple_slopes",
    "loocv_press",
    "model_compare_table",
]
REPEATS = 3
SKEWED = ["join_condition_on_pretest", "self_join_inherit", "conditioned_rate", "loocv_press", "pca_regression", "holm_adjust", "robust_summary"]
SKEW_COPIES = 8
#: Per table the column of its subjects.
SUBJECTS = {"events": "user_id", "lineitem": "l_suppkey"}
TABLES = ["events", "lineitem", "orders", "customer", "labels"]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def skewed(spark, sf_dir: str, folder: str) -> str:
    """The tables at ``folder``: each row of a log SKEW_COPIES times, every third of them of one subject."""
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in SUBJECTS:
            subject = SUBJECTS[name]
            hot = F.pmod(F.xxhash64(*df.columns, "_copy"), F.lit(3)) == 0
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(SKEW_COPIES))))
            if name == "events":  # keys stay unique
                df = df.withColumn("event_id", F.col("event_id") * SKEW_COPIES + F.col("_copy"))
            df = df.withColumn(subject, F.when(hot, F.lit(1).cast("long")).otherwise(F.col(subject))).drop("_copy")
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    names = HEADLINE
    if sys.argv[1:2] == ["--skew"]:
        sf_dir, names = skewed(spark, sf_dir, sys.argv[2]), SKEWED
    run(spark, "score_spread", sf_dir)
    run(spark, "ols_two_predictors", sf_dir)
    times = {name: round(min(run(spark, name, sf_dir) for _ in range(REPEATS)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
