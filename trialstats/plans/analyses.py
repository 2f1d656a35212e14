"""The study's analyses as DataFrame pipelines over canonical columns.

Trial logs have ``subj, item, cond, time`` and, by phase, ``block, outcome, correct, val, aro``.
Questionnaire logs have ``subj, ques, item, cond, value``. ``order_by`` names the column that decides which
of several rows for one key counts; without it a second row is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.columns import (
    binarise,
    collapse_label,
    if_else,
    level_rank,
    ratio,
    recode,
    relabel,
    reverse_key,
    strict_avg,
    strict_sum,
)
from trialstats.functions.distributions import t_p_value
from trialstats.functions.digits import rounded
from trialstats.functions.text import format_p_cell
from trialstats.operators import ols, pca
from trialstats.operators.linking import bind_rows, join_all, pair_by_key, unique_lookup
from trialstats.operators.paired import paired_t
from trialstats.operators.reshape import (
    complete_counts,
    first_value,
    pivot_aggregate,
    pivot_longer,
    pivot_longer_split,
    pivot_wider,
    single_value,
)
from trialstats.operators.summarise import any_by, mean_se, robust_summary, two_level

TIMES = ("pre", "post")
MEASURES = ("val", "aro")
PAIRED = ("nt", "b")
RATED = ("b", "nt", "t")


@dataclass(frozen=True)
class Instrument:
    """How one questionnaire's items become a score."""

    source: str
    only_key: str | None = None
    reverse: bool = False


def instrument_scores(
    items: DataFrame, instruments: Mapping[str, Instrument], keys: Sequence[str] = ("subj",)
) -> DataFrame:
    """All scores of a subject side by side, columns in name order, from one aggregate."""
    cells = []
    for name in sorted(instruments):
        rule = instruments[name]
        where = F.col("ques") == rule.source
        if rule.only_key is not None:
            where = where & (F.col("cond") == rule.only_key)
        value = reverse_key("value", "cond") if rule.reverse else F.col("value")
        cells.append(strict_sum(value, where).cast("long").alias(name))
    return items.groupBy(*keys).agg(*cells)


def trial_outcomes(trials: DataFrame, pretest: DataFrame, by: Sequence[str], order_by: str | None) -> DataFrame:
    """Answered trials counted by ``by`` and pretest result: ``n`` and summed 0/1 outcomes ``hits``.

    Trials are counted per item before the join, so a hot subject or item reaches it as few rows.
    """
    keys = ["subj", "item"]
    rest = [c for c in by if c not in keys]
    counted = (
        trials.filter(F.col("outcome").isNotNull())
        .groupBy(*keys, *rest)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(binarise("outcome")).alias("hits"))
    )
    lookup = unique_lookup(pretest, keys, ["correct"], order_by)
    joined = counted.join(lookup, keys, "left")
    return joined.groupBy(*by, "correct").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def conditioned_rate(
    trials: DataFrame,
    pretest: DataFrame,
    by: Sequence[str] = ("subj", "block", "cond"),
    order_by: str | None = None,
) -> DataFrame:
    """Rate of non-zero outcomes per subject, block and condition, over items passed at the pretest."""
    counts = trial_outcomes(trials, pretest, by, order_by).filter(F.col("correct") == 1)
    return counts.select(*by, ratio("hits", "n").alias("rate"))


def first_last(
    trials: DataFrame, pretest: DataFrame, blocks: tuple[int, int] = (1, 10), cond: str = "nt", order_by: str | None = None
) -> DataFrame:
    """Rates of the first and the last block side by side: ``subj, block1, block10``."""
    wanted = trials.filter(F.col("block").isin(*blocks) & (F.col("cond") == cond))
    rates = conditioned_rate(wanted, pretest, order_by=order_by)
    return pivot_wider(rates, ["subj"], "block", "rate", blocks, prefix="block")


def pre_post(
    recog: DataFrame,
    conds: Sequence[str],
    value: str = "correct",
    order_by: str | None = None,
    seen_twice: bool = False,
) -> DataFrame:
    """Earlier and later result of every subject, condition and item, conditions chosen before the pivot.

    ``seen_twice`` keeps the items with a row at both times (a study that tests every item twice needs no
    such filter); a missing result in such a row stays missing.
    """
    keys = ["subj", "cond", "item"]
    cells = []
    for t in TIMES:
        at = F.col("time") == t
        cell = first_value(F.col(value), at, F.col(order_by)) if order_by else single_value(F.col(value), at, t)
        cells += [cell.alias(t), F.count(F.when(at, F.lit(1))).alias(f"_{t}_rows")]
    wide = recog.filter(F.col("cond").isin(*conds)).groupBy(*keys).agg(*cells)
    if seen_twice:
        wide = wide.filter((F.col("_pre_rows") > 0) & (F.col("_post_rows") > 0))
    return wide.select(*keys, *TIMES)


def hits_and_drops(
    recog: DataFrame,
    conds: Sequence[str] = PAIRED,
    value: str = "correct",
    order_by: str | None = None,
    seen_twice: bool = False,
) -> DataFrame:
    """Per subject and condition: hit rate over passed items, how many passed, how many were dropped."""
    pre = F.col("pre")
    return (
        pre_post(recog, conds, value, order_by, seen_twice)
        .groupBy("cond", "subj")
        .agg(
            strict_avg("post", pre == 1).alias("hit_rate"),
            F.count(F.when(pre == 1, F.lit(1))).alias("passed_n"),
            F.count(F.when(pre == 0, F.lit(1))).alias("dropped_n"),
        )
    )


def hit_rate(
    recog: DataFrame,
    conds: Sequence[str] = PAIRED,
    value: str = "correct",
    order_by: str | None = None,
    seen_twice: bool = False,
) -> DataFrame:
    """Later hit rate per condition and subject over the items passed earlier."""
    rates = hits_and_drops(recog, conds, value, order_by, seen_twice)
    return rates.filter(F.col("passed_n") > 0).select("cond", "subj", "hit_rate")


def hit_rate_wide(
    recog: DataFrame,
    conds: Sequence[str] = PAIRED,
    value: str = "correct",
    order_by: str | None = None,
    seen_twice: bool = False,
) -> DataFrame:
    """``hit_rate`` with one column per condition: rate and pivot are one aggregate by subject."""
    passed = pre_post(recog, conds, value, order_by, seen_twice).filter(F.col("pre") == 1)
    return pivot_aggregate(passed, ["subj"], "cond", conds, strict_avg, "post")


def dropped_items(recog: DataFrame, conds: Sequence[str] = PAIRED, order_by: str | None = None) -> DataFrame:
    """Mean and sd, per condition, of failed items per subject; subjects without any do not enter."""
    counts = hits_and_drops(recog, conds, order_by=order_by).filter(F.col("dropped_n") > 0)
    return counts.groupBy("cond").agg(F.avg("dropped_n").alias("mean"), F.stddev_samp("dropped_n").alias("sd"))


def substitute_hits(
    recog: DataFrame, sub: str = "sub", givers: Sequence[str] | None = None, order_by: str | None = None
) -> DataFrame:
    """Hit rate of substitutes by the condition of the item they stand for, if that item was passed earlier.

    Substitute rows and the row that names the condition share the key (subject, item), so one aggregate
    finds both sides and no self-join is needed.
    """
    is_sub = F.col("cond") == sub
    gives = (F.col("time") == "pre") & (F.col("cond").isin(*givers) if givers else ~is_sub)
    # a listed condition travels as its position, so that the aggregate holds numbers only
    cond = level_rank("cond", givers) if givers else F.col("cond")
    pick = lambda c: first_value(c, gives, F.col(order_by)) if order_by else single_value(c, gives, "giver")
    per_item = recog.groupBy("subj", "item").agg(
        pick(cond).alias("_cond"),
        pick(F.col("correct")).alias("_passed"),
        F.count(F.when(is_sub, F.lit(1))).alias("_rows"),
        F.count(F.when(is_sub, F.col("correct"))).alias("_known"),
        F.sum(F.when(is_sub, F.col("correct"))).alias("_hits"),
    )
    kept = per_item.filter((F.col("_rows") > 0) & (F.col("_passed") == 1))
    giver = F.element_at(F.array(*[F.lit(g) for g in givers]), F.col("_cond")) if givers else F.col("_cond")
    grouped = kept.groupBy(giver.alias("cond"), "subj").agg(
        F.sum("_rows").alias("_rows"), F.sum("_known").alias("_known"), F.sum("_hits").alias("_hits")
    )
    rate = F.when(F.col("_rows") == F.col("_known"), ratio("_hits", "_rows"))
    return grouped.select("cond", "subj", rate.alias("hit_rate"))


def paired_by_condition(
    rates: DataFrame, value: str, levels: tuple[str, str] = PAIRED, keys: Sequence[str] = (), alternative: str = "two.sided"
) -> DataFrame:
    """Paired test between two conditions of per-subject values, paired by subject."""
    wide = pivot_wider(rates.filter(F.col("cond").isin(*levels)), [*keys, "subj"], "cond", value, levels)
    return paired_t(wide, levels[0], levels[1], keys, alternative)


def skipped_counts(ratings: DataFrame, keys: Sequence[str] = ("subj",)) -> DataFrame:
    """Items with any missing rating and items with none, per subject, zeros filled in."""
    items = any_by(ratings, [*keys, "item"], F.col("val").isNull(), "skipped")
    return complete_counts(items, keys, "skipped", [False, True])


def skipped_summary(ratings: DataFrame) -> DataFrame:
    return robust_summary(skipped_counts(ratings), ["skipped"], "n")


def rating_pairs(
    ratings: DataFrame,
    pretest: DataFrame,
    conds: Sequence[str] = RATED,
    only_correct: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """Both ratings of every measure for items passed at the pretest: ``subj, cond, item, dim, pre, post``.

    ``only_correct`` also asks for a correct answer at each rating. Ratings and pretest are reduced to one
    row per subject, condition and item first; the join then reuses that partitioning.
    """
    keys = ["subj", "cond", "item"]
    rows = ratings.filter(F.col("cond").isin(*conds))
    if only_correct:
        rows = rows.filter(F.col("correct") == 1)
    cells = []
    for measure in MEASURES:
        for time in TIMES:
            where, value = F.col("time") == time, F.col(measure).cast("double")
            name = f"{measure}_{time}"
            cell = first_value(value, where, F.col(order_by)) if order_by else single_value(value, where, name)
            cells.append(cell.alias(name))
    wide = rows.groupBy(*keys).agg(*cells)
    passed = unique_lookup(pretest.filter(F.col("cond").isin(*conds)), keys, ["correct"], order_by)
    kept = wide.join(passed.filter(F.col("correct") == 1).select(*keys), keys, "inner")
    per_measure = F.array(
        *[
            F.struct(F.lit(m).alias("dim"), F.col(f"{m}_pre").alias("pre"), F.col(f"{m}_post").alias("post"))
            for m in MEASURES
        ]
    )
    return kept.select(*keys, F.inline(per_measure))


def rating_change(pairs: DataFrame) -> DataFrame:
    """Per subject, condition and measure: mean earlier and later rating and mean change, complete pairs only."""
    complete = pairs.dropna(how="any").withColumn("diff", F.col("post") - F.col("pre"))
    return complete.groupBy("subj", "cond", "dim").agg(*[F.avg(c).alias(c) for c in ("pre", "post", "diff")])


def change_tests(change: DataFrame, levels: tuple[str, str] = PAIRED) -> DataFrame:
    """Paired test of change between conditions, per measure, with its directed p-value.

    Valence is expected to be greater in the first condition, arousal to be less.
    """
    tests = paired_by_condition(change, "diff", levels, keys=["dim"])
    sign = if_else(F.col("dim") == "aro", -1.0, 1.0)
    return tests.withColumn("p_directed", t_p_value(F.col("t") * sign, "df", "greater"))


def individual_differences(scores: DataFrame, change: DataFrame, on_missing: str = "error") -> DataFrame:
    """Scores of each subject with the benefit of the not-thought items: ``aro = b - nt``, ``val = nt - b``."""

    def benefit(where_dim: str, plus: str, minus: str) -> Column:
        pick = lambda cond: single_value(
            F.col("diff"), (F.col("dim") == where_dim) & (F.col("cond") == cond), f"{where_dim} {cond}"
        )
        return (pick(plus) - pick(minus)).alias(where_dim)

    outcomes = change.groupBy("subj").agg(benefit("aro", "b", "nt"), benefit("val", "nt", "b"))
    return pair_by_key(scores, outcomes, ["subj"], on_missing)


def wide_export(
    change: DataFrame, scores: DataFrame, conds: Sequence[str] = ("b", "nt", "t"), other: str = "error"
) -> DataFrame:
    """One row per subject: change by measure and condition, then scores. ``conds`` lists all of them, unless others drop."""
    levels = [(dim, cond) for dim in sorted(MEASURES) for cond in conds]
    wide = pivot_wider(change, ["subj"], ["dim", "cond"], "diff", levels, prefix="diff_", other=other)
    return wide.join(scores, "subj", "left")


def recognition_table(
    recog: DataFrame, conds: Sequence[str] = ("t", "nt", "b", "new"), digits: int = 2, other: str = "error"
) -> DataFrame:
    """Mean and sd over subjects of the correct rate, by time (rows) and condition (columns), new items as one.

    Fillers stay out. The second design has substitute items as well: ``conds`` then names ``sub`` too.
    """
    rows = recog.withColumn("cond", collapse_label("cond", "new", "new")).filter(F.col("cond") != "filler")
    stats = two_level(rows, ["time", "cond"], ["subj"], ["correct"])
    stats = stats.withColumnsRenamed({"correct_mean": "mean", "correct_sd": "sd"})
    long = pivot_longer(stats, ["time", "cond"], ["mean", "sd"], "index")
    wide = pivot_wider(long, ["time", "index"], "cond", "value", conds, other=other)
    return wide.select("time", "index", *[rounded(c, digits).alias(c) for c in conds])


def rating_table(pairs: DataFrame, conds: Sequence[str] = RATED) -> DataFrame:
    """Mean and sd over subjects of the ratings: one row per time and statistic, one column per measure and condition."""
    stats = two_level(pairs.dropna(how="any"), ["cond", "dim"], ["subj"], TIMES)
    cells = [f"{time}_{stat}" for time in TIMES for stat in ("mean", "sd")]
    long = pivot_longer_split(stats, ["cond", "dim"], cells, ["time", "stat"])
    return pivot_wider(long, ["time", "stat"], ["dim", "cond"], "value", [(m, c) for m in MEASURES for c in conds])


def symptom_links(scores: DataFrame, hits: DataFrame, rates: DataFrame, recall: DataFrame | None = None) -> DataFrame:
    """Scores of each subject with item recognition (b - nt), mean rate and, if given, cued recognition (b - nt).

    ``hits`` and ``recall`` have one column per condition.
    """

    def loss(table: DataFrame, name: str) -> DataFrame:
        return table.select("subj", (F.col("b") - F.col("nt")).alias(name))

    mean_rate = rates.filter(F.col("cond") == "nt").groupBy("subj").agg(strict_avg("rate").alias("intrusion"))
    others = [loss(hits, "item_recog"), mean_rate]
    if recall is not None:
        others.append(loss(recall, "cued_recog"))
    return join_all(scores, others, ["subj"])


def outcome_curve(outcomes: Mapping[str, DataFrame], cond: str = "nt") -> DataFrame:
    """Mean and standard error of the rate by block, pretest result and dataset, for one condition.

    ``outcomes`` maps dataset to its ``trial_outcomes`` by subject, block and condition.
    """
    rows = bind_rows([df.withColumn("expt", F.lit(name)) for name, df in outcomes.items()])
    return curve_points(rows.filter(F.col("cond") == cond))


def curve_points(rows: DataFrame) -> DataFrame:
    status = relabel(F.col("correct").cast("string"), ["1", "0"], ["Recognized", "Non-Recognized"])
    rates = rows.withColumn("status", status).withColumn("rate", ratio("hits", "n"))
    return mean_se(rates, ["expt", "block", "status"], "rate")


def block_curve(rates: DataFrame) -> DataFrame:
    """Mean and standard error of the rate by block and condition, think items first."""
    points = mean_se(rates, ["block", "cond"], "rate")
    return points.withColumn("cond_order", level_rank("cond", ["t", "nt", "b", "filler"]))


def condition_means(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and standard error by condition, with display labels."""
    shown = values.withColumn("cond", if_else(F.col("cond") == "b", F.lit("Baseline"), F.lit("No-Think")))
    return mean_se(shown, [*keys, "cond"], value)


# Regression on components ------------------------------------------------------------------------


def with_components(
    subjects: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), components: int = 2
) -> DataFrame:
    """Add the first component scores of standardised columns."""
    fit = pca.fit_pca(subjects, columns, keys)
    return pca.scores(subjects, fit, columns, keys, components)


def measures_long(subjects: DataFrame, others: Sequence[str]) -> DataFrame:
    """One row per subject and measure (``vars``, ``value``), other columns repeated."""
    return subjects.withColumns({m: F.col(m).cast("double") for m in MEASURES}).unpivot(
        list(others), list(MEASURES), "vars", "value"
    )


def component_terms() -> list[ols.Term]:
    return [ols.Term.numeric("pc1"), ols.Term.numeric("pc2")]


def component_regression(subjects: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fits of change on two components, per group and measure (model ``m``)."""
    scored = with_components(subjects, columns, keys)
    long = measures_long(scored, [*keys, "pc1", "pc2"])
    return ols.fit_models(long, "value", {"m": component_terms()}, [*keys, "vars"])


def moderation_terms(levels: tuple[str, str] = ("ds", "ts")) -> dict[str, list[ols.Term]]:
    """Main effects of dataset and components, then with dataset by component interactions."""
    group = ols.Term.contrast("group1", "expt", levels)
    pc1, pc2 = component_terms()
    step1 = [group, pc1, pc2]
    return {"step1": step1, "step2": [*step1, group.interact(pc1), group.interact(pc2)]}


def moderated_regression(subjects: DataFrame, columns: Sequence[str], levels: tuple[str, str] = ("ds", "ts")) -> DataFrame:
    """Both steps for every measure, over components of all datasets together."""
    scored = with_components(subjects, columns)
    return moderated_fits(scored, levels)


def moderated_fits(scored: DataFrame, levels: tuple[str, str] = ("ds", "ts")) -> DataFrame:
    long = measures_long(scored, ["expt", "pc1", "pc2"])
    return ols.fit_models(long, "value", moderation_terms(levels), ["vars"])


def step_tables(fits: DataFrame, keys: Sequence[str] = ("vars",)) -> DataFrame:
    """Coefficient tables of both steps side by side; every term of the second step is kept."""
    return ols.side_by_side(ols.report_table(fits, ["step1", "step2"], keys), "step1", "step2", keys)


def model_compare_table(fits: DataFrame, keys: Sequence[str] = ("vars",), as_text: bool = True) -> DataFrame:
    """The step table turned to one row per measure and kind (``adj``, ``diff``), r and p by step.

    The gain of the first step is missing; the p of the gain is shown at both steps.
    """
    keys = list(keys)
    long = pivot_longer_split(
        ols.step_stats(fits, ["step1", "step2"], keys), [*keys, "step"], ["r_adj", "p_adj", "r_diff", "p_diff"], ["type", "type2"]
    )
    wide = pivot_wider(
        long, [*keys, "type2"], ["type", "step"], "value", [(t, s) for t in ("r", "p") for s in (1, 2)]
    )
    if not as_text:
        return wide
    return wide.select(*keys, "type2", "r_1", "r_2", *[format_p_cell(c).alias(c) for c in ("p_1", "p_2")])


MEASURE_NAMES = {"1": "val", "2": "aro"}


def name_measure(position: Column) -> Column:
    """Position of a measure to its name."""
    return recode(position, MEASURE_NAMES)


def paired_levels(wide: DataFrame, alternative: str, levels: tuple[str, str] = PAIRED) -> DataFrame:
    return paired_t(wide, levels[0], levels[1], alternative=alternative)


def rate_wide(trials: DataFrame, value: str = "correct", conds: Sequence[str] = RATED) -> DataFrame:
    """Strict rate per subject, one column per condition."""
    return pivot_aggregate(trials, ["subj"], "cond", conds, strict_avg, value)
