"""Registered queries: every operator over the plain test tables, whole tables only.

``events`` serves as the trial and item log, ``lineitem`` as the volume table (subject ``l_suppkey``, condition
``l_returnflag``, block ``l_linenumber``). Results are rounded to six places here, not in the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.functions.columns import (
    apply_all,
    binarise,
    collapse_label,
    level_rank,
    ratio,
    rebase_block,
    recode,
    relabel,
    reverse_key,
    strict_avg,
    strict_sd,
)
from trialstats.functions.digits import fixed
from trialstats.functions.digits import rounded as exactly
from trialstats.functions.distributions import f_p_value, t_cdf, t_p_value
from trialstats.functions.text import format_p, format_p_cell
from trialstats.operators import clean, formulas, linking, ols, paired, pca, reshape, selection, states, summarise
from trialstats.operators.adjust import holm_adjust, lag_difference
from trialstats.plans import analyses as A
from trialstats.sources.logs import EXCLUDED_2
from trialstats.sources.roles import items, phase, table, trials

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORDER = "event_id"
MEASURED = ["l_quantity", "l_extendedprice", "l_discount"]
INSTRUMENTS = {
    "bdi": A.Instrument("bdi"),
    "rrs": A.Instrument("rrs", only_key="n"),
    "stais": A.Instrument("stais", reverse=True),
    "stait": A.Instrument("stait", reverse=True),
}
COMPONENT_SCORES = ["bdi", "rrs", "stais"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return clean.map_columns_of_type(df, T.DoubleType, lambda c: F.round(c, digits))


def query(fn: Query) -> Query:
    """Register a query under its name (less a trailing underscore), with its doubles rounded."""
    QUERIES[fn.__name__.rstrip("_")] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


# Scans and projections ---------------------------------------------------------------------------


@query
def scan_trials(spark, sf):
    log = clean.exclude(table(spark, sf, "events"), "user_id", EXCLUDED_2)
    return clean.drop_columns(log, ["ts", "props"])


@query
def scan_tagged_union(spark, sf):
    return linking.bind_tagged(
        {
            "pre": phase(spark, sf, "pre").select("event_id", "subj", "item", "cond", "val", "correct"),
            "post": phase(spark, sf, "post").select("event_id", "subj", "item", "cond", "aro", "correct"),
        },
        "time",
    )


@query
def project_rename(spark, sf):
    columns = {"subj": "l_suppkey", "cond": "l_returnflag", "block": "l_linenumber", "value": "l_quantity"}
    return clean.rename_select(table(spark, sf, "lineitem"), columns)


@query
def drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"])


@query
def round_range(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    means = lines.agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return clean.map_columns(means, clean.column_range(means, "l_extendedprice", "l_tax"), lambda c: exactly(c, 2))


@query
def round_exact(spark, sf):
    """Amounts and eighths to two decimals, as text and as numbers: many are exact halves, many just beside one."""
    lines = table(spark, sf, "lineitem")
    amount, eighths = F.col("l_extendedprice") * F.col("l_discount") * 2.5, (F.col("l_quantity") - 25) / 8
    near = F.col("l_quantity") + F.col("l_discount") / 2
    cells = {"amount": amount, "eighths": eighths, "near": near}
    return lines.select(
        "l_orderkey", "l_linenumber", *[fixed(c, 2).alias(f"{n}_text") for n, c in cells.items()], *[exactly(c, 2).alias(n) for n, c in cells.items()]
    )


@query
def keep_unused(spark, sf):
    return clean.compute_consuming(_hits_wide(spark, sf), ["b", "nt"], item_recog=F.col("b") - F.col("nt"))


@query
def across_mean_sd(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_returnflag")
    return lines.agg(*apply_all({"mean": strict_avg, "sd": strict_sd}, MEASURED))


@query
def filter_compound(spark, sf):
    log = trials(spark, sf).select("event_id", "subj", "cond", "block", "outcome", "correct")
    return log.filter(
        F.col("block").isin(1, 10) & (F.col("cond") == "nt") & (F.col("outcome") > 0) & (F.col("correct") != 0)
    )


@query
def exclude_subjects(spark, sf):
    log = trials(spark, sf)
    unanswered = F.avg(F.col("outcome").isNull().cast("int"))
    excluded = log.groupBy("subj").agg(unanswered.alias("share")).filter(F.col("share") > 0.25).select("subj")
    return clean.exclude(log.select("event_id", "subj_raw", "cond"), "subj_raw", excluded)


@query
def missing_count(spark, sf):
    return summarise.missing_count(trials(spark, sf), ["subj", "block"], "outcome")


@query
def binarise_outcome(spark, sf):
    return trials(spark, sf).select("event_id", "outcome", binarise("outcome").alias("in_or_not"))


@query
def rebase_block_(spark, sf):
    log = trials(spark, sf).filter(F.col("block_raw") != "prac")
    return log.select("event_id", rebase_block("block_raw").alias("block"))


@query
def level_order(spark, sf):
    counts = summarise.count_by(trials(spark, sf), ["cond"])
    levels = ["t", "nt", "b", "filler"]
    labels = ["Think", "No-Think", "Baseline", "Filler"]
    return counts.select(
        "cond", "n", level_rank("cond", levels).alias("rank"), relabel("cond", levels, labels).alias("label")
    )


@query
def level_first_appearance(spark, sf):
    return summarise.levels_by_appearance(trials(spark, sf), "cond", ORDER)


@query
def outcome_counts(spark, sf):
    return summarise.count_by(trials(spark, sf), ["subj", "outcome"])


@query
def skipped_items(spark, sf):
    log = trials(spark, sf)
    items_ = summarise.any_by(log, ["subj", "cond", "item"], F.col("val").isNull(), "skipped")
    return summarise.count_by(items_, ["cond", "skipped"])


@query
def collapse_label_(spark, sf):
    return trials(spark, sf).select("event_id", collapse_label("cond", "new", "new").alias("cond"))


@query
def recode_label(spark, sf):
    position = F.col("l_linenumber").cast("string")
    lines = table(spark, sf, "lineitem").select(recode(position, A.MEASURE_NAMES).alias("dim"), "l_quantity")
    return lines.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def round_doubles(spark, sf):
    return clean.round_doubles(_substitutes(spark, sf).groupBy("cond").agg(*apply_all({"mean": F.avg, "sd": F.stddev_samp}, ["hit_rate"])))


# Reshape -----------------------------------------------------------------------------------------


@query
def pivot_pre_post(spark, sf):
    return A.pre_post(trials(spark, sf), A.RATED, order_by=ORDER)


@query
def pivot_prefix(spark, sf):
    return A.first_last(trials(spark, sf), phase(spark, sf, "pre"), order_by=ORDER)


@query
def pivot_two_names(spark, sf):
    levels = [(m, c) for m in A.MEASURES for c in A.RATED]
    return reshape.pivot_wider(_change(spark, sf), ["subj"], ["dim", "cond"], "diff", levels, prefix="diff_")


@query
def score_spread(spark, sf):
    return _scores(spark, sf)


@query
def unpivot_measures(spark, sf):
    log = trials(spark, sf).select("event_id", "val", F.col("aro").cast("double").alias("aro"))
    return reshape.pivot_longer(log, ["event_id"], ["val", "aro"], "dim")


@query
def unpivot_split(spark, sf):
    return A.rating_table(_pairs(spark, sf))


@query
def separate_phase(spark, sf):
    log = trials(spark, sf).select("event_id", F.concat_ws("-", "time", "cond").alias("phase"))
    return reshape.separate(log, "phase", ["time", "task"])


@query
def complete_counts(spark, sf):
    return A.skipped_counts(trials(spark, sf))


@query
def rate_wide(spark, sf):
    return A.rate_wide(trials(spark, sf))


# Joins -------------------------------------------------------------------------------------------


def _pretest(spark, sf, keys):
    lookup = linking.unique_lookup(phase(spark, sf, "pre"), keys, ["correct"], ORDER)
    return lookup.withColumnRenamed("correct", "correct_pre")


@query
def join_condition_on_pretest(spark, sf):
    keys = ["subj", "item"]
    log = trials(spark, sf).select("event_id", *keys, "cond", "outcome")
    return linking.lookup_join(log, _pretest(spark, sf, keys), keys)


@query
def join_three_keys(spark, sf):
    keys = ["subj", "cond", "item"]
    log = trials(spark, sf).select("event_id", *keys, "val", "aro")
    return linking.lookup_join(log, _pretest(spark, sf, keys), keys)


@query
def self_join_inherit(spark, sf):
    log = trials(spark, sf).select("event_id", "subj", "item", "cond", "time", "correct")
    gives = (F.col("time") == "pre") & F.col("cond").isin("t", "nt")
    values = {"cond_of": "cond", "copre": "correct"}
    return linking.inherit_column(log, ["subj", "item"], F.col("cond") == "filler", gives, values, ORDER)


@query
def join_chain_subject(spark, sf):
    return _links(spark, sf)


@query
def join_right_suffix(spark, sf):
    steps = ols.coefficients(_step_fits(spark, sf), ["step1", "step2"], ["l_returnflag"])
    steps = steps.select("l_returnflag", "model", "term", "estimate", "std_error")
    return ols.side_by_side(steps, "step1", "step2", ["l_returnflag"])


@query
def join_tables_right(spark, sf):
    lines = table(spark, sf, "lineitem")
    first = lines.filter(F.col("l_linenumber") == 1).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    every = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return linking.join_suffixed(first, every, ["l_suppkey"], "right")


@query
def indiv_diff_table(spark, sf):
    return A.individual_differences(_scores(spark, sf), _change(spark, sf), on_missing="drop")


@query
def key_uniqueness(spark, sf):
    return linking.key_uniqueness(trials(spark, sf), ["subj", "cond", "item", "time"])


@query
def union_experiments(spark, sf):
    log = items(spark, sf)
    halves = {e: A.instrument_scores(log.filter(F.col("expt") == e), INSTRUMENTS) for e in ("ds", "ts")}
    return linking.bind_tagged(halves, "expt")


@query
def export_wide(spark, sf):
    """The stored file's two conditions."""
    return A.wide_export(_change(spark, sf), _scores(spark, sf), ("b", "nt"), other="drop")


@query
def export_wide_all(spark, sf):
    return A.wide_export(_change(spark, sf), _scores(spark, sf))


# Aggregation -------------------------------------------------------------------------------------


@query
def rate_by_condition(spark, sf):
    return _hits(spark, sf)


@query
def rate_every_item(spark, sf):
    """As ``rate_by_condition``, but a passed item that wasn't tested again makes its subject's rate missing."""
    return A.hit_rate(trials(spark, sf), A.PAIRED, order_by=ORDER)


@query
def paired_t_every_item(spark, sf):
    """As ``paired_t_long`` on the rates of ``rate_every_item``: subjects with a missing rate drop out of the pairs."""
    rates = A.hit_rate(trials(spark, sf), A.PAIRED, order_by=ORDER)
    return paired.paired_t_long(rates, ["subj"], "cond", "hit_rate", A.PAIRED, alternative="less")


@query
def score_sum(spark, sf):
    return summarise.score(items(spark, sf), ["subj", "ques"])


@query
def score_reverse_keyed(spark, sf):
    log = items(spark, sf).withColumn("value", reverse_key("value", "cond"))
    return summarise.score(log, ["subj", "ques"])


@query
def score_subscale(spark, sf):
    log = items(spark, sf).filter((F.col("ques") == "rrs") & (F.col("cond") == "n"))
    return summarise.score(log, ["subj"], name="rrs")


@query
def demographics(spark, sf):
    log = trials(spark, sf).select(
        "subj", (F.col("subj") % 2).alias("gender"), (F.col("subj") % 13 + 18).alias("age")
    )
    return summarise.demographics(log, "subj", "gender", "age")


@query
def dropped_items(spark, sf):
    return A.dropped_items(trials(spark, sf), order_by=ORDER)


@query
def tally_by_flag(spark, sf):
    return summarise.tally_summary(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag"])


@query
def robust_summary(spark, sf):
    return A.skipped_summary(trials(spark, sf))


@query
def robust_prices(spark, sf):
    """Median and its deviation where nearly every value of a group is another."""
    return selection.robust_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query
def median_by_subject(spark, sf):
    return selection.medians(table(spark, sf, "lineitem"), ["l_suppkey", "l_linestatus"], F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query
def two_level_table(spark, sf):
    return A.recognition_table(trials(spark, sf))


def _outcomes(spark, sf):
    return A.trial_outcomes(trials(spark, sf), phase(spark, sf, "pre"), ["expt", "subj", "block", "cond"], ORDER)


@query
def mean_se_curve(spark, sf):
    return A.curve_points(_outcomes(spark, sf).filter(F.col("cond") == "nt"))


@query
def block_curve(spark, sf):
    return A.block_curve(_rates(spark, sf))


@query
def mean_se_condition(spark, sf):
    hits = A.condition_means(_hits(spark, sf), "hit_rate")
    pairs = _change(spark, sf).filter(F.col("cond").isin(*A.PAIRED))
    change = A.condition_means(pairs, "diff", ["dim"])
    return linking.bind_rows([hits.withColumn("dim", F.lit("hit_rate")), change])


@query
def mean_se_condition_all(spark, sf):
    """Every condition but the baseline counts as not thought."""
    return A.condition_means(_change(spark, sf), "diff", ["dim"])


@query
def corr_matrix(spark, sf):
    return summarise.correlations(table(spark, sf, "lineitem"), [*MEASURED, "l_tax"], ["l_returnflag"])


@query
def pair_regression(spark, sf):
    return summarise.pair_regressions(table(spark, sf, "lineitem"), [*MEASURED, "l_tax"], ["l_returnflag"])


WIDE_COLUMNS = {f"m{i}": text for i, text in enumerate([
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "nullif(l_quantity, 10) * (1 + l_tax)", "nullif(l_linenumber, 3)", "nullif(l_suppkey, 7)",
    *[f"l_{a} * l_{b}" for a, b in (("quantity", "discount"), ("quantity", "tax"), ("discount", "tax"), ("linenumber", "quantity"))],
    "CASE WHEN l_linenumber < 3 THEN l_extendedprice * (1 - l_discount) END", "CASE WHEN l_linenumber < 5 THEN l_extendedprice * (1 + l_tax) END",
    "CASE WHEN l_quantity > 20 THEN l_tax * l_linenumber END",
])}


def _wide(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in WIDE_COLUMNS.items()])


@query
def corr_wide(spark, sf):
    """Pairwise-complete correlations of a table too wide for one expression per pair."""
    return summarise.correlations(_wide(spark, sf), [*WIDE_COLUMNS], ["l_returnflag"])


@query
def pair_regression_wide(spark, sf):
    return summarise.pair_regressions(_wide(spark, sf), [*WIDE_COLUMNS], ["l_returnflag"])


@query
def symptom_correlations(spark, sf):
    return summarise.correlations(_links(spark, sf), [*INSTRUMENTS, "intrusion", "item_recog"]).drop("p_value", "t")


@query
def symptom_tests(spark, sf):
    return summarise.correlations(_links(spark, sf), [*INSTRUMENTS, "intrusion", "item_recog"])


@query
def pair_by_key_complete(spark, sf):
    """Both sides have every key, as the default asks."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey")
    left, right = lines.agg(F.count(F.lit(1)).alias("n")), lines.agg(F.max("l_quantity").alias("top"))
    return linking.pair_by_key(left, right, ["l_suppkey"])


@query
def leave_one_out_missing_group(spark, sf):
    """Rows without a group are a group: ``A`` is taken as missing."""
    lines = table(spark, sf, "lineitem").withColumn("grp", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    return ols.leave_one_out(lines, F.col("l_extendedprice") / 1000, _two_terms(), ["grp"])


@query
def holm_missing_family(spark, sf):
    tests = paired.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax", ["l_suppkey"])
    tests = tests.withColumn("family", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3))
    return holm_adjust(tests.select("l_suppkey", "family", "p_value"), "p_value", ["family"])


# Windows, text -----------------------------------------------------------------------------------


@query
def lag_diff(spark, sf):
    steps = _rates(spark, sf).groupBy("cond", "block").agg(F.avg("rate").alias("rate"))
    return lag_difference(steps, "rate", "block", ["cond"])


def _supplier_tests(spark, sf):
    columns = ["l_quantity", "l_discount", "l_tax"]
    return summarise.correlations(table(spark, sf, "lineitem"), columns, ["l_suppkey"])


@query
def holm_adjust_(spark, sf):
    tests = _supplier_tests(spark, sf).select("l_suppkey", "x", "y", "p_value")
    return holm_adjust(tests, "p_value", ["x", "y"])


@query
def format_p_(spark, sf):
    tests = _supplier_tests(spark, sf)
    return tests.select("l_suppkey", "x", "y", format_p("p_value").alias("text"), format_p_cell("p_value").alias("cell"))


# Trial pipelines ---------------------------------------------------------------------------------


def _rates(spark, sf):
    return A.conditioned_rate(trials(spark, sf), phase(spark, sf, "pre"), order_by=ORDER)


def _pairs(spark, sf):
    return A.rating_pairs(trials(spark, sf), phase(spark, sf, "pre"), order_by=ORDER)


def _change(spark, sf):
    return A.rating_change(_pairs(spark, sf))


def _scores(spark, sf):
    return A.instrument_scores(items(spark, sf), INSTRUMENTS)


def _links(spark, sf):
    return A.symptom_links(_scores(spark, sf), _hits_wide(spark, sf), _rates(spark, sf))


def _hits(spark, sf, conds=A.PAIRED):
    """Rates over the items tested at both times: the filter ``seen_twice`` is the feature. ``*_every_item`` have none."""
    return A.hit_rate(trials(spark, sf), conds, order_by=ORDER, seen_twice=True)


def _hits_wide(spark, sf, conds=A.PAIRED):
    return A.hit_rate_wide(trials(spark, sf), conds, order_by=ORDER, seen_twice=True)


def _substitutes(spark, sf):
    return A.substitute_hits(trials(spark, sf), sub="filler", givers=["t", "nt"], order_by=ORDER)


@query
def conditioned_rate(spark, sf):
    return _rates(spark, sf)


@query
def change_score(spark, sf):
    return _change(spark, sf)


@query
def change_score_correct(spark, sf):
    log, pretest = trials(spark, sf), phase(spark, sf, "pre")
    return A.rating_change(A.rating_pairs(log, pretest, only_correct=True, order_by=ORDER))


@query
def substitute_hit_rate(spark, sf):
    return _substitutes(spark, sf)


@query
def first_last_paired(spark, sf):
    wide = A.first_last(trials(spark, sf), phase(spark, sf, "pre"), order_by=ORDER)
    return paired.paired_t(wide, "block1", "block10", alternative="greater")


@query
def recall_paired(spark, sf):
    return A.paired_levels(_hits_wide(spark, sf, A.RATED), alternative="less")


@query
def substitute_paired(spark, sf):
    return A.paired_by_condition(_substitutes(spark, sf), "hit_rate", ("nt", "t"), alternative="greater")


# Paired statistics -------------------------------------------------------------------------------


def _first_last_lines(spark, sf):
    keys = ["l_returnflag", "l_suppkey"]
    lines = table(spark, sf, "lineitem")
    return reshape.pivot_aggregate(lines, keys, "l_linenumber", [1, 7], strict_avg, "l_quantity", prefix="block")


@query
def paired_t(spark, sf):
    return paired.paired_t(_first_last_lines(spark, sf), "block1", "block7", ["l_returnflag"])


@query
def paired_t_long(spark, sf):
    rates = _hits(spark, sf)
    return paired.paired_t_long(rates, ["subj"], "cond", "hit_rate", A.PAIRED, alternative="less")


@query
def paired_effect_size(spark, sf):
    return A.change_tests(_change(spark, sf)).select("dim", "n", "t", "df", "dz", "p_directed")


@query
def paired_report(spark, sf):
    return paired.paired_report(paired.paired_t(_first_last_lines(spark, sf), "block1", "block7", ["l_returnflag"]))


@query
def t_cdf_(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_suppkey")
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    tests = stats.select("l_suppkey", ratio((F.col("m") - 25) * F.sqrt("n"), "s").alias("t"), (F.col("n") - 1).alias("df"))
    return tests.select("*", t_cdf("t", "df").alias("cdf"), t_p_value("t", "df").alias("p_value"))


@query
def f_cdf_(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_suppkey")
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.regr_r2("l_extendedprice", "l_discount").alias("r2"))
    rows = stats.select("*", F.explode(F.array(*[F.lit(d) for d in (1, 2, 3, 5)])).alias("df1"))
    rows = rows.withColumn("df2", F.col("n") - F.col("df1") - 1)
    f = ratio(F.col("r2") * F.col("df2"), (1 - F.col("r2")) * F.col("df1"))
    rows = rows.select("l_suppkey", "df1", "df2", f.alias("f"))
    return rows.withColumn("p_value", f_p_value("f", "df1", "df2"))


# Components --------------------------------------------------------------------------------------


@query
def pca_importance(spark, sf):
    return pca.importance(pca.fit_pca(table(spark, sf, "lineitem"), MEASURED, ["l_returnflag"]), ["l_returnflag"])


@query
def pca_loadings(spark, sf):
    fit = pca.fit_pca(_scores(spark, sf), COMPONENT_SCORES)
    return pca.loadings(fit, COMPONENT_SCORES)


@query
def pca_reconstruct(spark, sf):
    columns = [*MEASURED, "l_tax"]
    fit = pca.fit_pca(table(spark, sf, "lineitem"), columns, ["l_returnflag"])
    return pca.reconstruct(fit, columns, ["l_returnflag"])


@query
def pca_scores(spark, sf):
    scores = _scores(spark, sf).select("subj", *COMPONENT_SCORES)
    return A.with_components(scores, COMPONENT_SCORES)


@query
def pca_biplot(spark, sf):
    scores = _scores(spark, sf).select("subj", *COMPONENT_SCORES)
    fit = pca.fit_pca(scores, COMPONENT_SCORES)
    return pca.scores(scores, fit, COMPONENT_SCORES, components=2, scaled=True).select("subj", "pc1", "pc2")


# Regression --------------------------------------------------------------------------------------


def _two_terms():
    return [ols.Term.numeric("quantity", "l_quantity"), ols.Term.numeric("discount", "l_discount")]


def _line_fits(spark, sf):
    quantity, discount = _two_terms()
    models = {"one": [quantity], "two": [quantity, discount]}
    return ols.fit_models(table(spark, sf, "lineitem"), "l_extendedprice", models, ["l_returnflag"])


def _step_terms():
    group = ols.Term.contrast("group1", "l_linestatus", ("F", "O"))
    quantity, discount = _two_terms()
    step1 = [group, quantity, discount]
    return {"step1": step1, "step2": [*step1, group.interact(quantity), group.interact(discount)]}


def _step_fits(spark, sf):
    return ols.fit_models(table(spark, sf, "lineitem"), "l_extendedprice", _step_terms(), ["l_returnflag"])


COEFFICIENTS = ["l_returnflag", "term", "estimate", "std_error", "df", "statistic", "p_value"]


@query
def ols_two_predictors(spark, sf):
    return ols.coefficients(_line_fits(spark, sf), "two", ["l_returnflag"]).select(*COEFFICIENTS)


@query
def ols_nested_models(spark, sf):
    both = ols.coefficients(_line_fits(spark, sf), ["one", "two"], ["l_returnflag"])
    return both.select("l_returnflag", "model", "term", "estimate")


@query
def ols_ci(spark, sf):
    table_ = ols.coefficients(_line_fits(spark, sf), "two", ["l_returnflag"])
    return table_.select("l_returnflag", "term", "estimate", "ci_t_low", "ci_t_high", "ci_z_low", "ci_z_high")


@query
def ols_std_beta(spark, sf):
    table_ = ols.coefficients(_step_fits(spark, sf), "step2", ["l_returnflag"])
    return table_.select("l_returnflag", "term", "beta", "std_kind")


@query
def ols_step1(spark, sf):
    return ols.coefficients(_step_fits(spark, sf), "step1", ["l_returnflag"]).select(*COEFFICIENTS)


@query
def ols_step2(spark, sf):
    return ols.coefficients(_step_fits(spark, sf), "step2", ["l_returnflag"]).select(*COEFFICIENTS)


@query
def ols_fit_stats(spark, sf):
    return ols.fit_stats(_line_fits(spark, sf), "two", ["l_returnflag"]).drop("report")


@query
def ols_model_compare(spark, sf):
    out = ols.compare(_step_fits(spark, sf), "step1", "step2", ["l_returnflag"])
    return out.select("l_returnflag", "df_diff", "df_resid", "f_value", "p_value")


@query
def ols_report(spark, sf):
    return ols.report_table(_line_fits(spark, sf), "two", ["l_returnflag"])


@query
def ols_sentences(spark, sf):
    fits = _line_fits(spark, sf)
    table_ = ols.coefficient_report(ols.coefficients(fits, "two", ["l_returnflag"]))
    return table_.select("l_returnflag", "term", "report")


@query
def ols_fit_sentences(spark, sf):
    return ols.fit_stats(_line_fits(spark, sf), "two", ["l_returnflag"]).select("l_returnflag", "report")


@query
def ols_compare_sentences(spark, sf):
    return ols.compare(_step_fits(spark, sf), "step1", "step2", ["l_returnflag"]).select("l_returnflag", "report")


@query
def simple_slope_sentences(spark, sf):
    fits, terms = _step_fits(spark, sf), _step_terms()["step2"]
    out = ols.simple_slopes(fits, "step2", terms, "quantity", "group1", ["l_returnflag"], {"F": -0.5, "O": 0.5})
    return out.select("l_returnflag", "level", "report")


@query
def simple_slopes(spark, sf):
    fits, terms = _step_fits(spark, sf), _step_terms()["step2"]
    out = ols.simple_slopes(fits, "step2", terms, "quantity", "group1", ["l_returnflag"], {"F": -0.5, "O": 0.5})
    return out.drop("at", "report")


@query
def simple_slopes_sd(spark, sf):
    fits, terms = _step_fits(spark, sf), _step_terms()["step2"]
    out = ols.simple_slopes(fits, "step2", terms, "quantity", "group1", ["l_returnflag"])
    return out.select("l_returnflag", "level", "at", "slope", "std_error")


def _near_terms():
    """Quantity, and quantity plus the discount in millionths: two columns that differ by a 1e-7 of their length."""
    percent = F.round(F.col("l_discount") * 100)
    return [ols.Term.numeric("quantity", "l_quantity"), ols.Term.numeric("shifted", F.col("l_quantity") + percent / (1 << 20))]


@query
def ols_near_dependent(spark, sf):
    """Coefficients and fit of a design whose columns are nearly one, by triangular factors."""
    fits = ols.fit_models(table(spark, sf, "lineitem"), F.col("l_extendedprice") / 1000, {"m": _near_terms()}, ["l_returnflag"], method="qr")
    terms = ols.coefficients(fits, "m", ["l_returnflag"]).select("l_returnflag", "term", *[(F.col(c) / (1 << 20)).alias(c) for c in ("estimate", "std_error")], "statistic")
    return terms.filter("term <> '(Intercept)'").join(ols.fit_stats(fits, "m", ["l_returnflag"]).select("l_returnflag", "r_squared", "f_value"), "l_returnflag")


def _by_flag(spark, sf, formula: str, coding: str):
    model = formulas.parse(formula, {"flag": formulas.Factor(("A", "N", "R"), coding, "l_returnflag")})
    lines = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity"))
    return ols.coefficients(ols.fit_models(lines, model.outcome, {"m": model.terms}), "m").select("term_index", "term", "estimate", "beta")


@query
def formula_three_levels(spark, sf):
    """A factor of three levels crossed with a number, against the first level."""
    return _by_flag(spark, sf, "price ~ flag * quantity", "treatment").drop("beta")


@query
def formula_sum_coding(spark, sf):
    return _by_flag(spark, sf, "price ~ flag * quantity", "sum").drop("beta")


@query
def formula_no_margin(spark, sf):
    """Without the number's own term, each level has its slope."""
    return _by_flag(spark, sf, "price ~ (flag + quantity):flag", "treatment")


BATCHES = 3


def _merged_state(spark, sf):
    """Lines of each supplier as a state, from batches by order number that are merged."""
    lines = table(spark, sf, "lineitem")
    values = {"quantity": "l_quantity", "discount": "l_discount", "price": F.col("l_extendedprice") / 1000}
    out = None
    for batch in range(BATCHES):
        new = states.state_of(lines.filter(F.col("l_orderkey") % BATCHES == batch), ["l_suppkey"], values)
        out = new if out is None else states.merge(out, new, ["l_suppkey"], len(values))
    return out, list(values)


@query
def state_summary(spark, sf):
    """Mean, deviation and standard error per supplier, without reading all lines at once."""
    state, names = _merged_state(spark, sf)
    return states.summary(state, ["l_suppkey"], names)


@query
def state_regression(spark, sf):
    """A regression per supplier from the merged states."""
    state, names = _merged_state(spark, sf)
    moments = states.moments(state, ["l_suppkey"], [names.index(c) for c in ("quantity", "price")])
    fits = ols.models_from_moments(moments, {"m": [ols.Term.numeric("quantity")]}, ["l_suppkey"])
    return ols.coefficients(fits, "m", ["l_suppkey"]).select("l_suppkey", "term", "estimate", "df")


@query
def loocv_near_dependent(spark, sf):
    lines = table(spark, sf, "lineitem")
    return ols.leave_one_out(lines, F.col("l_extendedprice") / 1000, _near_terms(), ["l_returnflag"], method="qr")


@query
def loocv_press(spark, sf):
    return ols.leave_one_out(table(spark, sf, "lineitem"), F.col("l_extendedprice") / 1000, _two_terms(), ["l_returnflag"])


@query
def model_compare_table(spark, sf):
    return A.model_compare_table(_step_fits(spark, sf), ["l_returnflag"], as_text=False)


@query
def step_tables(spark, sf):
    return A.step_tables(_step_fits(spark, sf), ["l_returnflag"])


def _subjects(spark, sf):
    pairs = A.individual_differences(_scores(spark, sf), _change(spark, sf), on_missing="drop").dropna()
    return pairs.withColumn("expt", F.when(F.col("subj") % 2 == 0, "ds").otherwise("ts"))


@query
def pca_regression(spark, sf):
    fits = A.component_regression(_subjects(spark, sf), COMPONENT_SCORES, ["expt"])
    return ols.coefficients(fits, "m", ["expt", "vars"]).select("expt", "vars", "term", "estimate", "std_error")


def _moderated_three(spark, sf):
    return A.moderated_regression(_subjects(spark, sf), COMPONENT_SCORES)


@query
def moderated_coefficients(spark, sf):
    table_ = ols.coefficients(_moderated_three(spark, sf), "step2", ["vars"], holm=True)
    return table_.select("vars", "term", "estimate", "std_error", "p_value", "p_adj")


@query
def moderated_compare(spark, sf):
    out = ols.compare(_moderated_three(spark, sf), "step1", "step2", ["vars"])
    return out.select("vars", "df_diff", "df_resid", "f_value", "p_value")


@query
def moderated_regression(spark, sf):
    fits = A.moderated_regression(_subjects(spark, sf), sorted(INSTRUMENTS))
    return ols.coefficients(fits, "step2", ["vars"], holm=True)


@query
def moderated_model_table(spark, sf):
    fits = A.moderated_regression(_subjects(spark, sf), sorted(INSTRUMENTS))
    return A.model_compare_table(fits)
