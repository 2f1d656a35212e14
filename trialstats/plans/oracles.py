"""The same queries as SQL over the plain tables, written by other means where there are any.

Firsts are row numbers instead of aggregates, p-values are finite series, coefficients are closed forms or
separate fits, eigenvalues are the closed form for three columns or repeated squaring for four, noncentral limits
come from a grid, and Holm ranks are plain windows.
"""

from __future__ import annotations

from trialstats.plans.queries import WIDE_COLUMNS
from trialstats.sources.logs import EXCLUDED_2
from trialstats.sources.roles import PRE_ENDS, SQL_ITEMS, SQL_TRIALS

ORACLES: dict[str, str] = {}


def r6(expr: str) -> str:
    """Rounded to six places, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0e0)"


def strict(fn: str, value: str) -> str:
    return f"CASE WHEN count(*) = count({value}) THEN {fn}({value}) END"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite trigonometric series."""
    theta = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    odd = (
        f"(2e0 / pi()) * ({theta} + sin({theta}) * coalesce(list_sum(list_transform("
        f"range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp(0.5e0 * ln(pi()) + lgamma(k + 1e0) - lgamma(k + 1.5e0) "
        f"- ln(2e0) + (2 * k + 1) * ln(cos({theta}))))), 0e0) )"
    )
    even = (
        f"sin({theta}) * coalesce(list_sum(list_transform("
        f"range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1e0) - 0.5e0 * ln(pi()) "
        f"+ 2 * k * ln(cos({theta}))))), 0e0)"
    )
    return f"(1e0 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def t_upper(t: str, df: str) -> str:
    p = t_two_sided(t, df)
    return f"(CASE WHEN {t} >= 0 THEN {p} / 2 ELSE 1 - {p} / 2 END)"


def f_upper(f: str, df1: str, df2: str) -> str:
    """P(F >= f) for whole degrees of freedom: a finite sum from df1 = 0 (even) or from t (odd)."""
    x = f"({df2} / ({df2} + {df1} * {f}))"
    y = f"({df1} * {f} / ({df2} + {df1} * {f}))"
    even = (
        f"list_sum(list_transform(range(0, CAST({df1} // 2 AS BIGINT)), lambda j: exp({df2} / 2e0 * ln({x}) "
        f"+ j * ln({y}) + lgamma({df2} / 2e0 + j) - lgamma(j + 1e0) - lgamma({df2} / 2e0))))"
    )
    odd = (
        f"({t_two_sided(f'sqrt({df1} * {f})', df2)} + coalesce(list_sum(list_transform("
        f"range(0, CAST(({df1} - 1) // 2 AS BIGINT)), lambda j: exp({df2} / 2e0 * ln({x}) + (j + 0.5e0) * ln({y}) "
        f"+ lgamma({df2} / 2e0 + j + 0.5e0) - lgamma({df2} / 2e0) - lgamma(j + 1.5e0)))), 0e0))"
    )
    return f"(CASE WHEN {df1} % 2 = 0 THEN {even} ELSE {odd} END)"


# Shared pieces -----------------------------------------------------------------------------------

FIRST_PER_ITEM = """pre_item AS (
  SELECT subj, item, cond, correct FROM (
    SELECT *, row_number() OVER (PARTITION BY subj, item ORDER BY event_id) AS rn FROM trials WHERE time = 'pre'
  ) WHERE rn = 1)"""
FIRST_PER_CELL = """cells AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY subj, cond, item, time ORDER BY event_id) AS rn FROM trials
  ) WHERE rn = 1)"""
PRE_POST = """pre_post AS (
  SELECT subj, cond, item, max(CASE WHEN time = 'pre' THEN correct END) AS pre,
    max(CASE WHEN time = 'post' THEN correct END) AS post, count(*) AS times
  FROM cells WHERE cond IN ('b', 'nt', 't') GROUP BY subj, cond, item)"""
HITS = f"""hits AS (
  SELECT cond, subj, {strict('avg', 'post')} AS hit_rate FROM pre_post WHERE pre = 1 AND times = 2 GROUP BY cond, subj)"""
HITS_WIDE = """hits_wide AS (
  SELECT subj, max(CASE WHEN cond = 'b' THEN hit_rate END) AS b, max(CASE WHEN cond = 'nt' THEN hit_rate END) AS nt
  FROM hits WHERE cond IN ('b', 'nt') GROUP BY subj)"""
RATES = """rates AS (
  SELECT t.subj, t.block, t.cond, avg(CASE WHEN t.outcome = 0 THEN 0e0 ELSE 1e0 END) AS rate
  FROM trials t JOIN pre_item p ON t.subj = p.subj AND t.item = p.item
  WHERE t.outcome IS NOT NULL AND p.correct = 1 GROUP BY t.subj, t.block, t.cond)"""
PAIRS = """both_ratings AS (
  SELECT subj, cond, item,
    max(CASE WHEN time = 'pre' THEN val END) AS val_pre, max(CASE WHEN time = 'post' THEN val END) AS val_post,
    max(CASE WHEN time = 'pre' THEN aro END) AS aro_pre, max(CASE WHEN time = 'post' THEN aro END) AS aro_post,
    max(CASE WHEN time = 'pre' THEN correct END) AS passed
  FROM cells WHERE cond IN ('b', 'nt', 't') GROUP BY subj, cond, item),
pairs AS (
  SELECT subj, cond, item, 'val' AS dim, val_pre AS pre, val_post AS post FROM both_ratings WHERE passed = 1
  UNION ALL
  SELECT subj, cond, item, 'aro', CAST(aro_pre AS DOUBLE), CAST(aro_post AS DOUBLE) FROM both_ratings WHERE passed = 1)"""
CHANGE = """change AS (
  SELECT subj, cond, dim, avg(pre) AS pre, avg(post) AS post, avg(post - pre) AS diff
  FROM pairs WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY subj, cond, dim)"""
SCORES = """scores AS (
  SELECT subj,
    CAST(sum(CASE WHEN ques = 'bdi' THEN value END) AS BIGINT) AS bdi,
    CAST(sum(CASE WHEN ques = 'rrs' AND cond = 'n' THEN value END) AS BIGINT) AS rrs,
    CAST(sum(CASE WHEN ques = 'stais' THEN CASE WHEN cond = 'r' THEN 4 - value ELSE value END END) AS BIGINT) AS stais,
    CAST(sum(CASE WHEN ques = 'stait' THEN CASE WHEN cond = 'r' THEN 4 - value ELSE value END END) AS BIGINT) AS stait
  FROM items GROUP BY subj)"""
DIFFERENCES = """differences AS (
  SELECT subj,
    max(CASE WHEN dim = 'aro' AND cond = 'b' THEN diff END) - max(CASE WHEN dim = 'aro' AND cond = 'nt' THEN diff END) AS aro,
    max(CASE WHEN dim = 'val' AND cond = 'nt' THEN diff END) - max(CASE WHEN dim = 'val' AND cond = 'b' THEN diff END) AS val
  FROM change GROUP BY subj)"""
LINKS = """links AS (
  SELECT s.*, h.b - h.nt AS item_recog, i.intrusion
  FROM scores s LEFT JOIN hits_wide h ON s.subj = h.subj
  LEFT JOIN (SELECT subj, avg(rate) AS intrusion FROM rates WHERE cond = 'nt' GROUP BY subj) i ON s.subj = i.subj)"""
SUBSTITUTES = """giver AS (
  SELECT subj, item, cond, correct FROM (
    SELECT *, row_number() OVER (PARTITION BY subj, item ORDER BY event_id) AS rn
    FROM trials WHERE time = 'pre' AND cond IN ('t', 'nt')) WHERE rn = 1),
substitutes AS (
  SELECT g.cond, s.subj, CASE WHEN count(*) = count(s.correct) THEN avg(s.correct) END AS hit_rate
  FROM trials s JOIN giver g ON s.subj = g.subj AND s.item = g.item
  WHERE s.cond = 'filler' AND g.correct = 1 GROUP BY g.cond, s.subj)"""

TRIAL = with_ctes(SQL_TRIALS)
ITEM = with_ctes(SQL_ITEMS)
TO_HITS = with_ctes(SQL_TRIALS, FIRST_PER_CELL, PRE_POST, HITS, HITS_WIDE)
TO_RATES = with_ctes(SQL_TRIALS, FIRST_PER_ITEM, RATES)
TO_PAIRS = with_ctes(SQL_TRIALS, FIRST_PER_CELL, PAIRS)
TO_CHANGE = with_ctes(SQL_TRIALS, FIRST_PER_CELL, PAIRS, CHANGE)
TO_SCORES = with_ctes(SQL_ITEMS, SCORES)
TO_DIFFERENCES = with_ctes(SQL_TRIALS, SQL_ITEMS, FIRST_PER_CELL, PAIRS, CHANGE, SCORES, DIFFERENCES)
TO_LINKS = with_ctes(
    SQL_TRIALS, SQL_ITEMS, FIRST_PER_CELL, PRE_POST, HITS, HITS_WIDE, FIRST_PER_ITEM, RATES, SCORES, LINKS
)
TO_SUBSTITUTES = with_ctes(SQL_TRIALS, SUBSTITUTES)


def paired(prefix: str, source: str, x: str, y: str, key: str = "", alternative: str = "two.sided") -> str:
    """Paired test of two columns of a subquery, in two steps over it."""
    p = {
        "two.sided": t_two_sided("t", "df"),
        "greater": t_upper("t", "df"),
        "less": t_upper("(-t)", "df"),
    }[alternative]
    by = f"GROUP BY {key}" if key else ""
    keys = f"{key}, " if key else ""
    return f"""{prefix}, moments AS (
  SELECT {keys}count({x} - {y}) AS n, avg({x} - {y}) AS m, stddev_samp({x} - {y}) AS s FROM {source} {by}),
tests AS (SELECT *, m * sqrt(n) / s AS t, CASE WHEN n >= 2 THEN n - 1 END AS df, m / s AS dz FROM moments)
SELECT {keys}n, {r6('m')} AS mean_diff, {r6('s')} AS sd_diff, {r6('t')} AS t, df, {r6('dz')} AS dz,
  {r6(p)} AS p_value FROM tests"""


# Scans and projections ---------------------------------------------------------------------------

ORACLES["scan_trials"] = f"""SELECT event_id, user_id, event_type, {r6('value')} AS value FROM events
WHERE user_id IS NULL OR user_id NOT IN {EXCLUDED_2}"""

ORACLES["scan_tagged_union"] = f"""{TRIAL}
SELECT event_id, subj, item, cond, {r6('val')} AS val, correct, 'pre' AS time, CAST(NULL AS INTEGER) AS aro
FROM trials WHERE time = 'pre'
UNION ALL
SELECT event_id, subj, item, cond, NULL, correct, 'post', aro FROM trials WHERE time = 'post'"""

ORACLES["project_rename"] = f"""SELECT l_suppkey AS subj, l_returnflag AS cond, l_linenumber AS block,
  {r6('l_quantity')} AS value FROM lineitem"""

ORACLES["drop_columns"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice FROM orders"""

ORACLES["round_range"] = f"""SELECT l_returnflag, l_linestatus, {r6('avg(l_quantity)')} AS l_quantity,
  round_even(avg(l_extendedprice), 2) AS l_extendedprice, round_even(avg(l_discount), 2) AS l_discount,
  round_even(avg(l_tax), 2) AS l_tax FROM lineitem GROUP BY l_returnflag, l_linestatus"""

ORACLES["keep_unused"] = f"""{TO_HITS} SELECT subj, {r6('b - nt')} AS item_recog FROM hits_wide"""

ORACLES["across_mean_sd"] = (
    "SELECT l_returnflag, "
    + ", ".join(
        f"{r6(strict(fn, c))} AS {c}_{name}"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
        for name, fn in (("mean", "avg"), ("sd", "stddev_samp"))
    )
    + " FROM lineitem GROUP BY l_returnflag"
)

ORACLES["filter_compound"] = f"""{TRIAL} SELECT event_id, subj, cond, block, outcome, correct FROM trials
WHERE block IN (1, 10) AND cond = 'nt' AND outcome > 0 AND correct <> 0"""

ORACLES["exclude_subjects"] = f"""{TRIAL} SELECT t.subj_raw, t.event_id, t.cond FROM trials t
WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT subj FROM trials GROUP BY subj HAVING avg(CASE WHEN outcome IS NULL THEN 1 ELSE 0 END) > 0.25) x
  WHERE x.subj = t.subj_raw)"""

ORACLES["missing_count"] = f"""{TRIAL} SELECT subj, block, count(*) AS n FROM trials WHERE outcome IS NULL
GROUP BY subj, block"""

ORACLES["binarise_outcome"] = f"""{TRIAL} SELECT event_id, outcome,
  CASE WHEN outcome IS NULL THEN NULL WHEN outcome = 0 THEN 0 ELSE 1 END AS in_or_not FROM trials"""

ORACLES["rebase_block"] = f"""{TRIAL} SELECT event_id, CAST(block_raw AS INTEGER) + 1 AS block FROM trials
WHERE block_raw <> 'prac'"""

ORACLES["level_order"] = f"""{TRIAL} SELECT cond, count(*) AS n,
  CASE cond WHEN 't' THEN 1 WHEN 'nt' THEN 2 WHEN 'b' THEN 3 WHEN 'filler' THEN 4 END AS rank,
  CASE cond WHEN 't' THEN 'Think' WHEN 'nt' THEN 'No-Think' WHEN 'b' THEN 'Baseline' WHEN 'filler' THEN 'Filler' END AS label
FROM trials GROUP BY cond"""

ORACLES["level_first_appearance"] = f"""{TRIAL} SELECT cond, min(event_id) AS first,
  CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS rank FROM trials GROUP BY cond"""

ORACLES["outcome_counts"] = f"""{TRIAL} SELECT subj, outcome, count(*) AS n FROM trials GROUP BY subj, outcome"""

ORACLES["skipped_items"] = f"""{TRIAL} SELECT cond, skipped, count(*) AS n FROM (
  SELECT cond, bool_or(val IS NULL) AS skipped FROM trials GROUP BY subj, cond, item) GROUP BY cond, skipped"""

ORACLES["collapse_label"] = f"""{TRIAL} SELECT event_id, CASE WHEN contains(cond, 'new') THEN 'new' ELSE cond END AS cond
FROM trials"""

ORACLES["recode_label"] = f"""SELECT CASE l_linenumber WHEN 1 THEN 'val' WHEN 2 THEN 'aro' ELSE CAST(l_linenumber AS VARCHAR) END AS dim,
  count(*) AS n, {r6('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY ALL"""

ROUNDED = {
    "amount": "l_extendedprice * l_discount * 2.5::DOUBLE",
    "eighths": "(l_quantity - 25) / 8::DOUBLE",
    "near": "l_quantity + l_discount / 2::DOUBLE",
}
ORACLES["round_exact"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"printf('%.2f', {c}) AS {n}_text, CAST(printf('%.2f', {c}) AS DOUBLE) + 0e0 AS {n}" for n, c in ROUNDED.items()
) + " FROM lineitem"
ORACLES["round_doubles"] = f"""{TO_SUBSTITUTES} SELECT cond, round_even(avg(hit_rate), 2) AS hit_rate_mean,
  round_even(stddev_samp(hit_rate), 2) AS hit_rate_sd FROM substitutes GROUP BY cond"""

# Reshape -----------------------------------------------------------------------------------------

ORACLES["pivot_pre_post"] = f"""{TO_HITS} SELECT subj, cond, item, pre, post FROM pre_post"""

FIRST_LAST = """first_last AS (
  SELECT subj, max(CASE WHEN block = 1 THEN rate END) AS block1, max(CASE WHEN block = 10 THEN rate END) AS block10
  FROM rates WHERE cond = 'nt' AND block IN (1, 10) GROUP BY subj)"""
TO_FIRST_LAST = with_ctes(SQL_TRIALS, FIRST_PER_ITEM, RATES, FIRST_LAST)

ORACLES["pivot_prefix"] = f"""{TO_FIRST_LAST} SELECT subj, {r6('block1')} AS block1, {r6('block10')} AS block10 FROM first_last"""


def _change_cells(conds: tuple[str, ...], dims: tuple[str, ...]) -> str:
    return ", ".join(
        r6(f"max(CASE WHEN dim = '{d}' AND cond = '{c}' THEN diff END)") + f" AS diff_{d}_{c}" for d in dims for c in conds
    )


ORACLES["pivot_two_names"] = f"""{TO_CHANGE} SELECT subj, {_change_cells(('b', 'nt', 't'), ('val', 'aro'))}
FROM change GROUP BY subj"""

ORACLES["score_spread"] = f"""{TO_SCORES} SELECT * FROM scores"""

ORACLES["unpivot_measures"] = f"""{TRIAL} SELECT event_id, 'val' AS dim, {r6('val')} AS value FROM trials
UNION ALL SELECT event_id, 'aro', {r6('aro')} FROM trials"""

RATING_UNITS = """units AS (
  SELECT cond, dim, subj, avg(pre) AS pre, avg(post) AS post FROM pairs
  WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY cond, dim, subj)"""
ORACLES["unpivot_split"] = (
    TO_PAIRS.rstrip()
    + ", "
    + RATING_UNITS
    + " UNION ALL ".join(
        f" SELECT '{time}' AS time, '{stat}' AS stat, "
        + ", ".join(
            r6(f"{fn}(CASE WHEN dim = '{d}' AND cond = '{c}' THEN {time} END)") + f" AS {d}_{c}"
            for d in ("val", "aro")
            for c in ("b", "nt", "t")
        )
        + " FROM units"
        for time in ("pre", "post")
        for stat, fn in (("mean", "avg"), ("sd", "stddev_samp"))
    )
)

ORACLES["separate_phase"] = f"""{TRIAL} SELECT event_id, p[1] AS time, p[2] AS task FROM (
  SELECT event_id, regexp_split_to_array(time || '-' || cond, '[^A-Za-z0-9]+') AS p FROM trials)"""

SKIPPED = """per_item AS (SELECT subj, item, bool_or(val IS NULL) AS skipped FROM trials GROUP BY subj, item),
completed AS (
  SELECT s.subj, l.skipped, count(p.item) AS n
  FROM (SELECT DISTINCT subj FROM per_item) s CROSS JOIN (SELECT DISTINCT skipped FROM per_item) l
  LEFT JOIN per_item p ON p.subj = s.subj AND p.skipped = l.skipped GROUP BY s.subj, l.skipped)"""
TO_SKIPPED = with_ctes(SQL_TRIALS, SKIPPED)
ORACLES["complete_counts"] = f"""{TO_SKIPPED} SELECT subj, skipped, n FROM completed"""


def _strict_where(fn: str, value: str, where: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER (WHERE {where}) = count({value}) FILTER (WHERE {where}) "
        f"THEN {fn}({value}) FILTER (WHERE {where}) END"
    )


ORACLES["rate_wide"] = (
    TRIAL
    + "SELECT subj, "
    + ", ".join(r6(_strict_where("avg", "correct", f"cond = '{c}'")) + f" AS {c}" for c in ("b", "nt", "t"))
    + " FROM trials GROUP BY subj"
)

# Joins -------------------------------------------------------------------------------------------

ORACLES["join_condition_on_pretest"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_ITEM)}
SELECT t.event_id, t.subj, t.item, t.cond, t.outcome, p.correct AS correct_pre
FROM trials t LEFT JOIN pre_item p ON t.subj = p.subj AND t.item = p.item"""

ORACLES["join_three_keys"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_CELL)}
SELECT t.event_id, t.subj, t.cond, t.item, {r6('t.val')} AS val, t.aro, p.correct AS correct_pre
FROM trials t LEFT JOIN cells p ON t.subj = p.subj AND t.item = p.item AND t.cond = p.cond AND p.time = 'pre'"""

ORACLES["self_join_inherit"] = f"""{TO_SUBSTITUTES}
SELECT s.event_id, s.subj, s.item, s.cond, s.time, s.correct, g.cond AS cond_of, g.correct AS copre
FROM trials s LEFT JOIN giver g ON s.subj = g.subj AND s.item = g.item WHERE s.cond = 'filler'"""

ORACLES["join_chain_subject"] = f"""{TO_LINKS} SELECT subj, bdi, rrs, stais, stait, {r6('item_recog')} AS item_recog,
  {r6('intrusion')} AS intrusion FROM links"""

ORACLES["indiv_diff_table"] = f"""{TO_DIFFERENCES} SELECT s.*, {r6('d.aro')} AS aro, {r6('d.val')} AS val
FROM scores s JOIN differences d ON s.subj = d.subj"""

ORACLES["key_uniqueness"] = f"""{TRIAL} SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows,
  count(*) FILTER (WHERE n > 1) AS n_duplicated, max(n) AS max_rows
FROM (SELECT count(*) AS n FROM trials GROUP BY subj, cond, item, time)"""

ORACLES["union_experiments"] = f"""{TO_SCORES} SELECT *, CASE WHEN subj % 2 = 0 THEN 'ds' ELSE 'ts' END AS expt FROM scores"""

ORACLES["export_wide"] = f"""{TO_DIFFERENCES}, wide AS (SELECT subj, {_change_cells(('b', 'nt'), ('aro', 'val'))} FROM change GROUP BY subj)
SELECT w.*, s.bdi, s.rrs, s.stais, s.stait FROM wide w LEFT JOIN scores s ON w.subj = s.subj"""

ORACLES["export_wide_all"] = f"""{TO_DIFFERENCES}, wide AS (SELECT subj, {_change_cells(('b', 'nt', 't'), ('aro', 'val'))} FROM change GROUP BY subj)
SELECT w.*, s.bdi, s.rrs, s.stais, s.stait FROM wide w LEFT JOIN scores s ON w.subj = s.subj"""

ORACLES["pair_by_key_complete"] = "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY l_suppkey"

# Aggregation -------------------------------------------------------------------------------------

ORACLES["rate_by_condition"] = f"""{TO_HITS} SELECT cond, subj, {r6('hit_rate')} AS hit_rate FROM hits WHERE cond IN ('b', 'nt')"""

HITS_EVERY = HITS.replace(" AND times = 2", "")
TO_EVERY = with_ctes(SQL_TRIALS, FIRST_PER_CELL, PRE_POST, HITS_EVERY, HITS_WIDE)
ORACLES["rate_every_item"] = f"""{TO_EVERY} SELECT cond, subj, {r6('hit_rate')} AS hit_rate FROM hits WHERE cond IN ('b', 'nt')"""
ORACLES["paired_t_every_item"] = paired(TO_EVERY, "hits_wide", "nt", "b", alternative="less")

ORACLES["score_sum"] = f"""{ITEM} SELECT subj, ques, CAST(sum(value) AS BIGINT) AS score FROM items GROUP BY subj, ques"""

ORACLES["score_reverse_keyed"] = f"""{ITEM} SELECT subj, ques,
  CAST(sum(CASE WHEN cond = 'r' THEN 4 - value ELSE value END) AS BIGINT) AS score FROM items GROUP BY subj, ques"""

ORACLES["score_subscale"] = f"""{ITEM} SELECT subj, CAST(sum(value) AS BIGINT) AS score, 'rrs' AS ques FROM items
WHERE ques = 'rrs' AND cond = 'n' GROUP BY subj"""

ORACLES["demographics"] = f"""SELECT count(*) AS n, CAST(sum(gender) AS BIGINT) AS male, {r6('avg(age)')} AS mean_age,
  {r6('stddev_samp(age)')} AS sd_age
FROM (SELECT DISTINCT user_id, user_id % 2 AS gender, user_id % 13 + 18 AS age FROM events)"""

ORACLES["dropped_items"] = f"""{TO_HITS} SELECT cond, {r6('avg(n)')} AS mean, {r6('stddev_samp(n)')} AS sd
FROM (SELECT cond, subj, count(*) AS n FROM pre_post WHERE pre = 0 AND cond IN ('b', 'nt') GROUP BY cond, subj) GROUP BY cond"""

ORACLES["tally_by_flag"] = f"""SELECT l_returnflag, {r6('avg(n)')} AS mean, {r6('stddev_samp(n)')} AS sd
FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"""

ORACLES["robust_prices"] = f"""WITH med AS (SELECT l_returnflag AS g, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, {r6('avg(l_extendedprice)')} AS mean, {r6('median(l_extendedprice)')} AS median, {r6('stddev_samp(l_extendedprice)')} AS sd,
  {r6('1.4826e0 * median(abs(l_extendedprice - m))')} AS mad, min(l_extendedprice) AS min, max(l_extendedprice) AS max
FROM lineitem JOIN med ON l_returnflag = g GROUP BY l_returnflag"""

ORACLES["median_by_subject"] = f"""SELECT l_suppkey, l_linestatus, count(*) AS n, {r6('median(l_extendedprice * (1 - l_discount))')} AS median
FROM lineitem GROUP BY l_suppkey, l_linestatus"""

ORACLES["robust_summary"] = f"""{TO_SKIPPED}, med AS (SELECT skipped, median(n) AS m FROM completed GROUP BY skipped)
SELECT c.skipped, {r6('avg(n)')} AS mean, {r6('median(n)')} AS median, {r6('stddev_samp(n)')} AS sd,
  {r6('1.4826e0 * median(abs(n - m))')} AS mad, min(n) AS min, max(n) AS max
FROM completed c JOIN med ON c.skipped = med.skipped GROUP BY c.skipped"""

RECOGNITION = f"""recognition AS (
  SELECT time, cond, subj, {strict('avg', 'correct')} AS rate FROM (
    SELECT time, CASE WHEN contains(cond, 'new') THEN 'new' ELSE cond END AS cond, subj, correct FROM trials)
  WHERE cond <> 'filler' GROUP BY ALL)"""
ORACLES["two_level_table"] = with_ctes(SQL_TRIALS, RECOGNITION) + " UNION ALL ".join(
    f"SELECT time, '{stat}' AS index, "
    + ", ".join(f"round_even({_strict_where(fn, 'rate', f'''cond = '{c}' ''')}, 2) + 0e0 AS {c}" for c in ("t", "nt", "b", "new"))
    + " FROM recognition GROUP BY time"
    for stat, fn in (("mean", "avg"), ("sd", "stddev_samp"))
)

MEAN_SE = ", ".join(
    [
        "count({v}) AS n",
        r6("avg({v})") + " AS mean",
        r6("stddev_samp({v}) / sqrt(count({v}))") + " AS se",
        r6("avg({v}) - stddev_samp({v}) / sqrt(count({v}))") + " AS low",
        r6("avg({v}) + stddev_samp({v}) / sqrt(count({v}))") + " AS high",
    ]
)

ORACLES["mean_se_curve"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_ITEM)}, curve AS (
  SELECT t.expt, t.subj, t.block, p.correct, avg(CASE WHEN t.outcome = 0 THEN 0e0 ELSE 1e0 END) AS rate
  FROM trials t LEFT JOIN pre_item p ON t.subj = p.subj AND t.item = p.item
  WHERE t.outcome IS NOT NULL AND t.cond = 'nt' GROUP BY ALL)
SELECT expt, block, CASE correct WHEN 1 THEN 'Recognized' WHEN 0 THEN 'Non-Recognized' END AS status,
  {MEAN_SE.format(v='rate')} FROM curve GROUP BY ALL"""

ORACLES["block_curve"] = f"""{TO_RATES} SELECT block, cond, {MEAN_SE.format(v='rate')},
  CASE cond WHEN 't' THEN 1 WHEN 'nt' THEN 2 WHEN 'b' THEN 3 WHEN 'filler' THEN 4 END AS cond_order
FROM rates GROUP BY block, cond"""

ORACLES["mean_se_condition"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_CELL, PRE_POST, HITS, PAIRS, CHANGE)}
SELECT CASE WHEN cond = 'b' THEN 'Baseline' ELSE 'No-Think' END AS cond, {MEAN_SE.format(v='hit_rate')}, 'hit_rate' AS dim
FROM hits WHERE cond IN ('b', 'nt') GROUP BY ALL
UNION ALL
SELECT CASE WHEN cond = 'b' THEN 'Baseline' ELSE 'No-Think' END, {MEAN_SE.format(v='diff')}, dim
FROM change WHERE cond IN ('b', 'nt') GROUP BY ALL"""

ORACLES["mean_se_condition_all"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_CELL, PRE_POST, HITS, PAIRS, CHANGE)}
SELECT CASE WHEN cond = 'b' THEN 'Baseline' ELSE 'No-Think' END AS cond, {MEAN_SE.format(v='diff')}, dim FROM change GROUP BY ALL"""


def _column_pairs(columns: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _correlations(source: str, columns: tuple[str, ...], key: str) -> str:
    by = f"GROUP BY {key}" if key else ""
    keys = f"{key}, " if key else ""
    return " UNION ALL ".join(
        f"SELECT {keys}'{a}' AS x, '{b}' AS y, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"corr({a}, {b}) AS r FROM {source} {by}"
        for a, b in _column_pairs(columns)
    )


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
TESTED = "SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM pairs_"

ORACLES["corr_matrix"] = f"""WITH pairs_ AS ({_correlations('lineitem', LINE_COLUMNS, 'l_returnflag')}), tested AS ({TESTED})
SELECT l_returnflag, x, y, n, {r6('r')} AS r, {r6('t')} AS t, {r6(t_two_sided('t', 'df'))} AS p_value FROM tested"""

ORACLES["pair_regression"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, CAST(regr_count({b}, {a}) AS BIGINT) AS n, "
    f"{r6(f'regr_slope({b}, {a})')} AS slope, "
    f"{r6(f'regr_intercept({b}, {a})')} AS intercept, {r6(f'regr_r2({b}, {a})')} AS r2 FROM lineitem GROUP BY l_returnflag"
    for a, b in _column_pairs(LINE_COLUMNS)
)

WIDE_TABLE = "(SELECT l_returnflag, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in WIDE_COLUMNS.items()) + " FROM lineitem)"
ORACLES["corr_wide"] = f"""WITH pairs_ AS ({_correlations(WIDE_TABLE, tuple(WIDE_COLUMNS), 'l_returnflag')}),
tested AS (SELECT *, CASE WHEN n > 2 AND abs(r) < 1 - 1e-9 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t, n - 2 AS df FROM pairs_)
SELECT l_returnflag, x, y, n, {r6('r')} AS r, {r6('t')} AS t, {r6(t_two_sided('t', 'df'))} AS p_value FROM tested"""
ORACLES["pair_regression_wide"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, CAST(regr_count({b}, {a}) AS BIGINT) AS n, "
    f"{r6(f'regr_slope({b}, {a})')} AS slope, "
    f"{r6(f'regr_intercept({b}, {a})')} AS intercept, {r6(f'regr_r2({b}, {a})')} AS r2 FROM {WIDE_TABLE} GROUP BY l_returnflag"
    for a, b in _column_pairs(tuple(WIDE_COLUMNS))
)

LINK_COLUMNS = ("bdi", "rrs", "stais", "stait", "intrusion", "item_recog")
ORACLES["symptom_correlations"] = f"""{TO_LINKS}, pairs_ AS ({_correlations('links', LINK_COLUMNS, '')})
SELECT x, y, n, {r6('r')} AS r FROM pairs_"""

ORACLES["symptom_tests"] = f"""{TO_LINKS}, pairs_ AS ({_correlations('links', LINK_COLUMNS, '')}), tested AS ({TESTED})
SELECT x, y, n, {r6('r')} AS r, {r6('t')} AS t, {r6(t_two_sided('t', 'df'))} AS p_value FROM tested"""

# Windows, text -----------------------------------------------------------------------------------

ORACLES["lag_diff"] = f"""{TO_RATES}, steps AS (SELECT cond, block, avg(rate) AS rate FROM rates GROUP BY cond, block)
SELECT cond, block, {r6('rate')} AS rate, {r6('rate - lag(rate) OVER (PARTITION BY cond ORDER BY block)')} AS diff FROM steps"""

SUPPLIER_TESTS = f"""pairs_ AS ({_correlations('lineitem', ('l_quantity', 'l_discount', 'l_tax'), 'l_suppkey')}),
tested AS ({TESTED}), p_values AS (SELECT l_suppkey, x, y, {t_two_sided('t', 'df')} AS p FROM tested)"""

ORACLES["holm_adjust"] = f"""WITH {SUPPLIER_TESTS}, stepped AS (
  SELECT *, (count(*) OVER (PARTITION BY x, y) - row_number() OVER (PARTITION BY x, y ORDER BY p) + 1) * p AS v FROM p_values)
SELECT l_suppkey, x, y, {r6('p')} AS p_value,
  {r6('least(1, max(v) OVER (PARTITION BY x, y ORDER BY p ROWS UNBOUNDED PRECEDING))')} AS p_adj FROM stepped"""

ORACLES["holm_missing_family"] = f"""WITH moments AS (
  SELECT l_suppkey, count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem GROUP BY l_suppkey),
tested AS (SELECT l_suppkey, m * sqrt(n) / s AS t, n - 1 AS df FROM moments),
p_values AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END AS family, {t_two_sided('t', 'df')} AS p FROM tested),
stepped AS (
  SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p AS v FROM p_values)
SELECT l_suppkey, family, {r6('p')} AS p_value, {r6('least(1, max(v) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING))')} AS p_adj
FROM stepped"""

THREE = "substr(printf('%.3f', p), 2)"
ORACLES["format_p"] = f"""WITH {SUPPLIER_TESTS} SELECT l_suppkey, x, y,
  CASE WHEN p < 0.001 THEN '_p_ < .001' WHEN printf('%.3f', p) = '1.000' THEN '_p_ > .999' ELSE '_p_ = ' || {THREE} END AS text,
  CASE WHEN p < 0.001 THEN '< .001' WHEN p > 0.999 THEN '> .999' ELSE {THREE} END AS cell FROM p_values"""

# Trial pipelines ---------------------------------------------------------------------------------

ORACLES["conditioned_rate"] = f"""{TO_RATES} SELECT subj, block, cond, {r6('rate')} AS rate FROM rates"""

ORACLES["change_score"] = f"""{TO_CHANGE} SELECT subj, cond, dim, {r6('pre')} AS pre, {r6('post')} AS post, {r6('diff')} AS diff
FROM change"""

PAIRS_CORRECT = PAIRS.replace("FROM cells WHERE cond IN", "FROM cells_correct WHERE cond IN").replace(
    "max(CASE WHEN time = 'pre' THEN correct END) AS passed",
    "(SELECT c.correct FROM cells c WHERE c.subj = cells_correct.subj AND c.cond = cells_correct.cond "
    "AND c.item = cells_correct.item AND c.time = 'pre') AS passed",
)
CORRECT_CELLS = """cells_correct AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY subj, cond, item, time ORDER BY event_id) AS rn FROM trials WHERE correct = 1
  ) WHERE rn = 1)"""
ORACLES["change_score_correct"] = f"""{with_ctes(SQL_TRIALS, FIRST_PER_CELL, CORRECT_CELLS, PAIRS_CORRECT, CHANGE)}
SELECT subj, cond, dim, {r6('pre')} AS pre, {r6('post')} AS post, {r6('diff')} AS diff FROM change"""

ORACLES["substitute_hit_rate"] = f"""{TO_SUBSTITUTES} SELECT cond, subj, {r6('hit_rate')} AS hit_rate FROM substitutes"""

ORACLES["first_last_paired"] = paired(TO_FIRST_LAST, "first_last", "block1", "block10", alternative="greater")
ORACLES["recall_paired"] = paired(TO_HITS, "hits_wide", "nt", "b", alternative="less")
ORACLES["paired_t_long"] = paired(TO_HITS, "hits_wide", "nt", "b", alternative="less")

SUBSTITUTES_WIDE = """substitutes_wide AS (
  SELECT subj, max(CASE WHEN cond = 'nt' THEN hit_rate END) AS nt, max(CASE WHEN cond = 't' THEN hit_rate END) AS t_
  FROM substitutes GROUP BY subj)"""
ORACLES["substitute_paired"] = paired(
    with_ctes(SQL_TRIALS, SUBSTITUTES, SUBSTITUTES_WIDE), "substitutes_wide", "nt", "t_", alternative="greater"
)

FIRST_LAST_LINES = """first_last AS (
  SELECT l_returnflag, l_suppkey, avg(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS block1,
    avg(CASE WHEN l_linenumber = 7 THEN l_quantity END) AS block7
  FROM lineitem GROUP BY l_returnflag, l_suppkey)"""
ORACLES["paired_t"] = paired(with_ctes(FIRST_LAST_LINES), "first_last", "block1", "block7", "l_returnflag")

ORACLES["paired_effect_size"] = f"""{TO_CHANGE}, wide AS (
  SELECT subj, dim, max(CASE WHEN cond = 'nt' THEN diff END) - max(CASE WHEN cond = 'b' THEN diff END) AS d
  FROM change WHERE cond IN ('b', 'nt') GROUP BY subj, dim),
moments AS (SELECT dim, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM wide GROUP BY dim),
tests AS (SELECT *, m * sqrt(n) / s AS t, n - 1 AS df, CASE WHEN dim = 'aro' THEN -1 ELSE 1 END * m * sqrt(n) / s AS u FROM moments)
SELECT dim, n, {r6('t')} AS t, df, {r6('t / sqrt(n)')} AS dz, {r6(t_upper('u', 'df'))} AS p_directed FROM tests"""

ORACLES["t_cdf"] = f"""WITH s AS (
  SELECT l_suppkey, (avg(l_quantity) - 25) * sqrt(count(*)) / stddev_samp(l_quantity) AS t, count(*) - 1 AS df
  FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, {r6('t')} AS t, df, {r6(t_upper('(-t)', 'df'))} AS cdf, {r6(t_two_sided('t', 'df'))} AS p_value FROM s"""

ORACLES["f_cdf"] = f"""WITH s AS (
  SELECT l_suppkey, count(*) AS n, regr_r2(l_extendedprice, l_discount) AS r2 FROM lineitem GROUP BY l_suppkey),
e AS (SELECT l_suppkey, df1, n - df1 - 1 AS df2, (r2 / df1) / ((1 - r2) / (n - df1 - 1)) AS f
  FROM s CROSS JOIN (VALUES (1), (2), (3), (5)) v(df1))
SELECT l_suppkey, df1, df2, {r6('f')} AS f, {r6(f_upper('f', 'df1', 'df2'))} AS p_value FROM e"""

# Components: closed form for the three eigenvalues of a 3 x 3 correlation matrix -----------------


def three_components(source: str, a: str, b: str, c: str, key: str) -> str:
    """CTEs ``r_`` (correlations), ``eigen`` (key, k, ev) and ``vec`` (unit eigenvectors, signed)."""
    return f"""r_ AS (
  SELECT {key} AS g, corr({a}, {b}) AS ab, corr({a}, {c}) AS ac, corr({b}, {c}) AS bc,
    avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc,
    stddev_samp({a}) AS sa, stddev_samp({b}) AS sb, stddev_samp({c}) AS sc
  FROM {source} GROUP BY ALL),
shape AS (SELECT *, sqrt((ab * ab + ac * ac + bc * bc) / 3) AS p FROM r_),
angle AS (SELECT *, acos(least(1, greatest(-1, (ab * ac * bc) / (p * p * p)))) / 3 AS phi FROM shape),
eigen AS (
  SELECT *, k, 1 + 2 * p * cos(phi + CASE k WHEN 1 THEN 0 WHEN 3 THEN 2 * pi() / 3 ELSE 4 * pi() / 3 END) AS ev
  FROM angle CROSS JOIN (VALUES (1), (2), (3)) v(k)),
raw AS (
  SELECT *, ab * bc - ac * (1 - ev) AS v1, ac * ab - (1 - ev) * bc AS v2,
    (1 - ev) * (1 - ev) - ab * ab AS v3 FROM eigen),
vec AS (
  SELECT g, k, ev, ma, mb, mc, sa, sb, sc,
    v1 * s / norm AS w1, v2 * s / norm AS w2, v3 * s / norm AS w3
  FROM (SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS norm,
      CASE WHEN abs(v1) >= abs(v2) AND abs(v1) >= abs(v3) THEN sign(v1)
        WHEN abs(v2) >= abs(v3) THEN sign(v2) ELSE sign(v3) END AS s FROM raw))"""


LINE_COMPONENTS = three_components("lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
ORACLES["pca_importance"] = f"""WITH {LINE_COMPONENTS}
SELECT g AS l_returnflag, k AS component, {r6('sqrt(ev)')} AS sdev, {r6('ev / 3')} AS proportion,
  {r6('sum(ev) OVER (PARTITION BY g ORDER BY k) / 3')} AS cumulative FROM eigen"""

COMPLETE_SCORES = "(SELECT * FROM scores WHERE bdi IS NOT NULL AND rrs IS NOT NULL AND stais IS NOT NULL)"
SCORE_COMPONENTS = three_components(COMPLETE_SCORES, "bdi", "rrs", "stais", "1")
TO_COMPONENTS = with_ctes(SQL_ITEMS, SCORES, SCORE_COMPONENTS)
ORACLES["pca_loadings"] = f"""{TO_COMPONENTS}
SELECT k AS component, {r6('sqrt(ev)')} AS sdev, variable, {r6('loading')} AS loading, {r6('loading * sqrt(ev)')} AS arrow
FROM (SELECT k, ev, 'bdi' AS variable, w1 AS loading FROM vec UNION ALL SELECT k, ev, 'rrs', w2 FROM vec
  UNION ALL SELECT k, ev, 'stais', w3 FROM vec)"""

PROJECTED = """projected AS (
  SELECT s.subj, s.bdi, s.rrs, s.stais, v.k, v.ev,
    (s.bdi - ma) / sa * w1 + (s.rrs - mb) / sb * w2 + (s.stais - mc) / sc * w3 AS score
  FROM scores s CROSS JOIN vec v WHERE s.bdi IS NOT NULL AND s.rrs IS NOT NULL AND s.stais IS NOT NULL)"""
ORACLES["pca_scores"] = f"""{TO_COMPONENTS}, {PROJECTED}
SELECT subj, bdi, rrs, stais, {r6('max(CASE WHEN k = 1 THEN score END)')} AS pc1,
  {r6('max(CASE WHEN k = 2 THEN score END)')} AS pc2 FROM projected GROUP BY subj, bdi, rrs, stais"""
ORACLES["pca_biplot"] = f"""{TO_COMPONENTS}, {PROJECTED}
SELECT subj, {r6('max(CASE WHEN k = 1 THEN score / sqrt(ev) END)')} AS pc1,
  {r6('max(CASE WHEN k = 2 THEN score / sqrt(ev) END)')} AS pc2 FROM projected GROUP BY subj"""

ORACLES["pca_reconstruct"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, {r6('1e0' if a == b else f'corr({a}, {b})')} AS r FROM lineitem GROUP BY l_returnflag"
    for i, a in enumerate(LINE_COLUMNS)
    for b in LINE_COLUMNS[i:]
)

# Regression: two predictors in closed form -------------------------------------------------------


def two_predictors(name: str, source: str, key: str, y: str, a: str, b: str) -> str:
    """CTE with slopes, intercept, residual sum of squares and coefficient variances per key."""
    return f"""{name}_m AS (
  SELECT {key}, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_samp({y}) * (count(*) - 1) AS syy,
    var_samp({a}) * (count(*) - 1) AS saa, var_samp({b}) * (count(*) - 1) AS sbb,
    covar_samp({a}, {b}) * (count(*) - 1) AS sab, covar_samp({a}, {y}) * (count(*) - 1) AS say,
    covar_samp({b}, {y}) * (count(*) - 1) AS sby
  FROM {source} GROUP BY {key}),
{name}_b AS (
  SELECT *, saa * sbb - sab * sab AS det, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM {name}_m),
{name} AS (
  SELECT *, my - ba * ma - bb * mb AS b0, syy - ba * say - bb * sby AS rss,
    sbb / det AS va, saa / det AS vb, -sab / det AS vab,
    1e0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det AS v0 FROM {name}_b)"""


def coefficient_rows(name: str, keys: str, df: str, terms: list[tuple[str, str, str]]) -> str:
    """Long table of (term, estimate, unscaled variance) with statistics."""
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{t}' AS term, {est} AS estimate, sqrt(rss / ({df}) * ({var})) AS std_error, {df} AS df FROM {name} WHERE {df} > 0"
        for t, est, var in terms
    )
    return f"""coefs AS ({rows}), tests AS (SELECT *, estimate / std_error AS t FROM coefs)"""


COEFFICIENT_COLUMNS = (
    f"l_returnflag, term, {r6('estimate')} AS estimate, {r6('std_error')} AS std_error, df, {r6('t')} AS statistic, "
    f"{r6(t_two_sided('t', 'df'))} AS p_value"
)
TWO = two_predictors("two", "lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount")
TWO_TERMS = [("(Intercept)", "b0", "v0"), ("quantity", "ba", "va"), ("discount", "bb", "vb")]
TWO_COEFFICIENTS = f"WITH {TWO}, {coefficient_rows('two', 'l_returnflag', 'n - 3', TWO_TERMS)}"

ORACLES["ols_two_predictors"] = f"{TWO_COEFFICIENTS} SELECT {COEFFICIENT_COLUMNS} FROM tests"

ORACLES["ols_nested_models"] = f"""{TWO_COEFFICIENTS}
SELECT l_returnflag, term, {r6('estimate')} AS estimate, 'two' AS model FROM tests
UNION ALL SELECT l_returnflag, '(Intercept)', {r6('regr_intercept(l_extendedprice, l_quantity)')}, 'one' FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, 'quantity', {r6('regr_slope(l_extendedprice, l_quantity)')}, 'one' FROM lineitem GROUP BY l_returnflag"""

# Fixed value: normal quantile at .975; the expansion in 1/df is exact to rounding at these df.
Z975 = "1.959963984540054e0"
T975 = f"""({Z975} + (pow({Z975}, 3) + {Z975}) / (4 * df) + (5 * pow({Z975}, 5) + 16 * pow({Z975}, 3) + 3 * {Z975}) / (96 * pow(df, 2))
  + (3 * pow({Z975}, 7) + 19 * pow({Z975}, 5) + 17 * pow({Z975}, 3) - 15 * {Z975}) / (384 * pow(df, 3)))"""
ORACLES["ols_ci"] = f"""{TWO_COEFFICIENTS} SELECT l_returnflag, term, {r6('estimate')} AS estimate,
  {r6(f'estimate - std_error * {T975}')} AS ci_t_low, {r6(f'estimate + std_error * {T975}')} AS ci_t_high,
  {r6('estimate - 1.96e0 * std_error')} AS ci_z_low, {r6('estimate + 1.96e0 * std_error')} AS ci_z_high FROM tests"""



def p_text(p: str) -> str:
    three = f"substr(printf('%.3f', {p}), 2)"
    return f"CASE WHEN {p} < 0.001 THEN '_p_ < .001' WHEN printf('%.3f', {p}) = '1.000' THEN '_p_ > .999' ELSE '_p_ = ' || {three} END"


ORACLES["ols_sentences"] = f"""{TWO_COEFFICIENTS}, sds AS (SELECT l_returnflag AS g, stddev_samp(l_extendedprice) AS sdy,
  stddev_samp(l_quantity) AS sda, stddev_samp(l_discount) AS sdb FROM lineitem GROUP BY l_returnflag),
full_ AS (SELECT *, {t_two_sided('t', 'df')} AS p,
  CASE term WHEN 'quantity' THEN estimate * sda / sdy WHEN 'discount' THEN estimate * sdb / sdy END AS beta FROM tests JOIN sds ON g = l_returnflag)
SELECT l_returnflag, term, CASE WHEN beta IS NOT NULL THEN printf('_B_ = %.2f, 95%% CI [%.2f, %.2f], $\\beta$ = %.2f, %s',
  estimate, estimate - std_error * {T975}, estimate + std_error * {T975}, beta, {p_text('p')}) END AS report FROM full_"""

ORACLES["ols_fit_sentences"] = f"""WITH {TWO}, f_ AS (
  SELECT l_returnflag, 1 - (rss / (n - 3)) / (syy / (n - 1)) AS r, 2 AS k, n - 3 AS d2, ((syy - rss) / 2) / (rss / (n - 3)) AS f FROM two),
full_ AS (SELECT *, {f_upper('f', 'k', 'd2')} AS p FROM f_)
SELECT l_returnflag, printf('$R^2_{{adj}}$ = %.2f, _F_(%d, %d) = %.2f, %s', r, k, d2, f, {p_text('p')}) AS report FROM full_"""

ORACLES["ols_fit_stats"] = f"""WITH {TWO}, f_ AS (
  SELECT l_returnflag, n, syy, rss, 2 AS k, n - 3 AS d2, ((syy - rss) / 2) / (rss / (n - 3)) AS f FROM two)
SELECT l_returnflag, n, {r6('1 - rss / syy')} AS r_squared, {r6('1 - (rss / (n - 3)) / (syy / (n - 1))')} AS adj_r_squared,
  {r6('f')} AS f_value, CAST(2 AS BIGINT) AS df_model, d2 AS df_resid, {r6(f_upper('f', 'k', 'd2'))} AS p_value FROM f_"""

HOLM_TERMS = f"""with_p AS (SELECT *, {t_two_sided('t', 'df')} AS p FROM tests),
stepped AS (SELECT *, (count(*) OVER (PARTITION BY {{by}}) - row_number() OVER (PARTITION BY {{by}} ORDER BY p) + 1) * p AS v FROM with_p),
adjusted AS (SELECT *, least(1, max(v) OVER (PARTITION BY {{by}} ORDER BY p ROWS UNBOUNDED PRECEDING)) AS p_adj FROM stepped)"""


def p_cell(p: str) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.001 THEN '< .001' WHEN {p} > 0.999 THEN '> .999' "
        f"ELSE substr(printf('%.3f', {p}), 2) END"
    )


TWO_SDS = "SELECT l_returnflag AS g, stddev_samp(l_extendedprice) AS sdy, stddev_samp(l_quantity) AS sda, stddev_samp(l_discount) AS sdb FROM lineitem GROUP BY l_returnflag"
ORACLES["ols_report"] = f"""{TWO_COEFFICIENTS}, {HOLM_TERMS.format(by='l_returnflag')}, sds AS ({TWO_SDS})
SELECT l_returnflag, term, round_even(estimate, 2) + 0e0 AS estimate,
  printf('[%.2f,%.2f]', estimate - 1.96e0 * std_error, estimate + 1.96e0 * std_error) AS ci,
  round_even(CASE term WHEN 'quantity' THEN estimate * sda / sdy WHEN 'discount' THEN estimate * sdb / sdy END, 2) + 0e0 AS beta,
  {p_cell('p')} AS p_value, {p_cell('p_adj')} AS p_adj FROM adjusted JOIN sds ON g = l_returnflag"""

TWO_SCALED = two_predictors("two", "lineitem", "l_returnflag", "(l_extendedprice / 1000)", "l_quantity", "l_discount")
ORACLES["loocv_press"] = f"""WITH {TWO_SCALED}, left_out AS (
  SELECT l.l_returnflag, (l_extendedprice / 1000 - b0 - ba * l_quantity - bb * l_discount) / (1 - (1e0 / n + va * pow(l_quantity - ma, 2)
    + vb * pow(l_discount - mb, 2) + 2 * vab * (l_quantity - ma) * (l_discount - mb))) AS e
  FROM lineitem l JOIN two ON l.l_returnflag = two.l_returnflag)
SELECT l_returnflag, count(*) AS n, {r6('avg(e * e)')} AS loo_mse FROM left_out GROUP BY l_returnflag"""

# The two nearly equal columns span what quantity and discount span: fit those, which are far apart, and turn the slopes.
TURNED = two_predictors("two", "(SELECT *, round(l_discount * 100) / 1048576e0 AS bit FROM lineitem)", "l_returnflag", "(l_extendedprice / 1000)", "l_quantity", "bit")
ORACLES["ols_near_dependent"] = f"""WITH {TURNED}, turned AS (
  SELECT *, rss / (n - 3) AS s2 FROM two), rows_ AS (
  SELECT l_returnflag, 'shifted' AS term, bb AS b, sqrt(s2 * vb) AS se, n, rss, syy FROM turned
  UNION ALL SELECT l_returnflag, 'quantity', ba - bb, sqrt(s2 * (va + vb - 2 * vab)), n, rss, syy FROM turned)
SELECT l_returnflag, term, {r6('b / 1048576')} AS estimate, {r6('se / 1048576')} AS std_error, {r6('b / se')} AS statistic,
  {r6('1 - rss / syy')} AS r_squared, {r6('((syy - rss) / 2) / (rss / (n - 3))')} AS f_value FROM rows_"""
ORACLES["loocv_near_dependent"] = ORACLES["loocv_press"]

ORACLES["leave_one_out_missing_group"] = f"""SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS grp, n, loo_mse
FROM ({ORACLES["loocv_press"]})"""

# Regression with a two-level factor: step 2 is two separate fits, step 1 pools within the levels --



def step2_from(by: str, level: str, first: str, second: str) -> str:
    """CTE ``step2`` from the CTE ``fit`` of separate fits per level of the factor."""
    return f"""step2 AS (
  SELECT f.{by}, f.n + o.n AS n, f.rss + o.rss AS rss,
    (f.b0 + o.b0) / 2 AS c0, o.b0 - f.b0 AS c1, (f.ba + o.ba) / 2 AS c2, (f.bb + o.bb) / 2 AS c3, o.ba - f.ba AS c4, o.bb - f.bb AS c5,
    f.v0 + o.v0 AS u0, f.va + o.va AS ua, f.vb + o.vb AS ub,
    f.ba AS slope_f, o.ba AS slope_o, f.va AS var_f, o.va AS var_o, f.n AS n_f, o.n AS n_o
  FROM fit f JOIN fit o ON f.{by} = o.{by} AND f.{level} = '{first}' AND o.{level} = '{second}')"""


BY_STATUS = two_predictors("fit", "lineitem", "l_returnflag, l_linestatus", "l_extendedprice", "l_quantity", "l_discount")
STEP2 = f"{BY_STATUS}, {step2_from('l_returnflag', 'l_linestatus', 'F', 'O')}"
STEP2_TERMS = [
    ("(Intercept)", "c0", "u0 / 4"),
    ("group1", "c1", "u0"),
    ("quantity", "c2", "ua / 4"),
    ("discount", "c3", "ub / 4"),
    ("group1:quantity", "c4", "ua"),
    ("group1:discount", "c5", "ub"),
]
STEP2_COEFFICIENTS = f"WITH {STEP2}, {coefficient_rows('step2', 'l_returnflag', 'n - 6', STEP2_TERMS)}"
ORACLES["ols_step2"] = f"{STEP2_COEFFICIENTS} SELECT {COEFFICIENT_COLUMNS} FROM tests"

ORACLES["ols_std_beta"] = f"""{STEP2_COEFFICIENTS}, sds AS ({TWO_SDS})
SELECT l_returnflag, term, {r6('''CASE term WHEN '(Intercept)' THEN NULL WHEN 'quantity' THEN estimate * sda / sdy
  WHEN 'discount' THEN estimate * sdb / sdy ELSE estimate END''')} AS beta,
  CASE WHEN term = '(Intercept)' THEN NULL WHEN term IN ('quantity', 'discount') THEN 'standardised' ELSE 'raw' END AS std_kind
FROM tests JOIN sds ON g = l_returnflag"""

def step1_from(by: str, level: str, first: str, second: str) -> str:
    """CTE ``step1`` from the CTE ``fit``: slopes pooled within the levels of the factor."""
    return f"""pooled AS (
  SELECT {by}, sum(n) AS n, sum(saa) AS saa, sum(sbb) AS sbb, sum(sab) AS sab, sum(say) AS say, sum(sby) AS sby, sum(syy) AS syy
  FROM fit GROUP BY {by}),
slopes AS (
  SELECT *, saa * sbb - sab * sab AS det, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM pooled),
step1 AS (
  SELECT p.{by}, CAST(p.n AS BIGINT) AS n, p.syy - p.ba * p.say - p.bb * p.sby AS rss, p.ba, p.bb, p.sbb / p.det AS va, p.saa / p.det AS vb,
    (f.my - p.ba * f.ma - p.bb * f.mb + o.my - p.ba * o.ma - p.bb * o.mb) / 2 AS c0,
    (o.my - p.ba * o.ma - p.bb * o.mb) - (f.my - p.ba * f.ma - p.bb * f.mb) AS c1,
    (1e0 / f.n + 1e0 / o.n) / 4 + (pow((f.ma + o.ma) / 2, 2) * p.sbb - 2 * (f.ma + o.ma) / 2 * (f.mb + o.mb) / 2 * p.sab
      + pow((f.mb + o.mb) / 2, 2) * p.saa) / p.det AS u0,
    (1e0 / f.n + 1e0 / o.n) + (pow(o.ma - f.ma, 2) * p.sbb - 2 * (o.ma - f.ma) * (o.mb - f.mb) * p.sab
      + pow(o.mb - f.mb, 2) * p.saa) / p.det AS u1
  FROM slopes p JOIN fit f ON f.{by} = p.{by} AND f.{level} = '{first}'
  JOIN fit o ON o.{by} = p.{by} AND o.{level} = '{second}')"""


STEP1 = step1_from('l_returnflag', 'l_linestatus', 'F', 'O')
STEP1_TERMS = [("(Intercept)", "c0", "u0"), ("group1", "c1", "u1"), ("quantity", "ba", "va"), ("discount", "bb", "vb")]
ORACLES["ols_step1"] = (
    f"WITH {BY_STATUS}, {STEP1}, {coefficient_rows('step1', 'l_returnflag', 'n - 4', STEP1_TERMS)} SELECT {COEFFICIENT_COLUMNS} FROM tests"
)


def _term_rows(name: str, df: str, terms: list[tuple[str, str, str]], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT l_returnflag, '{t}' AS term, {est} AS estimate, sqrt(rss / ({df}) * ({var})) AS std_error{extra} FROM {name}"
        for t, est, var in terms
    )


ORACLES["join_right_suffix"] = f"""WITH {STEP2}, {STEP1}, a AS ({_term_rows('step1', 'n - 4', STEP1_TERMS)}), b AS ({_term_rows('step2', 'n - 6', STEP2_TERMS)})
SELECT b.l_returnflag, b.term, {r6('a.estimate')} AS estimate_x, {r6('a.std_error')} AS std_error_x,
  {r6('b.estimate')} AS estimate_y, {r6('b.std_error')} AS std_error_y
FROM a RIGHT JOIN b ON a.l_returnflag = b.l_returnflag AND a.term = b.term"""

BOTH_STEPS = (
    f"coefs AS (SELECT 'step1' AS model, n - 4 AS df, * FROM ({_term_rows('step1', 'n - 4', STEP1_TERMS, ', n')}) "
    f"UNION ALL SELECT 'step2', n - 6, * FROM ({_term_rows('step2', 'n - 6', STEP2_TERMS, ', n')})), "
    "tests AS (SELECT *, estimate / std_error AS t FROM coefs)"
)
REPORT_CELLS = f"""cells AS (SELECT l_returnflag, model, term, round_even(estimate, 2) + 0e0 AS estimate,
    printf('[%.2f,%.2f]', estimate - 1.96e0 * std_error, estimate + 1.96e0 * std_error) AS ci,
    round_even(CASE term WHEN '(Intercept)' THEN NULL WHEN 'quantity' THEN estimate * sda / sdy
      WHEN 'discount' THEN estimate * sdb / sdy ELSE estimate END, 2) + 0e0 AS beta,
    {p_cell('p')} AS p_value, {p_cell('p_adj')} AS p_adj FROM adjusted JOIN sds ON g = l_returnflag)"""
ORACLES["step_tables"] = f"""WITH {STEP2}, {STEP1}, {BOTH_STEPS}, {HOLM_TERMS.format(by='l_returnflag, model')}, sds AS ({TWO_SDS}), {REPORT_CELLS}
SELECT b.l_returnflag, b.term, a.estimate AS estimate_x, a.ci AS ci_x, a.beta AS beta_x, a.p_value AS p_value_x, a.p_adj AS p_adj_x,
  b.estimate AS estimate_y, b.ci AS ci_y, b.beta AS beta_y, b.p_value AS p_value_y, b.p_adj AS p_adj_y
FROM (SELECT * FROM cells WHERE model = 'step1') a RIGHT JOIN (SELECT * FROM cells WHERE model = 'step2') b
  ON a.l_returnflag = b.l_returnflag AND a.term = b.term"""

ORACLES["join_tables_right"] = """SELECT e.l_suppkey, f.n AS n_x, e.n AS n_y
FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey) f
RIGHT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) e ON f.l_suppkey = e.l_suppkey"""

COMPARED = """compared AS (
  SELECT s2.l_returnflag, s1.rss AS rss1, s2.rss AS rss2, 2 AS k, s2.n - 6 AS d2, ((s1.rss - s2.rss) / 2) / (s2.rss / (s2.n - 6)) AS f
  FROM step1 s1 JOIN step2 s2 ON s1.l_returnflag = s2.l_returnflag)"""
ORACLES["ols_model_compare"] = f"""WITH {STEP2}, {STEP1}, {COMPARED}
SELECT l_returnflag, CAST(2 AS BIGINT) AS df_diff, d2 AS df_resid, {r6('f')} AS f_value, {r6(f_upper('f', 'k', 'd2'))} AS p_value FROM compared"""

ORACLES["ols_compare_sentences"] = f"""WITH {STEP2}, {STEP1}, {COMPARED}, full_ AS (SELECT *, {f_upper('f', 'k', 'd2')} AS p FROM compared)
SELECT l_returnflag, printf('_F_(%d, %d) = %.2f, %s', k, d2, f, {p_text('p')}) AS report FROM full_"""

SLOPE_ROWS = """coefs AS (
  SELECT l_returnflag, 'F' AS level, slope_f AS slope, sqrt(rss / (n - 6) * var_f) AS std_error, n - 6 AS df FROM step2
  UNION ALL SELECT l_returnflag, 'O', slope_o, sqrt(rss / (n - 6) * var_o), n - 6 FROM step2),
tests AS (SELECT *, slope / std_error AS t FROM coefs)"""
ORACLES["simple_slopes"] = f"""WITH {STEP2}, {SLOPE_ROWS}, {HOLM_TERMS.format(by='l_returnflag')}
SELECT l_returnflag, level, {r6('slope')} AS slope, {r6('std_error')} AS std_error, df, {r6('t')} AS t, {r6('p')} AS p_value,
  {r6('slope - 1.96e0 * std_error')} AS ci_z_low, {r6('slope + 1.96e0 * std_error')} AS ci_z_high, {r6('p_adj')} AS p_adj FROM adjusted"""

ORACLES["simple_slope_sentences"] = f"""WITH {STEP2}, {SLOPE_ROWS}, with_p AS (SELECT *, {t_two_sided('t', 'df')} AS p FROM tests)
SELECT l_returnflag, level, printf('B = %.2f, 95%% CI [%.2f, %.2f], %s', slope, slope - 1.96e0 * std_error,
  slope + 1.96e0 * std_error, {p_text('p')}) AS report FROM with_p"""

ORACLES["simple_slopes_sd"] = f"""WITH {STEP2}, points AS (
  SELECT *, CASE side WHEN 'low' THEN m - s ELSE m + s END AS pt FROM (
    SELECT *, (n_o - n_f) / (2e0 * n) AS m, sqrt(n_f * (n_o / CAST(n AS DOUBLE)) / (n - 1)) AS s FROM step2) CROSS JOIN (VALUES ('low'), ('high')) v(side))
SELECT l_returnflag, side AS level, {r6('pt')} AS "at", {r6('(0.5 - pt) * slope_f + (0.5 + pt) * slope_o')} AS slope,
  {r6('sqrt(rss / (n - 6) * (pow(0.5 - pt, 2) * var_f + pow(0.5 + pt, 2) * var_o))')} AS std_error FROM points"""

ORACLES["model_compare_table"] = f"""WITH {STEP2}, {STEP1}, {COMPARED},
total AS (SELECT l_returnflag AS g, var_samp(l_extendedprice) * (count(*) - 1) AS tss, count(*) AS n FROM lineitem GROUP BY l_returnflag),
stats AS (
  SELECT l_returnflag, 1 - (rss1 / (n - 4)) / (tss / (n - 1)) AS r1, 1 - (rss2 / (n - 6)) / (tss / (n - 1)) AS r2,
    3 AS k1, n - 4 AS e1, ((tss - rss1) / 3) / (rss1 / (n - 4)) AS f1, 5 AS k2, n - 6 AS e2, ((tss - rss2) / 5) / (rss2 / (n - 6)) AS f2,
    k, d2, f
  FROM compared JOIN total ON g = l_returnflag)
SELECT l_returnflag, 'adj' AS type2, {r6('r1')} AS r_1, {r6('r2')} AS r_2, {r6(f_upper('f1', 'k1', 'e1'))} AS p_1, {r6(f_upper('f2', 'k2', 'e2'))} AS p_2 FROM stats
UNION ALL
SELECT l_returnflag, 'diff', NULL, {r6('r2 - r1')}, {r6(f_upper('f', 'k', 'd2'))}, {r6(f_upper('f', 'k', 'd2'))} FROM stats"""

# Components into a regression: slopes on orthogonal scores of three instruments ------------------

SUBJECTS = """scores_all AS (SELECT * FROM scores),
subjects AS (
  SELECT s.*, d.aro, d.val, CASE WHEN s.subj % 2 = 0 THEN 'ds' ELSE 'ts' END AS expt
  FROM scores_all s JOIN differences d ON s.subj = d.subj
  WHERE bdi IS NOT NULL AND rrs IS NOT NULL AND stais IS NOT NULL AND stait IS NOT NULL AND d.aro IS NOT NULL AND d.val IS NOT NULL)"""
SUBJECT_COMPONENTS = three_components("subjects", "bdi", "rrs", "stais", "expt")
SCORED = """scored AS (
  SELECT s.subj, s.expt, s.val, s.aro,
    max(CASE WHEN k = 1 THEN (bdi - ma) / sa * w1 + (rrs - mb) / sb * w2 + (stais - mc) / sc * w3 END) AS pc1,
    max(CASE WHEN k = 2 THEN (bdi - ma) / sa * w1 + (rrs - mb) / sb * w2 + (stais - mc) / sc * w3 END) AS pc2
  FROM subjects s JOIN vec v ON v.g = s.expt GROUP BY s.subj, s.expt, s.val, s.aro),
long AS (SELECT expt, 'val' AS vars, val AS value, pc1, pc2 FROM scored UNION ALL SELECT expt, 'aro', aro, pc1, pc2 FROM scored)"""
ORACLES["pca_regression"] = f"""{TO_DIFFERENCES}, {SUBJECTS}, {SUBJECT_COMPONENTS}, {SCORED},
{two_predictors('two', 'long', 'expt, vars', 'value', 'pc1', 'pc2')},
{coefficient_rows('two', 'expt, vars', 'n - 3', [('(Intercept)', 'b0', 'v0'), ('pc1', 'ba', 'va'), ('pc2', 'bb', 'vb')])}
SELECT expt, vars, term, {r6('estimate')} AS estimate, {r6('std_error')} AS std_error FROM tests"""

SCORED_TOGETHER = SCORED.replace("v.g = s.expt", "v.g = 1")
MODERATED = f"""{TO_DIFFERENCES}, {SUBJECTS}, {three_components('subjects', 'bdi', 'rrs', 'stais', '1')}, {SCORED_TOGETHER},
{two_predictors('fit', 'long', 'vars, expt', 'value', 'pc1', 'pc2')}, {step2_from('vars', 'expt', 'ds', 'ts')}"""
MODERATED_TERMS = [(t.replace("quantity", "pc1").replace("discount", "pc2"), est, var) for t, est, var in STEP2_TERMS]
ORACLES["moderated_coefficients"] = f"""{MODERATED}, {coefficient_rows('step2', 'vars', 'n - 6', MODERATED_TERMS)},
{HOLM_TERMS.format(by='vars')}
SELECT vars, term, {r6('estimate')} AS estimate, {r6('std_error')} AS std_error, {r6('p')} AS p_value, {r6('p_adj')} AS p_adj FROM adjusted"""

ORACLES["moderated_compare"] = f"""{MODERATED}, {step1_from('vars', 'expt', 'ds', 'ts')}, {COMPARED.replace('l_returnflag', 'vars')}
SELECT vars, CAST(2 AS BIGINT) AS df_diff, d2 AS df_resid, {r6('f')} AS f_value, {r6(f_upper('f', 'k', 'd2'))} AS p_value FROM compared"""

# Components of four columns: a matrix squared again and again tends to the outer product of its first eigenvector ---

FOUR_COLUMNS = ("bdi", "rrs", "stais", "stait")


def first_vector(name: str, matrix: str) -> str:
    """CTE ``name`` (l, v): largest eigenvalue and its unit vector, largest entry positive, of a 4 x 4 matrix as a list."""
    trace = "(c[1] + c[6] + c[11] + c[16])"
    squared = f"list_transform(range(16), lambda i: list_sum(list_transform(range(4), lambda j: c[4 * (i // 4) + j + 1] * c[4 * j + i % 4 + 1])) / ({trace} * {trace}))"
    column = "list_transform(range(4), lambda i: c[4 * i + (b % 4) + 1])"
    return f"""{name}_p AS (SELECT 0 AS k, c FROM {matrix} UNION ALL SELECT k + 1, {squared} FROM {name}_p WHERE k < 16),
{name}_b AS (SELECT c, CASE greatest(c[1], c[6], c[11], c[16]) WHEN c[1] THEN 0 WHEN c[6] THEN 1 WHEN c[11] THEN 2 ELSE 3 END AS b FROM {name}_p WHERE k = 16),
{name}_c AS (SELECT {column} AS w FROM {name}_b),
{name}_v AS (SELECT list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM {name}_c),
{name} AS (SELECT v, list_sum(list_transform(range(16), lambda i: v[i // 4 + 1] * m.c[i + 1] * v[i % 4 + 1])) AS l FROM {name}_v, {matrix} m)"""


def _four_scores(vector: str) -> str:
    return " + ".join(f"({c} - m{i}) / s{i} * {vector}.v[{i}]" for i, c in enumerate(FOUR_COLUMNS, start=1))


FOUR_CELLS = ", ".join("1e0" if a == b else f"corr({a}, {b})" for a in FOUR_COLUMNS for b in FOUR_COLUMNS)
FOUR_MOMENTS = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(FOUR_COLUMNS, start=1))
FOUR = f"""r4 AS (SELECT {FOUR_MOMENTS}, [{FOUR_CELLS}] AS c FROM subjects), {first_vector('v1', 'r4')},
r4_left AS (SELECT list_transform(range(16), lambda i: c[i + 1] - l * v[i // 4 + 1] * v[i % 4 + 1]) AS c FROM r4, v1), {first_vector('v2', 'r4_left')},
scored AS (SELECT subj, expt, val, aro, {_four_scores('v1')} AS pc1, {_four_scores('v2')} AS pc2 FROM subjects, r4, v1, v2),
long AS (SELECT expt, 'val' AS vars, val AS value, pc1, pc2 FROM scored UNION ALL SELECT expt, 'aro', aro, pc1, pc2 FROM scored)"""
MODERATED_FOUR = f"""{TO_DIFFERENCES}, {SUBJECTS}, {FOUR},
{two_predictors('fit', 'long', 'vars, expt', 'value', 'pc1', 'pc2')}, {step2_from('vars', 'expt', 'ds', 'ts')}""".replace("WITH", "WITH RECURSIVE", 1)
MODERATED_ORDER = " ".join(f"WHEN '{t}' THEN {i}" for i, (t, _, _) in enumerate(MODERATED_TERMS))
# Fixed value: the expansion's next term, which counts at the few degrees of freedom of subjects.
T975_FEW = f"({T975} + (79 * pow({Z975}, 9) + 776 * pow({Z975}, 7) + 1482 * pow({Z975}, 5) - 1920 * pow({Z975}, 3) - 945 * {Z975}) / (92160 * pow(df, 4)))"
ORACLES["moderated_regression"] = f"""{MODERATED_FOUR}, {coefficient_rows('step2', 'vars', 'n - 6', MODERATED_TERMS)},
{HOLM_TERMS.format(by='vars')},
sds AS (SELECT vars AS g, stddev_samp(value) AS sdy, stddev_samp(pc1) AS sda, stddev_samp(pc2) AS sdb FROM long GROUP BY vars)
SELECT vars, CASE term {MODERATED_ORDER} END AS term_index, term, {r6('estimate')} AS estimate, {r6('std_error')} AS std_error, df,
  {r6("CASE term WHEN '(Intercept)' THEN NULL WHEN 'pc1' THEN estimate * sda / sdy WHEN 'pc2' THEN estimate * sdb / sdy ELSE estimate END")} AS beta,
  CASE WHEN term = '(Intercept)' THEN NULL WHEN term IN ('pc1', 'pc2') THEN 'standardised' ELSE 'raw' END AS std_kind,
  {r6('t')} AS statistic, {r6('p')} AS p_value,
  {r6(f'estimate - std_error * {T975_FEW}')} AS ci_t_low, {r6(f'estimate + std_error * {T975_FEW}')} AS ci_t_high,
  {r6('estimate - 1.96e0 * std_error')} AS ci_z_low, {r6('estimate + 1.96e0 * std_error')} AS ci_z_high, {r6('p_adj')} AS p_adj
FROM adjusted JOIN sds ON g = vars"""

ORACLES["moderated_model_table"] = f"""{MODERATED_FOUR}, {step1_from('vars', 'expt', 'ds', 'ts')}, {COMPARED.replace('l_returnflag', 'vars')},
total AS (SELECT vars AS g, var_samp(value) * (count(*) - 1) AS tss, count(*) AS n FROM long GROUP BY vars),
stats AS (
  SELECT vars, 1 - (rss1 / (n - 4)) / (tss / (n - 1)) AS r1, 1 - (rss2 / (n - 6)) / (tss / (n - 1)) AS r2,
    3 AS k1, n - 4 AS e1, ((tss - rss1) / 3) / (rss1 / (n - 4)) AS f1, 5 AS k2, n - 6 AS e2, ((tss - rss2) / 5) / (rss2 / (n - 6)) AS f2, k, d2, f
  FROM compared JOIN total ON g = vars),
tails AS (SELECT *, {f_upper('f1', 'k1', 'e1')} AS p1, {f_upper('f2', 'k2', 'e2')} AS p2, {f_upper('f', 'k', 'd2')} AS p FROM stats)
SELECT vars, 'adj' AS type2, {r6('r1')} AS r_1, {r6('r2')} AS r_2, {p_cell('p1')} AS p_1, {p_cell('p2')} AS p_2 FROM tails
UNION ALL SELECT vars, 'diff', NULL, {r6('r2 - r1')}, {p_cell('p')}, {p_cell('p')} FROM tails"""

# Limits of the effect size: the chance of a smaller t is the integral, over larger noncentralities, of the
# chi-weighted normal density; summed on a grid, and solved between two of its points by the series of the integral ---

GRID, NODES = 4000, 240
ORACLES["paired_report"] = f"""{with_ctes(FIRST_LAST_LINES)}, moments AS (
  SELECT l_returnflag, count(block1 - block7) AS n, avg(block1 - block7) AS m, stddev_samp(block1 - block7) AS s FROM first_last GROUP BY l_returnflag),
tests AS (SELECT *, m * sqrt(n) / s AS t, n - 1 AS df, m / s AS dz FROM moments),
sized AS (SELECT *, sqrt(1 + t * t / (2 * df)) * 16 / {GRID} AS h, greatest(1e-9, 1 - 10 / sqrt(2e0 * df)) AS lo, 1 + 10 / sqrt(2e0 * df) AS hi FROM tests),
nodes AS (
  SELECT l_returnflag, lo + (hi - lo) * j / {NODES} AS y, exp((df - 1) * ln(lo + (hi - lo) * j / {NODES}) - df * (pow(lo + (hi - lo) * j / {NODES}, 2) - 1) / 2) AS w
  FROM sized, range({NODES} + 1) r(j)),
weights AS (SELECT l_returnflag, list(y) AS ys, list(w / total) AS ws FROM (SELECT *, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM nodes) GROUP BY l_returnflag),
grid AS (
  SELECT l_returnflag, k, h, t + h * (k - {GRID} / 2) AS x,
    list_sum(list_transform(range(1, {NODES} + 2), lambda i: ws[i] * exp(-pow(t * ys[i] - (t + h * (k - {GRID} / 2)), 2) / 2))) / sqrt(2 * pi()) AS g
  FROM sized JOIN weights USING (l_returnflag), range({GRID} + 1) r(k)),
summed AS (
  SELECT *, h * (sum(g) OVER (PARTITION BY l_returnflag ORDER BY k DESC) - g / 2) AS area,
    (lead(g) OVER (PARTITION BY l_returnflag ORDER BY k) - lag(g) OVER (PARTITION BY l_returnflag ORDER BY k)) / (2 * h) AS slope FROM grid),
chances AS (SELECT *, area + h * h / 12 * slope AS above FROM summed),
found AS (
  SELECT l_returnflag, target, arg_max(x, k) AS x, arg_max(g, k) AS g, arg_max(slope, k) AS slope, arg_max(above, k) - target AS e
  FROM chances, (VALUES (0.975e0), (0.025e0)) v(target) WHERE above >= target GROUP BY l_returnflag, target),
limits AS (SELECT l_returnflag, target, x + e / g - slope / (2 * g) * pow(e / g, 2) AS d FROM found),
full_ AS (
  SELECT q.*, {t_two_sided('t', 'df')} AS p, a.d / sqrt(n) AS dz_low, b.d / sqrt(n) AS dz_high
  FROM tests q JOIN limits a ON a.l_returnflag = q.l_returnflag AND a.target > 0.5 JOIN limits b ON b.l_returnflag = q.l_returnflag AND b.target < 0.5)
SELECT l_returnflag, n, {r6('m')} AS mean_diff, {r6('s')} AS sd_diff, {r6('t')} AS t, df, {r6('dz')} AS dz, {r6('p')} AS p_value,
  {r6('dz_low')} AS dz_low, {r6('dz_high')} AS dz_high,
  printf('_t_(%d) = %.2f, %s, _dz_ = %.2f, 95%% CI [%.2f, %.2f]', df, t, {p_text('p')}, dz, dz_low, dz_high) AS report FROM full_"""

LEVEL_LINES = """WITH slopes AS (SELECT l_returnflag AS f, regr_intercept(l_extendedprice / 1000, l_quantity) AS a,
  regr_slope(l_extendedprice / 1000, l_quantity) AS b FROM lineitem GROUP BY f),
l AS (SELECT max(CASE f WHEN 'A' THEN a END) AS a1, max(CASE f WHEN 'N' THEN a END) AS a2, max(CASE f WHEN 'R' THEN a END) AS a3,
  max(CASE f WHEN 'A' THEN b END) AS b1, max(CASE f WHEN 'N' THEN b END) AS b2, max(CASE f WHEN 'R' THEN b END) AS b3 FROM slopes)"""


def level_terms(terms: dict[str, str], beta: bool = False) -> str:
    """A row per term of a model by levels, from each level's own line; no term has a standardised slope."""
    rows = [
        f"SELECT {i} AS term_index, '{t}' AS term, {r6(c)} AS estimate" + (f", {r6(c) if i else 'NULL::DOUBLE'} AS beta" if beta else "") + " FROM l"
        for i, (t, c) in enumerate(terms.items())
    ]
    return f"{LEVEL_LINES} " + " UNION ALL ".join(rows)


ORACLES["formula_three_levels"] = level_terms(
    {"(Intercept)": "a1", "flagN": "a2 - a1", "flagR": "a3 - a1", "quantity": "b1", "flagN:quantity": "b2 - b1", "flagR:quantity": "b3 - b1"}
)
MEAN_A, MEAN_B = "(a1 + a2 + a3) / 3", "(b1 + b2 + b3) / 3"
ORACLES["formula_sum_coding"] = level_terms(
    {
        "(Intercept)": MEAN_A,
        "flag1": f"a1 - {MEAN_A}",
        "flag2": f"a2 - {MEAN_A}",
        "quantity": MEAN_B,
        "flag1:quantity": f"b1 - {MEAN_B}",
        "flag2:quantity": f"b2 - {MEAN_B}",
    }
)
ORACLES["formula_no_margin"] = level_terms(
    {"(Intercept)": "a1", "flagN": "a2 - a1", "flagR": "a3 - a1", "flagA:quantity": "b1", "flagN:quantity": "b2", "flagR:quantity": "b3"}, beta=True
)

STATE_VALUES = {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice / 1000"}
ORACLES["state_summary"] = "SELECT l_suppkey, count(*) AS n, " + ", ".join(
    f"{r6(f'avg({c})')} AS {n}_mean, {r6(f'stddev_samp({c})')} AS {n}_sd, {r6(f'stddev_samp({c}) / sqrt(count(*))')} AS {n}_se"
    for n, c in STATE_VALUES.items()
) + " FROM lineitem GROUP BY l_suppkey"
ORACLES["state_regression"] = f"""WITH s AS (SELECT l_suppkey, count(*) - 2 AS df, regr_intercept(l_extendedprice / 1000, l_quantity) AS a,
  regr_slope(l_extendedprice / 1000, l_quantity) AS b FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, '(Intercept)' AS term, {r6('a')} AS estimate, df FROM s UNION ALL SELECT l_suppkey, 'quantity', {r6('b')}, df FROM s"""
