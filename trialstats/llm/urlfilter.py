"""URL filters by rules, and by gradient-boosted trees on lexical features where no rule speaks. DataFrame functions only.

A rule is a host and the beginning of a path; it fits its host and all subdomains. The longest rule that fits tells the
verdict (ties: the longer host). URLs that a rule fits are the labelled URLs: trees learn from them what blocked URLs look
like, and judge the others.

Features are counts, shares and the entropy of a URL's characters, and what the labelled URLs of its suffix (the host's
last label) were: the smoothed share of blocked ones. For training, that share comes from the other half of the rows, so no
row tells its own label. Features are cut at quantiles; each level of a tree is one aggregate of gradients per node,
feature and cut, over the distinct rows of cut features with their counts. Gradients are whole numbers (millionths), so
sums don't depend on the order of rows. The driver sees histograms only: nodes x features x cuts.

Bounds that are parameters: SAMPLE labelled URLs for training, chosen by hash of the URL (suffix shares count all);
RULES rules, which travel in the plan.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule fits it, and it is judged by its
features (a null one as an empty text). Without labelled URLs of both kinds, the verdict is theirs, or ``allow``. Repeated
rows: one result per row. An empty table gives no rows. Very long URLs are read whole. Other columns are only carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

RULES = 1_000
SAMPLE = 200_000
CUTS = 15
TREES, DEPTH, RATE, DAMPING = 10, 3, 0.4, 1.0
UNIT = 1_000_000
BROADCAST_BYTES = 32 << 20
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "labels", "hyphens", "host_digits", "depth", "path_length", "digits", "letters", "entropy", "parameters", "fragment", "secure", "suffix_share", "suffix_count"]


def host_of(url: str) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest of ``rules`` = (verdict, host, path) that fits; null if none does."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; a plan holds at most {RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def _entropy(text: Column) -> Column:
    """Bits per character: equal characters are neighbours once sorted, and are counted in one walk."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    bits = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    step = lambda s, c: F.struct(
        c.alias("last"),
        F.when(c == s["last"], s["run"] + 1).otherwise(1.0).alias("run"),
        F.when(c == s["last"], s["sum"]).otherwise(s["sum"] + bits(s["run"])).alias("sum"),
    )
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda s: s["sum"] + bits(s["run"]))
    size = F.length(text)
    return F.when(size > 0, F.log2(size) - total / size).otherwise(0.0)


def with_features(pages: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``pages`` with all features but the suffix's, and ``suffix``."""
    text, query = F.coalesce(F.col(url), F.lit("")), F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^[^?#]*\\?([^#]*)", 1)
    said = {
        "length": F.length(text),
        "host_length": F.length(host),
        "labels": F.size(F.split(host, "\\.")),
        "hyphens": _count(F.col(host), "-"),
        "host_digits": _share(_count(F.col(host), "0-9"), F.length(host)),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "path_length": F.length(path),
        "digits": _share(_count(text, "0-9"), F.length(text)),
        "letters": _share(_count(text, "A-Za-z"), F.length(text)),
        "entropy": _entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "fragment": F.contains(text, F.lit("#")).cast("int"),
        "secure": F.startswith(text, F.lit("https:")).cast("int"),
    }
    return pages.withColumns({k: v.cast("double") for k, v in said.items()} | {"suffix": F.substring_index(host, ".", -1)})


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Per suffix: labelled and blocked URLs of each half (by hash of the URL), all rows counted."""
    sums = [F.sum(F.when(F.col("half") == k, v).otherwise(0)).alias(f"{n}{k}") for k in (0, 1) for n, v in (("all", F.lit(1)), ("bad", F.col("blocked")))]
    return common.written(labelled.groupBy("suffix").agg(*sums), "suffixes")


def _with_suffix(rows: DataFrame, counts: DataFrame, size: int, prior: float, own: bool) -> DataFrame:
    """Rows with their suffix's share and count; with ``own``, from the half that a row isn't in. Large tables meet salted."""
    if 64 * size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(counts), "suffix", "left")
    else:
        dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(dealt, ["suffix", "salt"], "left").drop("salt")
    both = lambda n: F.coalesce(F.col(f"{n}0") + F.col(f"{n}1"), F.lit(0))
    other = lambda n: F.coalesce(F.when(F.col("half") == 0, F.col(f"{n}1")).otherwise(F.col(f"{n}0")), F.lit(0))
    seen, bad = (other("all"), other("bad")) if own else (both("all"), both("bad"))
    scale = 2 if own else 1
    return met.withColumns({"suffix_share": (bad + 2 * prior) / (seen + 2), "suffix_count": F.floor(F.log2(scale * seen + 1)).cast("double")}).drop("all0", "all1", "bad0", "bad1")


def _node(tree: list, at: int = 0) -> str:
    """The leaf value, as SQL, of a tree kept as a heap: inner nodes are (column, cut), leaves are numbers."""
    here = tree[at]
    if not isinstance(here, tuple):
        return f"{float(here)!r}D"
    return f"CASE WHEN {here[0]} <= {here[1]!r}D THEN {_node(tree, 2 * at + 1)} ELSE {_node(tree, 2 * at + 2)} END"


def raw_score(base: float, trees: list) -> Column:
    """Log-odds of a blocked URL. As text, because a plan of many small calls takes longer to build than to run."""
    return F.expr(" + ".join([f"{base!r}D", *map(_node, trees)]))


def _place(tree: list, level: int) -> Column:
    """The node of ``level`` that a row is in."""
    at = "0"
    for i in range(2**level - 1):
        if isinstance(tree[i], tuple):
            at = f"CASE WHEN ({at}) = {i} THEN IF({tree[i][0]} <= {tree[i][1]}, {2 * i + 1}, {2 * i + 2}) ELSE ({at}) END" if i else f"IF({tree[0][0]} <= {tree[0][1]}, 1, 2)"
    return F.expr(at)


def _best(sums: dict, features: int) -> tuple | None:
    """(gain, feature, cut) of a node's best split from its gradient and curvature sums per feature and bin."""
    best = None
    for f in range(features):
        bins = sorted(sums.get(f, {}).items())
        g_all, h_all = (sum(v[k] for _, v in bins) for k in (0, 1))
        g = h = 0
        for b, (gb, hb) in bins[:-1]:
            g, h = g + gb, h + hb
            gain = g * g / (h + DAMPING * UNIT) + (g_all - g) ** 2 / (h_all - h + DAMPING * UNIT) - g_all**2 / (h_all + DAMPING * UNIT)
            if gain > 1e-6 * UNIT and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def boosted(rows: DataFrame, features: Sequence[str], label: str = "blocked", trees: int = TREES, depth: int = DEPTH) -> dict:
    """Trees on ``features`` (doubles, not null) and a 0/1 ``label``: log-loss, second order, one aggregate per level."""
    features = list(features)
    quantiles = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    first = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0)), *(F.percentile_approx(f, quantiles, 10_000) for f in features)).first()
    n, bad = first[0], first[1]
    if not n or not bad or n == bad:
        return {"base": (30.0 if n and bad else -30.0), "trees": []}
    cuts = [sorted(set(c)) for c in first[2:]]
    bins = [sum(((F.col(f) > c).cast("int") for c in cs), F.lit(0)).alias(f"b{i}") for i, (f, cs) in enumerate(zip(features, cuts, strict=True))]
    names = [f"b{i}" for i in range(len(features))]
    grid = rows.select(*bins, F.col(label).cast("long").alias("y")).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    grid = common.written(grid, "grid")
    base, done = math.log(bad / (n - bad)), []  # trees over bins
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(b).alias("b")) for k, b in enumerate(names)))).alias("x")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-raw_score(base, done)))
        g, h = F.rint(UNIT * (F.col("y") - F.col("n") * p)).cast("long"), F.rint(UNIT * F.col("n") * p * (1 - p)).cast("long")
        held = grid.select(*names, g.alias("g"), h.alias("h"))
        tree: list = [None] * (2 ** (depth + 1) - 1)
        tree[0] = 0.0
        for level in range(depth):
            open_nodes = [i for i in range(2**level - 1, 2 ** (level + 1) - 1) if tree[i] is not None]
            sums: dict = {}
            for r in held.select(_place(tree, level).alias("at"), "g", "h", each).groupBy("at", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r.at, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
            for i in open_nodes:
                split = _best(sums.get(i, {}), len(features))
                if split is None:
                    continue
                _, f, b = split
                parts = [[v for k, v in sums[i][f].items() if (k <= b) == left] for left in (True, False)]
                tree[i] = (f"b{f}", b)
                tree[2 * i + 1], tree[2 * i + 2] = (RATE * sum(v[0] for v in p) / (sum(v[1] for v in p) + DAMPING * UNIT) for p in parts)
        if not isinstance(tree[0], tuple):
            break
        done.append(tree)
    spoken = lambda x: (features[int(x[0][1:])], cuts[int(x[0][1:])][x[1]])
    return {"base": base, "trees": [[spoken(x) if isinstance(x, tuple) else x for x in t] for t in done]}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], carry: list[str], url_column: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``carried``, host, path, rule, verdict, score (the trees' chance of a blocked URL)."""
    url = F.col(url_column).cast("string")
    rows = pages.select(F.struct(*(F.col(c) for c in carry)).alias("carried"), url.alias("url"))
    rows = rows.withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("told", rule_of("host", "path", rules))
    rows = with_features(rows, "url", "host", "path").withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)))
    labelled = rows.filter("told IS NOT NULL").withColumn("blocked", (F.col("told.verdict") == "block").cast("int"))
    counts = suffix_counts(labelled)
    size, n, bad = counts.agg(F.count("*"), F.coalesce(F.sum(F.expr("all0 + all1")), F.lit(0)), F.coalesce(F.sum(F.expr("bad0 + bad1")), F.lit(0))).first()
    prior = (bad + 0.5) / (n + 1)
    chance = F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 30)) / (1 << 30)
    some = labelled.filter(chance * n < SAMPLE).drop("carried", "told", "path", "host")
    model = boosted(_with_suffix(some, counts, size, prior, own=True), FEATURES)
    scored = _with_suffix(rows, counts, size, prior, own=False).withColumn("score", 1 / (1 + F.exp(-raw_score(**model))))
    verdict = F.coalesce("told.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("carried", "host", "path", F.col("told.rule").alias("rule"), verdict.alias("verdict"), "score")
