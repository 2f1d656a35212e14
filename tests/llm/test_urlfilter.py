import math
import random

import pandas as pd
from pyspark.sql import functions as F

from trialstats.llm import queries, urlfilter


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [tail.find(c) for c in "?#" if c in tail]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min(ends)] if ends else tail


def ruled(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_whole_table(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    out = {r.page_id: r for r in queries.QUERIES["op12_url_filter"](spark, sf_dir).collect()}
    assert len(out) == len(pages)
    for page, url in zip(pages.page_id, pages.url, strict=True):
        host, path = parted(url)
        rule, verdict = ruled(host, path, queries.RULES)
        r = out[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def judged(spark, rows, rules=queries.RULES):
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "suffix": F.lit("s"), "half": F.lit("x"), "score": F.lit(1)})
    return urlfilter.judge(frame, rules, ["page_id", "host", "score"]).collect()


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "://net/", "http://NET/x", "http://xnet/", "http://a.net", "http://a.net?x=/", "http://a.b.net/#t", "http://example.NET/en/1", "http://example.net/EN/1"]
    urls += ["http://w.example.com/de/1?a=b&c", "x://org/fr/", "http://ünï.org/fr/é\nf?g", "a://b://net/", "http://net/" + "a1" * 100_000, "http://u:p@a.org:80/fr/x", "http://net/", "http://net/"]
    rows = list(enumerate(urls)) + [(None, "http://net/y")]
    out = judged(spark, rows)
    got = sorted(((r.carried.page_id, r.host, r.path, r.rule) for r in out), key=repr)
    want = [(d, *parted(u), ruled(*parted(u), queries.RULES)[0]) for d, u in rows]
    assert got == sorted(want, key=repr)
    assert all(r.carried.host == "h" and 0 <= r.score <= 1 for r in out)


def test_no_rows_and_one_kind_of_label(spark):
    assert judged(spark, []) == []
    assert [r.verdict for r in judged(spark, [(1, "http://a.b/"), (2, None)])] == ["allow", "allow"]
    assert {r.verdict for r in judged(spark, [(i, f"http://a{i}.net/") for i in range(9)] + [(10, "http://x.y/")])} == {"block"}


def planted(n, seed):
    """Blocked: many parameters, or hosts full of digits. The rules can't see this, only half of the URLs meet one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        host = "".join(rng.choice("0123456789" if bad and i % 2 else "abcdefgh") for _ in range(10))
        query = "&".join(f"k{j}={j}" for j in range(rng.randint(4, 7) if bad and i % 2 == 0 else rng.randint(0, 2)))
        known = rng.random() < 0.5
        path = f"/known/{'b' if bad else 'a'}/" if known else "/other/a/"
        rows.append((bad, known, f"http://{host}.test{path}?{query}"))
    return rows


def test_trees_learn_what_rules_cannot_say(spark):
    data = planted(4000, 1)
    rules = [("block", "test", "/known/b/"), ("allow", "test", "/known/a/")]
    out = {r.carried.page_id: r for r in judged(spark, [(i, u) for i, (_, _, u) in enumerate(data)], rules)}
    rest = [(bad, out[i]) for i, (bad, known, _) in enumerate(data) if not known]
    assert all(r.rule is None for _, r in rest)
    assert sum((r.verdict == "block") == bad for bad, r in rest) / len(rest) > 0.97


def test_same_model_whatever_the_partitions_and_joins(spark, monkeypatch):
    rows = [(i, u) for i, (_, _, u) in enumerate(planted(600, 2))]
    rules = [("block", "test", "/known/b/"), ("allow", "test", "/known/a/")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    one = urlfilter.judge(frame.repartition(1), rules, ["page_id"]).orderBy("carried.page_id").collect()
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", -1)
    assert urlfilter.judge(frame.repartition(7), rules, ["page_id"]).orderBy("carried.page_id").collect() == one


def test_features(spark):
    urls = ["http://a-b.c1.de/x/y1//z?q=1&&r#f", "https://ééé", ""]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": urlfilter.host_of("url"), "path": urlfilter.path_of("url")})
    out = urlfilter.with_features(frame, "url", "host", "path").collect()
    r = out[0]
    assert (r.labels, r.hyphens, r.depth, r.parameters, r.fragment, r.secure, r.suffix) == (3, 1, 3, 2, 1, 0, "de")
    for row in out:
        n = len(row.url)
        want = -sum(row.url.count(c) / n * math.log2(row.url.count(c) / n) for c in set(row.url)) if n else 0
        assert abs(row.entropy - want) < 1e-9 and row.digits == (sum(c.isdigit() for c in row.url) / n if n else 0)
