import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trialstats.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        scores = []
        for d, c, n in counted:
            m = 50 + 50 * n * total // length
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in asked.items() if t in c)
            if s:
                scores.append((-s, math.inf if d is None else d))
        out += [(item, i, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, parts=3, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({"score": F.lit("s"), "terms": F.lit("t"), "rank": F.lit(0)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"query": F.lit("q"), "item": F.lit(1), "doc_id": F.lit(2)})
    return sorted((tuple(r) for r in lexical.search(d, q, **options).collect()), key=repr)


def test_ties_copies_and_edges(spark):
    rng = random.Random(3)
    pool = [f"t{i}" for i in range(30)] + ["É", "über", "Z9", "中文"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    docs += [(1000 - i, "t1 t2, T2! t3") for i in range(200)] + [(5, "t1 t2"), (5, "t1 t2"), (None, "t1 t2 t3"), (None, None), (7, " .,!"), (8, "é É " + "t4 " * 60_000)]
    items = [(1, "t1 T2 t2"), (2, None), (3, "..."), (4, "nowhere"), (4, "zz t4"), (5, " ".join(pool)), (6, "É;ü"), (None, "t3")]
    for k in (1, 5, 50, 1000):
        assert got(spark, docs, items, k=k) == brute(docs, items, k)
    assert got(spark, docs, items, k=7, block=3) == brute(docs, items, 7)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [], []) == []


def test_trees_prune_nothing_that_counts(monkeypatch):
    rng = np.random.default_rng(5)
    n, v = 600, 40
    dense = (rng.random((n, v)) < 0.2) * rng.integers(1, 10**6, (n, v))
    dense[n // 2 :] = dense[n // 2 :] // 1000 + (np.arange(v) < 3) * 500_000  # one tight ball among wide ones
    row, term = np.nonzero(dense)
    ends = np.append(0, np.cumsum((dense > 0).sum(1)))
    ids = rng.permutation(n)
    tree = lexical.BallTree(ends, term, dense[row, term], ids, leaf=16)
    opened = []
    real = tree._dot
    monkeypatch.setattr(tree, "_dot", lambda rows, q: (opened.append(len(rows)), real(rows, q))[1])
    for q in range(20):
        asked = rng.choice(v, 5, replace=False)
        asked.sort()
        weights = rng.integers(0, 20_000, 5)
        best = []
        tree.search(asked, weights, [np.array([i]) for i in ids], best, 10)
        scores = dense[:, asked] @ weights
        want = sorted(((int(s), -int(i)) for s, i in zip(scores, ids, strict=True) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want, q
    assert sum(opened) < 20 * n  # some balls stay shut


def test_bounds_hold_for_every_ball():
    rng = np.random.default_rng(9)
    dense = (rng.random((200, 15)) < 0.4) * rng.integers(1, 10**6, (200, 15))
    row, term = np.nonzero(dense)
    tree = lexical.BallTree(np.append(0, np.cumsum((dense > 0).sum(1))), term, dense[row, term], np.arange(200), leaf=4)
    for rows, radius, _ in tree.nodes:
        centre = np.rint(dense[rows].sum(0) / len(rows)).astype(object)
        assert all(((x - centre) ** 2).sum() <= radius**2 for x in dense[rows].astype(object))


def test_terms_are_split_as_the_pattern_says():
    texts = ["".join(map(chr, range(300))), "Straße-ÄÖ_x9 İ\u2028y", None, ""]
    cuts, codes, distinct = lexical.terms_of(pa.array([t or "" for t in texts]))
    words = distinct.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [terms(t) for t in texts]
