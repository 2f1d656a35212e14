import hashlib
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.llm import periodic, queries


def brute_runs(w, exponent=4, shortest=6):
    """Every maximal stretch with a period, kept with its smallest one."""
    n, best = len(w), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s >= max(shortest, exponent * q):
                best.setdefault((s, i), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts, **options):
    sizes = [len(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    table = {}
    codes = np.array([table.setdefault(x, len(table)) for t in texts for x in t], np.int64)
    out = [[] for _ in texts]
    for d, s, n, q in zip(*(x.tolist() for x in periodic.runs_of(offsets, codes, **options)), strict=True):
        out[d].append((s, n, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 1)])
def test_runs_equal_brute_force(exponent, shortest):
    rng = random.Random(exponent)
    texts = [[], ["a"]]
    for k in range(400):
        alphabet = "ab" if k % 3 else "abcde"
        t = [rng.choice(alphabet) for _ in range(rng.randint(0, 50))]
        if k % 2:
            p = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
            t += p * rng.randint(2, 8) + p[: rng.randint(0, len(p))] + [rng.choice(alphabet) for _ in range(rng.randint(0, 20))]
        texts.append(t)
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    texts += [list(b), list("a" * 200), list("ab" * 100 + "c" * 90)]
    assert found(texts, exponent=exponent, shortest=shortest) == [brute_runs(t, exponent, shortest) for t in texts]


def test_very_long_texts():
    n = 200_000
    assert found([["x"] * n, [f"w{i % 49_999}" for i in range(n)], [f"w{i}" for i in range(n)]]) == [[(0, n, 1)], [(0, n, 49_999)], []]


def edited(doc_id, text):
    w = brute.words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        w = edited(doc_id, text)
        runs = brute_runs(w)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        printed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want[doc_id] = (len(runs), *top, hashlib.sha256(printed.encode()).hexdigest(), brute.sha(collapsed(w, runs)))
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "a " * 6), (3, "a " * 6), (4, "a " * 5), (5, "é ü " * 4 + "é"), (6, "x y " * 4 + "z " * 9), (7, "w " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("r"), "kept": F.lit("k"), "carried": F.lit(1)})
    out = periodic.collapse(frame.repartition(3), ["doc_id", "runs", "kept", "carried"]).collect()
    got = sorted((((r.carried.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept) for r in out), key=repr)
    want = [(d, len(brute.words(t)), brute_runs(brute.words(t)), collapsed(brute.words(t), brute_runs(brute.words(t)))) for d, t in rows]
    assert got == sorted(want, key=repr)
    assert all((r.carried.runs, r.carried.kept, r.carried.carried) == ("r", "k", 1) for r in out)
    assert periodic.collapse(frame.limit(0), ["doc_id"]).collect() == []
