import random

import brute
import numpy as np
import pandas as pd

from trialstats.llm import minhash, queries


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: r.class_id for r in minhash.classes(frame, **options).collect()}


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = brute.near_classes(list(zip(docs.doc_id, docs.text, strict=True)))
    out = {r.doc_id: r.class_id for r in queries.QUERIES["op6_near_dedup"](spark, sf_dir).collect()}
    assert out == want and len(set(want.values())) < len(want)


def test_groups_whose_base_comes_last_and_chains(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each copy is near the base, less near the others
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    rows.append((90, " ".join(base)))
    chain = [f"c{i}" for i in range(300)]
    for i in range(8):  # each link shares most with the one before only
        chain = chain[25:] + [f"c{i}_{j}" for j in range(25)]
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, " ".join(f"z{rng.randint(0, 5000)}" for _ in range(80))) for i in range(40)]
    assert got(spark, rows) == brute.near_classes(rows)


def template_rows(families, seed=11):
    """Documents of one template, most of them unlike each other, every family with a second that is just near the first."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(240)]
    rows = []
    for i in range(families):
        one = list(base)
        for at in range(rng.randrange(16), 240, 32):
            one[at] = f"x{i}_{at}"
        two = list(one)
        for at in rng.sample(range(240), 5):
            two[at] = f"y{i}_{at}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    rng.shuffle(rows)
    return rows


def test_near_pairs_among_documents_of_one_template(spark):
    rows = template_rows(80)
    want = brute.near_classes(rows)
    assert len(set(want.values())) == 80
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = minhash.classes(frame, bands=4, rows=1).collect()  # few components, so that buckets are large
    assert {r.doc_id: r.class_id for r in out} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a  b\n"), (6, "a c"), (7, "w " * 5000), (8, "w " * 4900), (9, "w " * 900)]
    assert got(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    assert got(spark, []) == {}
    twice = spark.sql("select 1L doc_id, 'a b c' text, 'x' id, 'y' key, 'z' bands union all select 1L, 'a b c', 'x', 'y', 'z' union all select null, 'a b c', 'x', 'y', 'z'")
    out = minhash.classes(twice, carry=["id", "key", "bands"]).collect()
    assert len(out) == 3 and len({r.class_id for r in out}) == 1 and {r.carried.key for r in out} == {"y"}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    size = 2048
    a = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    counts = rng.integers(1, 40, (2, 60))
    text = np.repeat([0, 1], 60)
    signed = minhash.signatures(2, text, np.tile(a, 2), counts.ravel(), size)
    want = np.minimum(*counts).sum() / np.maximum(*counts).sum()
    assert minhash.similarity((a, counts[0]), (a, counts[1])) == want
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / size)
