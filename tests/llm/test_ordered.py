import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from trialstats.llm import ordered, queries


def edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, half = t or "", len(t or "") // 2
        out[d] = t[: len(t) - half] + (after or "")[:half]
    return out


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    want = edited(rows)
    out = {r.doc_id: r for r in queries.QUERIES["op7_fingerprints"](spark, sf_dir).collect()}
    prints = {}
    for d, t in rows:
        assert out[d].n_chars == len(t)
        assert out[d].edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        assert prints.setdefault(t, out[d].fingerprint) == out[d].fingerprint
    assert sum(r.near_edited for r in out.values()) > 10 * sum(r.near_next for r in out.values())


def test_edges_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_BITS", 2)
    for limit in (1 << 20, -1):
        monkeypatch.setattr(ordered, "BROADCAST_BYTES", limit)
        rng = random.Random(3)
        rows = [(i * rng.choice([1, 1, 50]) + 5000 * i, " ".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 9)))) for i in range(-20, 40)]
        rows += [(7, None), (8, ""), (9, "x" * 3001)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert {r.doc_id: r.edited for r in ordered.fingerprints(frame).collect()} == edited(rows)


def test_ids_far_apart(spark):
    rng = random.Random(6)
    ids = [-(1 << 62), *(rng.randrange(-(1 << 60), 1 << 60) for _ in range(600)), *(i << 21 for i in range(300))]
    rows = [(d, " ".join(rng.choice("abcd") for _ in range(6))) for d in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.edited for r in ordered.fingerprints(frame).collect()} == edited(rows)
    borders = ordered._borders(frame.selectExpr("doc_id id", "xxhash64(text) mark", f"shiftright(doc_id, {ordered.GROUP_BITS}) group"))
    text = borders._jdf.queryExecution().executedPlan().toString()
    assert borders.count() >= 600 and text.count("Exchange SinglePartition") == 1  # of one row per range


def test_one_row_no_row_null_ids_and_names(spark):
    assert ordered.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = ordered.fingerprints(spark.sql("select 1L doc_id, 'abcd' text, 'x' id, 'y' mark, 'z' copy")).first()
    assert one.edited == "abab" and one.near_next == 1.0
    rows = [(None, "a b"), (None, "c d"), (2, "e f"), (2, "e f")]
    assert ordered.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def signature(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.s for r in ordered.with_fingerprint(frame, "t", "s").orderBy("i").collect()]


def test_order_and_repeats_matter(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    a, b, c = signature(spark, " ".join(words), "  ".join(words) + "\n", " ".join(moved))
    assert a == b and 0.2 < len(set(a) & set(c)) / len(a) < 0.9
    once, twice = signature(spark, "r s t u " * 30, "r s t u " * 60)
    assert once != twice


def test_numbered_path_agrees_with_plain_path(spark):
    """A text without repeats, and the same with one at its end, share nearly all tuples."""
    words = [f"w{i}" for i in range(300)]
    a, b = signature(spark, " ".join(words), " ".join([*words, "w0", "w1", "w2"]))
    assert len(set(a) & set(b)) >= 0.9 * len(a)


def test_likeness_and_plan(spark, sf_dir):
    frame = spark.sql("select array() a, array() b").select(F.col("a").cast("array<bigint>"), F.col("b").cast("array<bigint>"))
    assert frame.select(ordered.likeness("a", "b")).first()[0] == 1.0
    plan = queries.QUERIES["op7_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
