import random

import brute
import pandas as pd
import pyarrow as pa

from trialstats.llm import common, queries, substrings


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.remove_repeats(frame, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr)


def test_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = brute.without_repeats(list(zip(docs.doc_id, docs.text, strict=True)))
    out = queries.QUERIES["op10_substring_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted((a, b, c, brute.sha(d)) for a, b, c, d in want)


def test_edges(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(7, None), (3, ""), (5, " \t\n"), (None, passage), (9, "x " * 40), (10, "x " * 13), (2, f"a {passage}\tb"), (4, f"c\n{passage} d"), (4, f"c\n{passage} d"), (4, passage), (6, "é ü " * 20)]
    rows += [(20 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    assert got(spark, rows) == brute.without_repeats(rows)
    assert got(spark, rows, window=5, run=2) == brute.without_repeats(rows, 5)


def test_hot_and_long(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(i, "one common passage of exactly these few words that many documents share word by word " + str(i)) for i in range(200)] + [(500, long), (501, long)]
    assert got(spark, rows) == brute.without_repeats(rows)


def test_empty_and_clashing_names(spark):
    assert got(spark, []) == []
    frame = spark.sql("select 1L doc_id, 'a b' text, 'x' spans, 'y' mark, 'z' kept, 2 bucket")
    out = substrings.remove_repeats(frame, carry=["spans", "mark", "kept", "bucket"]).first()
    assert (out.n_words, out.kept, out.carried.kept, out.carried.bucket) == (2, "a b", "z", 2)


def test_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    rows = [(i, " ".join(f"q{j}" for j in range(i % 20))) for i in range(60)]
    want = got(spark, rows)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", -1)
    assert got(spark, rows) == want == brute.without_repeats(rows)


def test_word_hashes_by_lanes():
    rng = random.Random(2)
    values = sorted({"".join(rng.choice("ab\0é") for _ in range(rng.randint(0, 30))) for _ in range(5000)} | {"x" * n for n in (7, 8, 9, 16, 255, 256, 257, 600)} | {"a\0", "a", "a\0\0", "x" * 599 + "y"})
    array = pa.array(values)
    hashes = common.lane_hashes(array)
    assert len(set(hashes.tolist())) == len(values)
    assert common.lane_hashes(array[777:]).tolist() == hashes[777:].tolist()
    order = rng.sample(range(len(values)), len(values))
    assert common.lane_hashes(pa.array([values[i] for i in order])).tolist() == hashes[order].tolist()
    assert len(common.lane_hashes(pa.array([], pa.string()))) == 0 and len(common.lane_hashes(pa.array(["", ""]))) == 2
