import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialstats.llm import neighbours, queries


def exact(ids, x, asked, k):
    out = {}
    for q, mine in asked:
        score = x @ mine
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def recall(found, want):
    hits = [len({v for v, _ in want[q]} & {v for v, _ in found.get(q, [])}) for q in want]
    return sum(hits) / max(1, sum(map(len, want.values())))


def collected(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    want = exact(ids, x, [(i, v) for i, v in zip(ids, x, strict=True) if i % 20 == 0], 20)
    found = collected(queries.QUERIES["op3_neighbours"](spark, sf_dir))
    assert set(found) == set(want) and recall(found, want) >= 0.95
    scores = dict(zip(ids, x, strict=True))
    for q, rows in found.items():
        assert len(rows) == 20
        assert all(abs(s - float(scores[q] @ scores[v])) < 1e-12 for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    rows += [(1000 + i, [3.0, 0.0, 0.0, 0.0, 0.0, 0.1]) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2040, [float("inf")] + [0.0] * 5), (2060, []), (2080, [1.0, 2.0]), (None, [1.0] * 6), (5, rows[5][1])]
    return rows


def test_odd_vectors_lengths_and_ties(spark, odd):
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(odd, schema).repartition(4).selectExpr("*", "1 id", "'x' code", "2 rank")
    good = {i: v for i, v in odd if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids, x = np.array(list(good)), np.array(list(good.values()))
    want = exact(ids, x, [(i, np.array(v)) for i, v in good.items() if i % 20 == 0], 20)
    found = collected(neighbours.nearest(frame, F.col("id") % 20 == 0))
    assert set(found) == set(want) and recall(found, want) >= 0.9
    common = [q for q in want if q >= 1000]
    assert all([v for v, _ in found[q]] == [v for v, _ in want[q]] for q in common)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], schema)
    assert collected(neighbours.nearest(few, F.col("id") % 20 == 0)) == {20: [(1, 0.5), (2, 0.0)]}
    assert neighbours.nearest(few.limit(0), F.col("id") % 20 == 0).collect() == []
    assert neighbours.nearest(few.filter("vec_id = 20"), F.col("id") % 20 == 0).collect() == []


def test_expansion_takes_few_rows_at_once():
    rng = np.random.default_rng(7)
    n = 2 * neighbours.TOGETHER + 3
    queries_, sizes = rng.normal(size=(n, 5)).astype("<f2"), rng.integers(1, 6, n)
    codes = [rng.normal(size=(k, 5)).astype("<f2") for k in sizes]
    lists, least = [[10 * i + j for j in range(k)] for i, k in enumerate(sizes)], rng.normal(size=n).astype(np.float32)
    columns = [pa.array(np.arange(n)), pa.array([q.tobytes() for q in queries_], pa.binary()), pa.array(least), pa.array(lists), pa.array([c.tobytes() for c in codes], pa.binary())]
    out = list(neighbours._expanded(iter([pa.RecordBatch.from_arrays(columns, ["query", "qcode", "least", "ids", "codes"])])))
    assert len(out) == 3
    got = {(r["query"], r["id"]) for b in out for r in b.to_pylist()}
    want = {(i, 10 * i + j) for i in range(n) for j in range(sizes[i]) if codes[i][j].astype(float) @ queries_[i].astype(float) > least[i]}
    assert len(got ^ want) <= 2  # ties within float32
