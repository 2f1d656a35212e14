"""Trained models: held-out accuracy, gradients, and edge rows."""

import numpy as np
import pandas as pd

from trialstats.llm import language, quality, queries


def test_language_on_held_out_rows(spark, sf_dir):
    truth = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "lang"]]
    out = queries.QUERIES["op1_language"](spark, sf_dir).toPandas().merge(truth, on="doc_id")
    held = out[out.held_out]
    assert len(out) == len(truth) and 0.15 < out.held_out.mean() < 0.25
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, f"{w} " * 40, lang) for i, (w, lang) in enumerate([("der", "de"), ("the", "en"), ("les", "fr")] * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None), (2, ""), (3, "12 !?"), (None, "the the the"), (5, "the " * 30_000), (5, "the " * 30_000)]
    frame = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'x' lang_pred", "1 score")
    out = language.predict(frame, model, ["doc_id"]).selectExpr("carried.doc_id", "lang_pred", "score").collect()
    assert sorted((r.lang_pred for r in out)) == ["en"] * 3 + ["und"] * 3
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    empty = frame.limit(0)
    assert language.predict(empty, model, ["doc_id"]).collect() == []
    assert language.train(spark.createDataFrame([], "text string, lang string")) is None
    assert {r.lang_pred for r in language.predict(frame, None, ["doc_id"]).collect()} == {"und"}


def test_language_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language.ByteNet(["a", "b", "c"])
    for p in net.parameters():
        p[...] = rng.normal(0, 0.3, p.shape)

    def loss():
        net.pairs = None
        return -net.log_probabilities(x)[np.arange(5), y].mean()

    for p, g in zip(net.parameters(), net._gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_quality_on_held_out_rows(spark, sf_dir):
    truth = pd.read_parquet(f"{sf_dir}/labels.parquet")
    out = queries.QUERIES["op8_quality"](spark, sf_dir).toPandas()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    held = out[out.held_out].merge(truth, on="doc_id")
    ranks, good = held.score.rank(), held.quality == 1
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.85


def test_quality_edges(spark):
    rows = [(i, "plain words here " * 5 if i % 2 else "JUNK!!! $$$ " * 9) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None), (101, ""), (None, "plain words"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (None, 1), (5, None), (7, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs.selectExpr("*", "1 score", "2 places"), model, ["doc_id", "places"]).selectExpr("carried.doc_id", "score").collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == 64 and score[1] > 0.9 and score[0] < 0.1 and score[None] > 0.9 and score[100] == score[101]
    assert quality.score(docs.limit(0), model, ["doc_id"]).collect() == []
    assert quality.train(docs, labels.limit(0)) is None


def test_latent_space_finds_planted_topics():
    rng = np.random.default_rng(2)
    labels = np.repeat([0, 1], 50)
    counts = rng.poisson(0.02, (100, quality.TERMS)).astype(np.float32)
    counts[:50, :40] += rng.poisson(1, (50, 40))
    counts[50:, 60:100] += rng.poisson(1, (50, 40))
    model = quality.Votes(counts, labels, rank=8)
    assert (np.round(model.scores(counts)) == labels).mean() == 1.0
