import brute
import pandas as pd
import pytest
from test_packing import checked, tokenizer  # noqa: F401

import corpus_pipeline as pipeline
from trialstats.llm import common


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    out = [("documents", docs.toPandas())]
    for name, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "test")
        out.append((name, docs.toPandas()))
    return out


def rows(frame):
    return list(zip(frame.doc_id.tolist(), frame.text.tolist(), strict=True))


def test_columns_stay(steps):
    for _, frame in steps[:-1]:
        assert list(frame.columns) == pipeline.COLUMNS
        assert (frame.text.str.len() == frame.n_chars).all()


def test_language_keeps_clean_documents(steps):
    before, after = steps[0][1], steps[1][1]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) >= 0.99 * len(before)


def test_lines(steps):
    before, after = rows(steps[1][1]), dict(rows(steps[2][1]))
    seen, by_length = set(), {}
    for doc, text in sorted(before):
        kept = []
        for line in text.split("\n"):
            w = tuple(brute.words(line))
            near = w in seen
            if w:
                seen.add(w)
            if len(w) >= 5:
                near = near or any(brute.edits(x, w) <= 1 for n in (-1, 0, 1) for x in by_length.get((len(w) + n, w[:2]), []) + by_length.get((len(w) + n, w[-2:]), []))
                by_length.setdefault((len(w), w[:2]), []).append(w)
                by_length.setdefault((len(w), w[-2:]), []).append(w)
            if not near:
                kept.append(line)
        text = "\n".join(kept)
        assert after.get(doc) == (text if brute.words(text) else None)


def test_near_duplicates(steps):
    before, after = rows(steps[2][1]), rows(steps[3][1])
    classes = brute.near_classes(before)
    assert sorted(after) == sorted((d, t) for d, t in before if classes[d] == d)


def test_substrings(steps):
    before, after = rows(steps[3][1]), dict(rows(steps[4][1]))
    texts = dict(before)
    for doc, _, gone, kept in brute.without_repeats(before):
        assert after.get(doc) == ((kept if gone else texts[doc]) if kept else None)


def test_packing(steps, tokenizer):  # noqa: F811
    checked(list(steps[5][1].itertuples()), tokenizer, rows(steps[4][1]))


def test_run_equals_stages_and_odd_tables(spark, sf_dir, tmp_path, steps):
    assert pipeline.run(spark, sf_dir).count() == len(steps[5][1])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "the one and only text of this table", "en", "s", None), (2, "the one and only text of this table", "en", "s", None)]
    for name, data in (("odd", odd), ("none", [])):
        spark.createDataFrame(data, schema).selectExpr("*", "'x' spans", "1 id").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} == ({2} if data else set())
    assert isinstance(steps[0][1], pd.DataFrame)


def test_one_row_of_a_class_stays_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(None, text), (None, text), (5, text), (5, text), (3, text + " more"), (6, "some other text"), (6, "a third text of its own"), (None, "no id"), (None, "no id"), (8, ""), (9, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.without_near_duplicates(spark, docs.repartition(3), "").collect()
    want = [(3, text + " more"), (6, "some other text"), (6, "a third text of its own"), (None, "no id"), (8, ""), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(want, key=repr)
