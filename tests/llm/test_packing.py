import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialstats.llm import common, packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def wanted(tokenizer, rows, capacity=1024):
    out = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=repr)


def checked(out, tokenizer, rows, capacity=1024, slack=0.02):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == wanted(tokenizer, rows, capacity)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // capacity) * (1 + slack) + 1
    return len(bins)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    out = queries.QUERIES["op2_packing"](spark, sf_dir).collect()
    checked(out, tokenizer, list(zip(docs.doc_id, docs.text, strict=True)))


def test_edges_over_many_parts(spark, tokenizer):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (None, " "), (3, "a \n b  c  d   e \t f \n "), (3, "same"), (3, "same"), (4, "<|endoftext|> don't"), (5, "x" * 5000), (6, "word " * 3000)]
    rows += [(10 + i, "the cat " * rng.randint(1, 60)) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    out = packing.pack(frame, capacity=128).collect()
    checked(out, tokenizer, rows, 128, slack=0.05)


def by_lengths(spark, tokenizer, lengths, parts):
    """Rows and their frame: one text per wanted number of ids, rows in order over ``parts`` partitions."""
    rows = [(i, " cat" * (n - 1)) for i, n in enumerate(lengths)]
    assert all(len(tokenizer.encode(" cat" * (n - 1)).ids) == n - 1 for n in set(lengths))
    return rows, spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")


@pytest.mark.parametrize("group", [None, 128])
def test_lengths_that_differ_by_partition_meet(spark, tokenizer, monkeypatch, group):
    if group:
        monkeypatch.setattr(packing, "GROUP", group)
    rows, frame = by_lengths(spark, tokenizer, [600] * 400 + [400] * 400, 2)
    out = packing.pack(frame, capacity=1000).collect()
    assert checked(out, tokenizer, rows, 1000) <= (404 if group else 400)


def test_bins_that_nothing_fits_stay(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows, frame = by_lengths(spark, tokenizer, [600] * 300, 3)
    out = packing.pack(frame, capacity=1000).collect()
    assert checked(out, tokenizer, rows, 1000, slack=0.7) == 300


def test_empty_and_clashing_names(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    frame = spark.sql("select 1L doc_id, 'a' text, 'x' seq, 'y' shift, 'z' fill, 1 part")
    assert packing.pack(frame).count() == 1


def test_best_fit_fills():
    sizes = np.array([600, 500, 424, 300, 224, 1024])
    bins, shifts, fills = packing.best_fit(sizes, 1024)
    assert sorted(fills.tolist()) == [1024, 1024, 1024] and shifts[5] == 0 and bins[0] == bins[2]


def test_chunks_join_to_the_whole_text(tokenizer):
    rng = random.Random(1)
    signs = [" ", " ", "  ", "\n", "\t", "a", "Bé", "1", "!", "'s", " ", " ", "中"]
    import pyarrow as pa

    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for some in (texts[:1000], texts[1000:], texts[:10], []):
        ends, ids = packing.token_ids(pa.array(some, pa.string()), coder, 2)
        for text, a, b in zip(some, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)
    assert common.slices


def test_chunks_are_found_again_after_the_kept_ones_went(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED", 30)
    coder = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(8):
        text = " ".join(f"w{k * 7 + i}" for i in range(20 if k < 6 else 80))
        assert packing.token_ids(pa.array([text]), coder, 2)[1].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_chunks_encoded_as_one_text_have_their_own_ids():
    coder = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    chunks = [" a", " don't", " ", " \u00a0x", " x\u2003", " \n", " \u4f60\u597d", " <|endoftext|>", " a\tb", " 12,5", " e\u0301", " \x1cq", " " + "ab" * 3000]
    for part in (chunks, [c for c in chunks if c.strip() and not c[-1].isspace()], [" ", " \n"], []):
        lengths, ids = coder.joined(part)
        expected_lengths, expected = coder.encoded(part)
        assert lengths.tolist() == expected_lengths.tolist()
        assert ids.tolist() == expected.tolist()
