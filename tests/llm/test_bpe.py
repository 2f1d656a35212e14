import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from trialstats.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_whole_table(spark, sf_dir, library):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id: r for r in queries.QUERIES["op5_bpe"](spark, sf_dir).collect()}
    assert len(out) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert out[doc].n_tokens == len(ids)
        assert out[doc].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_random_strings_equal_the_library(library):
    rng = random.Random(2)
    chunks = bpe.chunks_of(PATH, public_tokenizers.PATTERN)
    signs = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeinst ", "éèü中文字🙂 ", "0123456789.,!?-\n\t ", "ABCdef'st "]
    for _ in range(4000):
        alphabet = rng.choice(signs)
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert b"".join(chunks.of([text])) == np.array(library.encode_ordinary(text), "<u4").tobytes(), repr(text)


def test_long_run_of_one_letter(library):
    chunks = bpe.chunks_of(PATH, public_tokenizers.PATTERN)
    assert b"".join(chunks.of(["a" * 50_000])) == np.array(library.encode_ordinary("a" * 50_000), "<u4").tobytes()


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "<|endoftext|>"), (5, "word " * 20_000)]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.decoded).decode()) for r in out), key=repr)
    assert got == sorted(((d, len(library.encode_ordinary(t or "")), t or "") for d, t in rows), key=repr)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert bpe.round_trip(spark.sql("select 1L doc_id, 'a' text, 'x' ids, 'y' n_tokens")).first().n_tokens == 1
