"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are words and word shapes (upper, lower case, digits, other signs), hashed to TERMS places; weights are
log(1 + count) times inverse document frequency. A truncated singular value decomposition of a bounded labelled sample
gives the latent space. Every document's vector is multiplied with all labelled vectors, block by block; the nearest
NEIGHBOURS vote, weighted by cosine similarity.

Both labels have equal shares of the sample, so that 0.5 is the point of no preference. Defined results: texts
without words (null, empty) get the mean of the sample's labels; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

TERMS = 4096
SHAPES = 1024
RANK = 64
NEIGHBOURS = 25
#: Bound of the labelled sample, per label.
PER_LABEL = 1500
CACHED = 500_000
_UPPER, _LOWER, _DIGIT = (regex.compile(p) for p in (r"\p{Lu}+", r"[\p{L}\p{M}--\p{Lu}]+(?V1)", r"\p{N}+"))


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each; other signs stay."""
    return _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))


class Terms:
    """Places of a word's shape and of the word itself."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        out = []
        for w in words:
            places = known.get(w)
            if places is None:
                digest = xxhash.xxh3_64_intdigest
                places = digest(shape(w)) % SHAPES, SHAPES + digest(w.lower()) % (TERMS - SHAPES)
                if len(w) <= 64:
                    known[w] = places
            out.append(places)
        return np.array(out, np.int64).reshape(-1, 2)


def counted(texts: pa.Array, terms: Terms) -> Iterator[np.ndarray]:
    """Blocks of documents as log(1 + count) by term."""
    offsets, codes, distinct, _ = common.word_codes(texts)
    places = terms.of(distinct.to_pylist())
    for a in range(0, len(texts), 256):
        b = min(a + 256, len(texts))
        lo, hi = offsets[a], offsets[b]
        row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        cells = (row[:, None] * TERMS + places[codes[lo:hi]]).ravel()
        yield np.log1p(np.bincount(cells, minlength=(b - a) * TERMS).reshape(b - a, TERMS)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Votes:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 5):
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        weighted = _unit(counts * self.idf)
        rng = np.random.default_rng(seed)
        basis = rng.normal(size=(weighted.shape[1], min(rank + 16, *weighted.shape))).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
        _, _, axes = np.linalg.svd(weighted @ basis, full_matrices=False)
        self.axes = (basis @ axes.T[:, :rank]).astype(np.float32)
        self.vectors = _unit(weighted @ self.axes)
        self.labels = labels.astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(counts), float(self.labels.mean()))
        at = np.flatnonzero(counts.any(1))
        if len(at):
            near = _unit(_unit(counts[at] * self.idf) @ self.axes) @ self.vectors.T
            k = min(neighbours, near.shape[1])
            nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, nearest, 1), 1e-6).astype(np.float64)
            out[at] = (weight * self.labels[nearest]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def _sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for some in common.slices(batch):
            blocks = [row for block in counted(common.texts_of(some), terms) for row in block]
            at = [np.flatnonzero(x).astype(np.int32) for x in blocks]
            yield pa.RecordBatch.from_arrays(
                [some.column("quality"), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(blocks, at, strict=True)], pa.list_(pa.float32()))],
                ["quality", "places", "weights"],
            )


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Votes | None:
    """Fit to about ``per_label`` documents of each label, chosen by a hash of the id, and no more than twice that.

    ``labels`` has doc_id and quality (0 or 1); only rows to learn from. One id counts once.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = usable.groupBy("quality").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    picked = usable.join(F.broadcast(counts), "quality").filter(chance * F.col("n") < per_label)
    picked = picked.orderBy(F.xxhash64("doc_id", "quality")).limit(4 * per_label).select("doc_id", "quality")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = texts.select("quality", "text").mapInArrow(_sampled_counts, "quality int, places array<int>, weights array<float>").toPandas()
    if not len(rows):
        return None
    rows = rows.assign(first=rows.places.map(lambda x: tuple(x[:50]))).sort_values(["quality", "first"], kind="stable")
    dense = np.zeros((len(rows), TERMS), np.float32)
    for i, (at, weight) in enumerate(zip(rows.places, rows.weights, strict=True)):
        dense[i, at] = weight
    return Votes(dense, rows.quality.to_numpy())


def _scored(model: Votes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for some in common.slices(batch):
                scores = [np.full(len(x), 0.5) if model is None else model.scores(x) for x in counted(common.texts_of(some), terms)]
                names = [x for x in some.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in names), pa.array(np.concatenate(scores))], [*names, "score"])

    return run


def score(docs: DataFrame, model: Votes | None, carry: list[str], text_column: str = "text") -> DataFrame:
    """The score of every whole text, beside a struct ``carried`` of the columns in ``carry``."""
    plain = docs.select(F.struct(*(F.col(c) for c in carry)).alias("carried"), F.col(text_column).cast("string").alias("text"))
    return plain.mapInArrow(_scored(model), f"carried {plain.schema['carried'].dataType.simpleString()}, score double")
