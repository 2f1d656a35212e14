"""Language identification by a byte convolutional network.

Texts are UTF-8 bytes in windows of fixed length. Filters of several widths slide over a window; each filter's largest
answer over all places is kept (max pooling), and a softmax layer tells the language. Trained in numpy on windows of
labelled texts; a text's prediction is the mean of its windows' log-probabilities over the whole text.

Byte embeddings and filters act as one table per filter place. For speed the tables of two neighbouring places are
joined into one by byte pair when the trained net is applied.

Defined results: null texts and texts without a letter are ``und`` with score 0. A training table without rows gives a
model that answers ``und`` with score 0. Repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

WINDOW = 256
WIDTHS = (2, 4)
FILTERS = 12
DEPTH = 8
#: Bound of the training sample: documents per language, and windows per document.
PER_LANGUAGE = 600
PER_DOCUMENT = 4
MOST_LANGUAGES = 256
EPOCHS = 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}").search


class ByteNet:
    """Embedding (256 x depth), filters per width, pooled answers through tanh, linear softmax."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DEPTH), (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)
        self.pairs: list | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteNet:
        """Adam on cross entropy. Through the maximum only the winning place of each filter learns."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), size):
                step += 1
                some = order[at : at + size]
                grads = self._gradients(windows[some], labels[some])
                pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                self.embed[0] = 0
        self.pairs = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        embedded = self.embed[x]
        pooled, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            spans = np.lib.stride_tricks.sliding_window_view(embedded, w, 1).transpose(0, 1, 3, 2)
            answers = spans.reshape(len(x), -1, w * DEPTH) @ f.reshape(w * DEPTH, FILTERS)
            places.append(answers.argmax(1))
            pooled.append(answers.max(1))
        hidden = np.tanh(np.concatenate(pooled, 1) + self.bias)
        p = _softmax(hidden @ self.out + self.shift)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        d_hidden = (p @ self.out.T) * (1 - hidden * hidden)
        d_embed, d_filters = np.zeros_like(self.embed), []
        for k, (w, f, place) in enumerate(zip(WIDTHS, self.filters, places, strict=True)):
            d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            taken = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(w)]  # rows, filters, places
            d_filters.append(np.einsum("nf,nfwd->wdf", d, self.embed[taken], optimize=True))
            np.add.at(d_embed, taken.ravel(), np.einsum("nf,wdf->nfwd", d, f, optimize=True).reshape(-1, DEPTH))
        return [d_embed, *d_filters, d_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """One row per window of WINDOW bytes."""
        if self.pairs is None:
            single = [[self.embed @ f[k] for k in range(len(f))] for f in self.filters]
            self.pairs = [[(s[k][:, None, :] + s[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(s), 2)] for s in single]
        pooled = []
        both = (windows[:, :-1].astype(np.intp) << 8) | windows[:, 1:]
        for w, tables in zip(WIDTHS, self.pairs, strict=True):
            n = WINDOW - w + 1
            answers = tables[0][both[:, :n]]
            for k, table in enumerate(tables[1:], 1):
                answers += table[both[:, 2 * k : 2 * k + n]]
            pooled.append(answers.max(1))
        hidden = np.tanh(np.concatenate(pooled, 1) + self.bias)
        return np.log(_softmax(hidden @ self.out + self.shift) + 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as windows, the last of each filled with zeros; and the number of windows of each text."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), counts


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` labelled texts of each language, chosen by a hash of the text, and no more than four times that.

    Counts are taken over all rows; the most frequent MOST_LANGUAGES languages are learnt.
    """
    spoken = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(F.col("text").rlike(r"\p{L}"))
    counts = spoken.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    chance = F.abs(F.xxhash64("text") % 1_000_000) / 1_000_000
    picked = spoken.join(F.broadcast(counts), "lang").filter(chance * F.col("n") < per_language).select("lang", "text")
    return picked.orderBy(F.xxhash64("text", "lang")).limit(4 * per_language * MOST_LANGUAGES)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNet | None:
    """The net, fitted on the driver to a bounded sample; None without labelled rows.

    Only windows leave the executors: PER_DOCUMENT of each sampled text, at places spread over all of it.
    """
    places = F.transform(
        F.sequence(F.lit(0), F.lit(PER_DOCUMENT - 1)),
        lambda k: F.substring("text", (F.greatest(F.length("text") - WINDOW, F.lit(0)) * k / (PER_DOCUMENT - 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    rows = sample(labelled, per_language).select("lang", F.array_distinct(places).alias("parts")).toPandas()
    if not len(rows):
        return None
    classes = sorted(rows.lang.unique())
    number = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for lang, parts in zip(rows.lang, rows.parts, strict=True):
        for part in parts:
            coded = part.encode()[:WINDOW]
            # short texts occur as well, so some windows are cut short
            texts.append(coded[: rng.integers(12, WINDOW)] if rng.random() < 0.3 else coded)
            labels.append(number[lang])
    weights = np.bincount(labels, minlength=len(classes))
    most = int(weights.max())
    order = np.concatenate([np.resize(np.flatnonzero(np.array(labels) == c), min(most, 4 * weights[c])) for c in range(len(classes))])
    windows, _ = windows_of(texts)
    return ByteNet(classes).fit(windows[order], np.array(labels)[order])


def _predicted(model: ByteNet | None, text_back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            for some in common.slices(batch, limit=2 << 20):
                texts = some.column("text").to_pylist()
                lettered = [t is not None and LETTER(t) is not None for t in texts]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                at = np.flatnonzero(lettered)
                if model is not None and len(at):
                    windows, counts = windows_of([texts[i].encode() for i in at])
                    logs = np.concatenate([model.log_probabilities(windows[k : k + 1024]) for k in range(0, len(windows), 1024)])
                    means = np.add.reduceat(logs, np.cumsum(counts) - counts) / counts[:, None]
                    p = _softmax(means.astype(np.float64))
                    scores[at] = p.max(1)
                    for i, c in zip(at, p.argmax(1), strict=True):
                        langs[i] = model.classes[c]
                names = [x for x in some.schema.names if text_back or x != "text"]
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in names), pa.array(langs), pa.array(scores)], [*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteNet | None, carry: list[str], text_column: str = "text", text_back: bool = False) -> DataFrame:
    """lang_pred and score of every text, beside a struct ``carried`` of the columns in ``carry``. No other column is an input.

    ``text_back`` gives the texts back as ``text``: they travel to Python once, not once more inside ``carried``.
    """
    plain = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carried"), F.col(text_column).cast("string").alias("text"))
    kind = plain.schema["carried"].dataType.simpleString()
    told = plain.mapInArrow(_predicted(model, text_back), f"carried {kind}, {'text string, ' if text_back else ''}lang_pred string, score double")
    return told.withColumn("carried", F.col("carried").dropFields("_")) if carry else told
