"""Near-duplicate documents by BagMinHash over word shingles, with exact verification.

Signatures. A document is a multiset of shingles. Every shingle carries Poisson processes over its weight levels: one
for level [0, 1) and one for each dyadic shell [1, 2), [2, 4), [4, 8), ... of further counts, so a count of c needs
about log2(c) processes. A point falls on a time, a component and a level, all derived from the shingle alone; it
counts if the level is below the shingle's count. A component's value is its earliest point, so two documents agree in
it with probability equal to their weighted Jaccard similarity. Points are made in order of time up to a limit at
which nearly all components are filled; documents with an unfilled one get a later limit.

Candidates. Equal texts are one class first. Bands of components are hashed; in each bucket every class meets the
bucket's most connected class (the one in the largest buckets). Where that leaves a bucket in several components, all
its classes go through an exact join: shingles are ordered by the number of these classes that have them, rarest first,
and two similar classes must share one near the start of both lists. All similar pairs of different components are
found, whatever the bucket's size; of a family of documents just below the similarity, only own shingles are that near
the start, so its pairs are never made.

Verification is exact: the multisets' overlap, smaller counts over larger counts. Verified pairs are joined into
classes by connected components.

Defined results: documents without words (null, empty, blank) are alone. A document with fewer words than a shingle
has one shingle of all its words. Rows with one id are one document for the classes. A null id is replaced by a
negative hash of the text. An empty table gives no rows. Other columns are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm import common
from trialstats.llm.components import components

SHINGLE = 5
ROWS = 5
BANDS = 26
SIMILARITY = 0.8
#: Slack for comparing counts with fractions of counts.
EPSILON = 1e-6
BROADCAST_BYTES = 32 << 20
SIGNED = "id long, high long, low long, bands array<long>"
_SEEDS = np.random.default_rng(20240907).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_HALF = np.uint64(0x9E3779B97F4A7C15)


def shingles(offsets: np.ndarray, words: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle, by text and hash."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(sizes - length + 1, 1), 0)
    at = common.ragged(offsets[:-1], counts)
    text = np.repeat(np.arange(len(sizes)), counts)
    left = np.repeat(offsets[1:], counts) - at
    hashed = np.zeros(len(at), np.uint64)
    for j in range(length):
        inside = left > j
        hashed += np.where(inside, words[np.minimum(at + j, max(0, len(words) - 1))] * _SEEDS[j], _SEEDS[length + j]) if len(words) else 0
    hashed = common.mixed(hashed)
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.append(True, (np.diff(text) != 0) | (hashed[1:] != hashed[:-1]))[: len(text)]
    heads = np.flatnonzero(new)
    return text[heads], hashed[heads], np.diff(np.append(heads, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(texts: int, text: np.ndarray, hashed: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Per text the time of the earliest point of each component; infinite for a text without shingles."""
    out = np.full(texts * size, np.inf)
    weight = np.bincount(text, count, texts)
    shells = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(text)), shells)
    shell = common.ragged(np.zeros(len(text), np.int64), shells)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, low, 1.0)
    seed = common.mixed(hashed[of] + _HALF * (shell + 1).astype(np.uint64))
    limit = np.where(weight > 0, (np.log(size) + 4) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        at = np.flatnonzero(todo[text[of]])
        time, step = np.zeros(len(at)), np.uint64(0)
        while len(at):
            step += np.uint64(1)
            bits = common.mixed(seed[at] + step * _SEEDS[20])
            time = time - np.log(_uniform(bits)) / (size * width[at])
            early = time <= limit[text[of[at]]]
            at, time, bits = at[early], time[early], bits[early]
            more = common.mixed(bits + _SEEDS[21])
            level = low[at] + np.floor((more >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[at])
            counted = level < count[of[at]]
            component = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
            np.minimum.at(out, text[of[at[counted]]] * size + component[counted].astype(np.int64), time[counted])
        todo &= np.isinf(out.reshape(texts, size)).any(1)
        limit[todo] *= 2
    return out.reshape(texts, size)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (ascending hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _signed(length: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            for some in common.slices(batch):
                yield _slice(some)

    def _slice(some: pa.RecordBatch) -> pa.RecordBatch:
        offsets, codes, distinct, _ = common.word_codes(some.column("text"))
        words = common.hashes(distinct)[codes]
        digests = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        first: dict[bytes, int] = {}
        same = np.array([first.setdefault(d, i) for i, d in enumerate(digests)], np.int64)
        once = np.array(list(first.values()), np.int64)
        sizes = np.diff(offsets)[once]
        own = words[common.ragged(offsets[:-1][once], sizes)]
        signed = signatures(len(once), *shingles(np.concatenate([[0], np.cumsum(sizes)]), own, length), bands * rows)
        bits = signed.view(np.uint64)
        keys = np.zeros((len(once), bands), np.uint64)
        for j in range(rows):
            keys += bits[:, j::rows] * _SEEDS[30 + j]
        keys = common.mixed(keys + np.arange(bands, dtype=np.uint64) * _HALF).view(np.int64)
        place = np.empty(len(same), np.int64)
        place[once] = np.arange(len(once))
        at = place[same]
        marks = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        has = np.diff(offsets) > 0
        empty = pa.array(~has)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys[at].ravel()))
        null_list = pa.nulls(len(at), lists.type)
        return pa.RecordBatch.from_arrays(
            [some.column("id"), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pc.if_else(empty, null_list, lists)],
            ["id", "high", "low", "bands"],
        )

    return run


def _verified(length: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def multisets(ids: list[int], texts: pa.Array) -> None:
            new = [i for i, x in enumerate(ids) if x not in known]
            if len(known) > 4096:
                known.clear()
                new = list(range(len(ids)))
            offsets, codes, distinct, _ = common.word_codes(texts.take(pa.array(new, pa.int64())))
            text, hashed, count = shingles(offsets, common.hashes(distinct)[codes], length)
            cuts = np.searchsorted(text, np.arange(len(new) + 1))
            for k, i in enumerate(new):
                known[ids[i]] = hashed[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]]

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                a, b = some.column("a").to_pylist(), some.column("b").to_pylist()
                multisets(a + b, pa.concat_arrays([some.column("text_a"), some.column("text_b")]))
                found = np.array([similarity(known[x], known[y]) for x, y in zip(a, b, strict=True)])
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(found), pa.array(found >= least)], ["a", "b", "similarity", "near"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, length: int, least: float) -> DataFrame:
    """(a, b, similarity, near) of distinct pairs. Only texts that occur in a pair are moved."""
    pairs = common.written(pairs.select("a", "b").distinct(), "pairs")
    ids = common.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    told = F.broadcast(ids) if 8 * ids.count() <= BROADCAST_BYTES else ids
    needed = common.written(texts.join(told, "id", "left_semi").dropDuplicates(["id"]), "needed")
    one = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = two.select("a", "b", "text_a", "text_b").mapInArrow(_verified(length, least), "a long, b long, similarity double, near boolean")
    return common.written(found, "verified")


def _tokens(length: int):
    """One row per shingle occurrence: id, its number of them, and a hash that tells a text's occurrences apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch):
                offsets, codes, distinct, _ = common.word_codes(some.column("text"))
                text, hashed, count = shingles(offsets, common.hashes(distinct)[codes], length)
                again = common.ragged(np.zeros(len(text), np.int64), count).astype(np.uint64)
                text, tokens = np.repeat(text, count), common.mixed(np.repeat(hashed, count) + again * _HALF).view(np.int64)
                size = np.bincount(text, minlength=some.num_rows)
                ids = some.column("id").take(pa.array(text, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size[text], pa.int64()), pa.array(tokens, pa.int64())], ["id", "size", "token"])

    return run


def _across(named: DataFrame, texts: DataFrame, length: int, least: float) -> DataFrame:
    """(a, b) of different components in ``named`` (id, label) that may be similar: none that is similar is left out.

    Tokens that one class alone has come first in its list and can't match. Similar lists of m and n tokens share at
    least ``least / (1 + least) * (m + n)``, so their first common token stands no nearer to either end. That bounds its
    place in the shorter list (``early``) more than in the longer one.
    """
    told = F.broadcast(named) if 16 * named.count() <= BROADCAST_BYTES else named
    texts = texts.join(told, "id").dropDuplicates(["id"]).select("id", "text")
    tokens = common.written(texts.mapInArrow(_tokens(length), "id long, size long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    by_id = Window.partitionBy("id")
    own = F.col("size") - F.count("*").over(by_id)
    placed = tokens.join(often, "token").withColumn("left", F.col("size") - own - F.row_number().over(by_id.orderBy("often", "token")) + 1)
    placed = placed.filter(F.col("left") >= least * F.col("size") - EPSILON).join(named, "id").select("id", "label", "size", "token", "left")
    placed = common.written(placed.withColumn("early", F.col("left") >= 2 * least / (1 + least) * F.col("size") - EPSILON), "placed")
    # the largest component at a token isn't joined with itself
    counts = placed.groupBy("token", "label").agg(F.count("*").alias("n"), F.max("early").alias("early"))
    main = counts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.max("early").alias("any"))
    main = main.filter("labels > 1 AND any").select("token", F.col("main.label").alias("main"))
    meeting = common.written(placed.join(main, "token"), "meeting")
    one = meeting.filter("early").select("token", "main", *(F.col(c).alias(f"{c}_") for c in ("id", "label", "size", "left")))
    close = F.expr(
        f"label <> label_ AND (size_ < size OR size_ = size AND id_ < id) AND least(left, left_) >= {least / (1 + least)!r}D * (size + size_) - {EPSILON!r}D"
    )
    small = one.filter("label_ <> main").drop("main").join(meeting.drop("main", "early"), "token")
    large = one.filter("label_ = main").drop("main").join(meeting.filter("label <> main").drop("main", "early"), "token")
    return small.unionByName(large).filter(close).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"))


def classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    length: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), copy_of (smallest id with the same words), ``carried``."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    number = F.coalesce(F.col(id_column).cast("long"), -1 - F.abs(F.xxhash64(text) % (1 << 62)))
    plain = docs.select(number.alias("id"), text.alias("text"))
    signed = common.written(plain.mapInArrow(_signed(length, bands, rows), SIGNED), "signed")
    exact = signed.filter("bands IS NOT NULL").groupBy("high", "low").agg(F.min("id").alias("copy_of"), F.first("bands").alias("bands"))
    exact = common.written(exact, "exact")
    banded = exact.select(F.col("copy_of").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    many = common.written(banded.join(shared, "key"), "many")
    reach = many.groupBy("id").agg(F.sum("n").alias("reach"))
    reached = common.written(many.join(reach, "id"), "reached")
    centres = reached.groupBy("key").agg(F.max(F.struct("reach", (-F.col("id")).alias("id"))).alias("top")).select("key", (-F.col("top.id")).alias("centre"))
    starred = common.written(reached.join(centres, "key").select("key", "id", "n", "centre"), "starred")
    spokes = starred.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    first = _verify(spokes, plain, length, similarity)
    labels = components(first.filter("near"))
    labelled = starred.filter("n > 2").select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    named = common.written(labelled.join(mixed, "key", "left_semi").select("id", "label").distinct(), "named")
    met = _across(named, plain, length, similarity).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = _verify(met, plain, length, similarity)
    links = first.unionByName(second).filter("near")
    labels = components(links)
    named = exact.join(labels, exact["copy_of"] == labels["node"], "left").select("high", "low", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))
    keyed = signed.join(named, ["high", "low"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"))
    least = keyed.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"))
    own = docs.select(number.alias("id"), F.col(id_column).cast("long").alias("doc_id"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry or [])).alias("carried"))
    return own.join(least, "id", "left").select("doc_id", "class_id", "copy_of", "carried")
