"""Ranked lexical search: exact inner products with sparse ball trees.

A document is a sparse vector of whole-number impacts, one per term that some query asks for; a query is a sparse vector of
whole-number term weights; a score is their inner product. Terms that no query has can't add to a score, so vectors hold
the queries' terms only, but every document with such a term is indexed.

Every task keeps its documents in ball trees of about TREE documents. A ball has a centroid of whole numbers, a radius
(the farthest document, rounded up) and its smallest id. No document of a ball scores more than
``query . centroid + |query| * radius``: the product is exact in whole numbers, the norms are rounded up. Balls wait in a
heap by that bound; the best is opened first, leaves are scored exactly, and what can't reach the query's current k-th
place, ids included, is pruned. The k best of a task's trees carry over from tree to tree; then the tasks' lists, k rows
per query at most, are ranked by a window per query.

Equal vectors of a tree are one vector with all its ids, so a large group of copies is one point.

Queries run in blocks of about BLOCK terms, so what a task holds of them is bounded; each block is a pass over the documents.

Defined results: null texts and texts without terms are no documents and no queries (they get no rows). Ties go to the smaller id,
a null id last. Rows with equal ids are ranked each. A term that a query repeats counts once. Very long texts are
read whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm import common

TOP = 50
LEAF = 128
TREE = 4096
#: Query terms (with repeats over queries) of one block.
BLOCK = 1 << 17
SLICE_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "query int, doc_id long, score long"
#: Everything of ASCII that isn't a letter or digit separates; only A-Z are lowered.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of each text: (offsets per text, codes, distinct terms)."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # offsets from zero
    _, offsets, data = texts.buffers()
    plain = (data.to_pybytes() if data else b"").translate(_TERM)
    lowered = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain), offset=texts.offset)
    cuts, codes, distinct, _ = common.word_codes(lowered)
    return cuts, codes, distinct


def _counted(vocabulary: list[str]):
    """Number of terms of each text, and how often it has each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            for some in common.slices(batch, limit=SLICE_BYTES):
                cuts, codes, distinct = terms_of(common.texts_of(some))
                asked = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                hit = asked >= 0
                keys, tfs = np.unique(text[hit] * max(len(known), 1) + asked[hit], return_counts=True)
                rows, terms = np.divmod(keys, max(len(known), 1))
                ends = pa.array(np.searchsorted(rows, np.arange(len(cuts))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
                out = pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(out.column("n"), 0))

    return run


def _up(x: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, rounded up to whole numbers."""
    root = np.floor(np.sqrt(x.astype(np.float64))).astype(np.int64)
    return root + 1 - (x == 0)


class BallTree:
    """Sparse whole-number vectors in balls: arrays per node, and rows in the order of the leaves."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.used, self.terms = np.unique(terms, return_inverse=True)
        self.ends, self.values, self.ids = ends, values, ids
        self.row = np.repeat(np.arange(len(ids)), np.diff(ends))
        self.squares = np.bincount(self.row, values.astype(np.float64) ** 2, len(ids))
        self.leaf, self.nodes, self.children = leaf, [], []
        self.centres = np.zeros((0, len(self.used)))
        self._build()

    def _dot(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        starts, counts = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        at = common.ragged(starts, counts)
        return np.bincount(np.repeat(np.arange(len(rows)), counts), self.values[at] * vector[self.terms[at]], len(rows))

    def _sum(self, rows: np.ndarray) -> np.ndarray:
        at = common.ragged(self.ends[rows], self.ends[rows + 1] - self.ends[rows])
        return np.bincount(self.terms[at], self.values[at], len(self.used))

    def _dense(self, row: int) -> np.ndarray:
        return self._sum(np.array([row]))

    def _build(self) -> None:
        """Split each ball between two far rows, in halves, until a leaf's worth is left."""
        waiting, centres = [(np.arange(len(self.ids)), -1)], []
        while waiting:
            rows, parent = waiting.pop()
            me = len(self.nodes)
            centre = np.rint(self._sum(rows) / len(rows))
            # all sums are of whole numbers below 2^53, so they are exact
            far = self.squares[rows] - 2 * self._dot(rows, centre) + centre @ centre
            self.nodes.append((rows, int(_up(np.array([far.max()]))[0]), int(self.ids[rows].min())))
            self.children.append([])
            centres.append(centre)
            if parent >= 0:
                self.children[parent].append(me)
            if len(rows) > self.leaf and far.max() > 0:
                one = self._dense(rows[far.argmax()])
                away = self.squares[rows] - 2 * self._dot(rows, one)
                two = self._dense(rows[away.argmax()])
                side = np.argsort(self._dot(rows, two - one), kind="stable")
                half = len(rows) // 2
                waiting += [(rows[side[:half]], me), (rows[side[half:]], me)]
        self.centres = np.array(centres)
        self.radius = np.array([r for _, r, _ in self.nodes], np.float64)

    def search(self, terms: np.ndarray, weights: np.ndarray, copies: list[np.ndarray], best: list, k: int) -> None:
        """Put what beats the k best so far into ``best``, a heap of (score, -id)."""
        at = np.searchsorted(self.used, terms)
        here = (at < len(self.used)) & (self.used[np.minimum(at, len(self.used) - 1)] == terms)
        if not here.any():
            return
        query = np.zeros(len(self.used))
        query[at[here]] = weights[here]
        norm = math.isqrt(int((weights[here] ** 2).sum())) + 1
        bounds = (self.centres[:, at[here]] @ query[at[here]] + norm * self.radius).tolist()
        heap = [(-bounds[0], self.nodes[0][2], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if bound == 0 or (len(best) == k and (-bound, -least) < best[0]):
                break  # all that wait are worse: a lower bound, or the same and a larger id
            if self.children[node]:
                for child in self.children[node]:
                    if len(best) < k or (bounds[child], -self.nodes[child][2]) > best[0]:
                        heapq.heappush(heap, (-bounds[child], self.nodes[child][2], child))
                continue
            rows = self.nodes[node][0]
            scores = self._dot(rows, query).astype(np.int64)
            for i in np.flatnonzero(scores > (best[0][0] - 1 if len(best) == k else 0)).tolist():
                for one in copies[rows[i]][:k].tolist():
                    found = (int(scores[i]), -one)
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                    else:
                        break


def _impacts(n: np.ndarray, counts: np.ndarray, tfs: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = np.repeat(50 + (50 * n * documents) // length, counts)
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def _searched(queries: list[tuple[int, list[int]]], weights: np.ndarray, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        asked = [(number, np.array(terms, np.int64), weights[terms]) for number, terms in queries]
        best: list[list] = [[] for _ in asked]

        def look(held: list[pa.RecordBatch]) -> None:
            some = pa.Table.from_batches(held).combine_chunks()
            ids = pc.fill_null(some.column("doc_id"), NO_ID).to_numpy()
            terms, tfs = (some.column(x).combine_chunks() for x in ("terms", "tfs"))
            ends = terms.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            terms, tfs = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            values = _impacts(some.column("n").to_numpy(), np.diff(ends), tfs, documents, length)
            alike: dict[bytes, list[int]] = {}
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                alike.setdefault(terms[a:b].tobytes() + values[a:b].tobytes(), []).append(i)
            copies = [np.sort(ids[rows]) for rows in alike.values()]
            first = np.array([rows[0] for rows in alike.values()])
            counts = np.diff(ends)[first]
            at = common.ragged(ends[first], counts)
            tree = BallTree(np.append(0, np.cumsum(counts)), terms[at], values[at], np.array([c[0] for c in copies]))
            for (_, some_terms, some_weights), heap in zip(asked, best, strict=True):
                tree.search(some_terms, some_weights, copies, heap, k)

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                held.append(batch.slice(at, TREE))
                rows += held[-1].num_rows
                if rows >= TREE:
                    look(held)
                    held, rows = [], 0
        if held:
            look(held)
        for (number, _, _), heap in zip(asked, best, strict=True):
            ids = pa.array([-x for _, x in heap], pa.int64())
            ids = pc.if_else(pc.equal(ids, NO_ID), pa.scalar(None, pa.int64()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(heap), pa.int32()), ids, pa.array([s for s, _ in heap], pa.int64())], ["query", "doc_id", "score"])

    return run


def _block(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(query, doc_id, score): the k best of every task, for the numbered queries of one block."""
    vocabulary = sorted({t for _, terms in queries for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = common.written(docs.mapInArrow(_counted(vocabulary), COUNTED), "counted")
    documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most BLOCK rows
        weights[r.t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    coded = [(number, [place[t] for t in terms]) for number, terms in queries]
    return counted.filter(F.size("terms") > 0).mapInArrow(_searched(coded, weights, documents, length, k), HITS)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in common.slices(batch):
            cuts, codes, distinct = terms_of(common.texts_of(some))
            words = distinct.to_pylist()
            terms = [sorted({words[c] for c in codes[a:b]}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("item"), pa.array(terms, pa.list_(pa.string()))], ["item", "terms"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of every row of ``items``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    asked = items.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    asked = common.written(asked.mapInArrow(_query_terms, f"item {kind}, terms array<string>").filter(F.size("terms") > 0), "queries")
    asked = common.written(asked.withColumn("query", F.monotonically_increasing_id()), "numbered")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    out = None
    for number in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "terms").collect()  # about ``block`` terms
        if not some and out is not None:
            continue
        numbers = spark.createDataFrame([(i, r.query) for i, r in enumerate(some)], "place int, query long")
        hits = _block(plain, [(i, r.terms) for i, r in enumerate(some)], k).withColumnRenamed("query", "place")
        best = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ranked = common.written(ranked.join(F.broadcast(numbers), "place").select("query", "rank", "doc_id", "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    return out.join(asked.select("query", F.col("item").alias("item_id")), "query").select("item_id", "rank", "doc_id", "score")
