"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Index. Equal vectors are one node. Vectors get one more component that gives all the same length, so that near by
angle means near by inner product. A first graph comes from runs of neighbours in a few sorted random projections,
which range partitioning spreads evenly, however many vectors are alike. Then every node brings its neighbours and
some of those that have it as neighbour together, by joins, compares them with each other, and offers each what it
lacks. Pairs that met before are skipped. Rounds end after DESCENTS, or when few edges are new.

Search. A query starts at its own node, if it has one, and at the nearest of ENTRIES sampled nodes. Each round expands
its best nodes not yet expanded, through a join with the graph; the best BEAM stay. The last BEST are measured in
double precision on the original vectors.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id and
vectors of another size than the most frequent. Ties go to the smaller id. Rows that repeat an id count as one (the
first by content). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm import common

DEGREE = 32
#: Of the nodes that have a node as neighbour, so many (by hash) meet its neighbours; the search graph has as many back edges.
BACK = 24
RUN = 192
PROJECTIONS = 4
DESCENTS = 7
OFFERS = 8
ENTRIES = 256
BEAM = 128
ROUNDS = 8
BEST = 32
#: Queries beside a node that are expanded at once: each brings all its neighbours' codes.
TOGETHER = 256
BROADCAST_BYTES = 32 << 20
EDGE = "src long, dst long, near float, fresh boolean"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector array<double>) of the rows that take part, one per id."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (size["n"] if size else 0))


def _codes(longest: float, even: bool) -> Callable:
    """Vectors in half precision, with the component that evens out lengths; it is 0 for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1) / longest
                rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
                code = np.concatenate([x, rest * even], 1).astype("<f2")
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "code"])

    return run


def _matrix(codes: list[bytes]) -> np.ndarray:
    width = len(codes[0]) // 2 if codes else 0
    return np.frombuffer(b"".join(codes), "<f2").reshape(len(codes), width).astype(np.float32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by projection: the nearest of each in its run of RUN rows."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("code").to_pylist())
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        k = min(DEGREE, len(ids) - 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
        values = np.take_along_axis(near, best, 1).ravel()
        return _edges(np.repeat(ids, k), ids[best.ravel()], values)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * RUN:
            rows = pa.Table.from_batches(held)
            yield told(rows.slice(0, RUN))
            held = rows.slice(RUN).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield told(pa.Table.from_batches(held))


def _edges(src: np.ndarray, dst: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    fresh = pa.array(np.ones(len(src), bool))
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(near.astype(np.float32)), fresh], ["src", "dst", "near", "fresh"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: its neighbours compared with each other, and what each lacks."""

    def told(ids: np.ndarray, x: np.ndarray, least: np.ndarray, fresh: np.ndarray) -> tuple:
        near = x @ x.T
        near[~(fresh[:, None] | fresh[None, :]) | (ids[:, None] == ids) | (near <= least[:, None])] = -np.inf
        k = min(OFFERS, len(ids))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        values = np.take_along_axis(near, best, 1)
        row, place = np.nonzero(np.isfinite(values))
        return ids[row], ids[best[row, place]], values[row, place]

    held: pa.Table | None = None
    stream = iter(batches)
    while True:
        batch = next(stream, None)
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        if held is not None:
            rows = held if rows is None else pa.concat_tables([held, rows])
        if rows is None or not rows.num_rows:
            if batch is None:
                return
            continue
        nodes = rows.column("node").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(nodes)) + 1, [len(nodes)]])
        done = cuts[-1] if batch is None else cuts[-2]  # the last node may go on
        held = rows.slice(done)
        rows = rows.slice(0, done).combine_chunks()
        ids, least, fresh = (rows.column(c).to_numpy() for c in ("id", "least", "fresh"))
        x = _matrix(rows.column("code").to_pylist()) if done else None
        out = [told(ids[a:b], x[a:b], least[a:b], fresh[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b <= done and b - a > 1]
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
        if batch is None:
            return


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of each node. An edge known before isn't fresh."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy(F.desc("near"), "dst")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= degree)


def _back(edges: DataFrame, count: int) -> DataFrame:
    """Of the edges into a node ``count``, by hash."""
    order = Window.partitionBy("dst").orderBy(F.xxhash64("src", "dst"))
    return edges.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= count).drop("turn")


def graph(codes: DataFrame, degree: int = DEGREE, descents: int = DESCENTS) -> DataFrame:
    """(src, dst, near, fresh, place): about the ``degree`` nearest of every node of ``codes`` (id, code)."""
    first = codes.first()
    if first is None:
        return codes.sparkSession.createDataFrame([], EDGE + ", place int")
    axes = np.random.default_rng(9).normal(size=(len(first["code"]) // 2, 2 * PROJECTIONS)).astype(np.float32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every node once per projection: a cell along one axis, and a place in it along another."""
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("code").to_pylist()) @ axes
                for k in range(PROJECTIONS):
                    cell = pa.array(np.floor(x[:, 2 * k] * 2).astype(np.int64) + 1000 * k)
                    yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(x[:, 2 * k + 1].astype(np.float64))], ["id", "code", "cell", "along"])

    rows = codes.mapInArrow(placed, "id long, code binary, cell long, along double")
    edges = rows.repartitionByRange("cell", "along", "id").sortWithinPartitions("cell", "along", "id").mapInArrow(_runs, EDGE)
    known = common.written(_best(edges, degree), "graph")
    for _ in range(descents):
        least = known.filter(F.col("place") == degree).select(F.col("src").alias("id"), "near")
        members = codes.join(least, "id", "left").select("id", "code", F.coalesce("near", F.lit(-2.0)).cast("float").alias("least"))
        forth = known.select(F.col("src").alias("node"), F.col("dst").alias("id"), "fresh")
        back = _back(known, BACK).select(F.col("dst").alias("node"), F.col("src").alias("id"), "fresh")
        meetings = forth.unionByName(back).join(members, "id").repartition("node").sortWithinPartitions("node")
        offers = meetings.mapInArrow(_met, EDGE)
        known = common.written(_best(offers.unionByName(known.select("src", "dst", "near", "fresh").withColumn("fresh", F.lit(False))), degree), "graph")
        if known.filter("fresh").count() * 1000 < known.count():
            break
    return known


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries beside a node's neighbours: those nearer than the query's worst so far."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(lo, TOGETHER)
            codes = _matrix(some.column("qcode").to_pylist())
            lists, blobs = some.column("ids").to_pylist(), some.column("codes").to_pylist()
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            row = np.repeat(np.arange(len(lists)), sizes)
            x = np.frombuffer(b"".join(blobs), "<f2").reshape(len(row), -1).astype(np.float32)
            near = np.einsum("ij,ij->i", x, codes[row])
            ids = np.array([i for these in lists for i in these], np.int64)
            at = near > some.column("least").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(some.column("query").to_numpy()[row[at]]), pa.array(ids[at]), pa.array(near[at].astype(np.float32))], ["query", "id", "near"])


def _adjacency(known: DataFrame, codes: DataFrame) -> DataFrame:
    """(node, ids, codes): neighbours both ways, at most DEGREE + BACK, with their codes in a row."""
    both = known.select("src", "dst").unionByName(_back(known, BACK).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    told = both.join(codes.withColumnRenamed("id", "dst"), "dst")
    lists = told.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "code"))).alias("l"))
    return lists.select("node", F.col("l.dst").alias("ids"), F.expr("aggregate(l.code, X'', (a, c) -> concat(a, c))").alias("codes"))


def search(known: DataFrame, codes: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """(query, id, near) of the best nodes found for ``queries`` (query, qcode, node): node is its own, or null."""
    adjacency = common.written(_adjacency(known, codes), "adjacency")
    sample = codes.orderBy(F.xxhash64("id")).limit(ENTRIES).toPandas()
    entries, entry_ids = _matrix(sample["code"].tolist()), sample["id"].to_numpy()

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(entries):
                near = _matrix(batch.column("qcode").to_pylist()) @ entries.T
                k = min(4, len(entry_ids))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                values = np.take_along_axis(near, top, 1).ravel().astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("query").to_numpy(), k)), pa.array(entry_ids[top.ravel()]), pa.array(values)], ["query", "id", "near"])

    found = "query long, id long, near float"
    own = queries.filter("node IS NOT NULL").select("query", F.col("node").alias("id"), F.lit(2.0).cast("float").alias("near"))
    state = queries.select("query", "qcode").mapInArrow(entered, found).unionByName(own)
    order = Window.partitionBy("query").orderBy(F.desc("near"), "id")

    def kept(rows: DataFrame) -> DataFrame:
        once = rows.repartition("query").groupBy("query", "id").agg(F.max("near").alias("near"), F.max("old").alias("old"))
        best = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEAM)
        full = F.when(F.max("place").over(Window.partitionBy("query")) >= BEAM, F.min("near").over(Window.partitionBy("query")))
        return best.withColumn("least", F.coalesce(full, F.lit(-2.0)).cast("float"))

    asked = queries.select("query", "qcode")
    if (8 + 2 * entries.shape[1]) * asked.count() <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    state = common.written(kept(state.withColumn("old", F.lit(False))), "beam")
    for _ in range(ROUNDS):
        frontier = state.filter("NOT old").select("query", "id", "least").join(asked, "query")
        beside = frontier.select("query", "qcode", "least", F.col("id").alias("node")).join(adjacency, "node")
        new = beside.select("query", "qcode", "least", "ids", "codes").mapInArrow(_expanded, found).withColumn("old", F.lit(False))
        state = common.written(kept(new.unionByName(state.select("query", "id", "near", F.lit(True).alias("old")))), "beam")
        if state.filter(f"NOT old AND place <= {best}").isEmpty():
            break
    return state.filter(F.col("place") <= best + 1).select("query", "id", "near")


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row where ``is_query`` (of ``id``) holds.

    A query's own row is no candidate.
    """
    rows = common.written(usable(vectors, id_column, vector_column), "usable")
    longest = rows.agg(F.max(F.sqrt(_product(F.col("vector"), F.col("vector"))))).first()[0] or 1.0
    # equal vectors are one node; of their ids the k + 1 smallest can be among a query's k nearest
    same = Window.partitionBy("vector").orderBy("id")
    ranked = rows.withColumn("turn", F.row_number().over(same)).filter(F.col("turn") <= k + 1)
    nodes = ranked.filter("turn = 1").select("id", "vector")
    codes = common.written(nodes.mapInArrow(_codes(longest, True), "id long, code binary"), "codes")
    known = graph(codes)
    asked = common.written(rows.filter(is_query).join(nodes.select(F.col("id").alias("node"), "vector"), "vector"), "asked")
    flat = asked.select("id", "vector").mapInArrow(_codes(longest, False), "id long, code binary")
    asked = asked.select(F.col("id").alias("query"), "vector", "node")
    coded = common.written(asked.select("query", "node").join(flat.select(F.col("id").alias("query"), F.col("code").alias("qcode")), "query"), "coded")
    found = search(known, codes, coded, max(BEST, k + 1))
    members = ranked.join(nodes.select(F.col("id").alias("node"), "vector"), "vector").select("node", F.col("id").alias("member"), F.col("vector").alias("theirs"))
    pairs = found.withColumnRenamed("id", "node").join(members, "node").filter("member <> query")
    scored = pairs.join(asked.select("query", F.col("vector").alias("mine")), "query").select("query", "member", _product(F.col("mine"), F.col("theirs")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("member").alias("vec_id"), "score")
