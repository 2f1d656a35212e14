"""Pairwise-complete moments of many columns by blocked matrix products.

One aggregate expression per pair of columns makes p^2 expressions in one generated class, which ends at some dozens of
columns. Here a task multiplies matrices: values, squares and masks of a batch's rows, one product each for all pairs. What
leaves a task is cut into pieces of BLOCK columns beside one column, so no row is wide, and the pieces of one group are
merged by as many tasks as there are pieces.

Sums are taken about a value of the column that lies near its mean in the first rows a task sees, and moved to a common one when
pieces merge, so large means don't cancel.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.factors import _groups, _value

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64
#: Bytes of matrices that a task keeps for open groups; beyond it they are handed on and begun anew.
OPEN_BYTES = 256 << 20
#: Pieces of one Arrow batch.
ROWS = 1024
VECTORS = ["n", "s1", "t1", "s2", "t2", "sxy"]
PIECE = "i int, block int, ci double, cj array<double>, " + ", ".join(f"{v} array<double>" for v in VECTORS)
MOMENTS = "i int, j int, n long, mean_x double, mean_y double, sxx double, syy double, sxy double"


class _Sums:
    """Matrices of one group in one task."""

    def __init__(self, x: np.ndarray):
        seen = np.isfinite(x)
        count = seen.sum(axis=0)
        mean = np.where(seen, x, 0).sum(axis=0) / np.maximum(count, 1)
        near = np.argmin(np.where(seen, np.abs(x - mean), np.inf), axis=0)
        self.centre = np.where(count > 0, x[near, np.arange(x.shape[1])], 0.0)  # a value, so constants stay exact
        self.n, self.s1, self.s2, self.sxy = np.zeros((4, x.shape[1], x.shape[1]))

    def add(self, x: np.ndarray) -> None:
        there = ~np.isnan(x)
        mask = there.astype(float)
        value = np.where(there, x - self.centre, 0.0)
        self.n += mask.T @ mask
        self.s1 += value.T @ mask  # row i: sums of column i over the rows that column j has too
        self.s2 += (value * value).T @ mask
        self.sxy += value.T @ value


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _pieces(sums: _Sums, width: int) -> Iterator[dict]:
    """Rows (column, block of columns from it on) of a group's matrices, the last block filled up."""
    p = len(sums.centre)
    size = -(-p // width) * width
    pad = lambda m: np.pad(m, ((0, size - p), (0, size - p)))
    n, s1, s2, sxy = (pad(m) for m in (sums.n, sums.s1, sums.s2, sums.sxy))
    centre = np.pad(sums.centre, (0, size - p))
    for block in range(size // width):
        rows = np.arange(min(p, (block + 1) * width))
        at = slice(block * width, (block + 1) * width)
        cut = {"n": n[rows, at], "s1": s1[rows, at], "t1": s1.T[rows, at], "s2": s2[rows, at], "t2": s2.T[rows, at], "sxy": sxy[rows, at]}
        for a in range(0, len(rows), ROWS):
            some = slice(a, a + ROWS)
            yield {
                "i": rows[some],
                "block": np.full(len(rows[some]), block),
                "ci": sums.centre[rows[some]],
                "cj": np.tile(centre[at], (len(rows[some]), 1)),
                **{k: v[some] for k, v in cut.items()},
            }


def _rows_to_pieces(keys: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Sums] = {}
        types, names = [], []

        def out() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                for piece in _pieces(sums, width):
                    count = len(piece["i"])
                    own = [pa.array([_value(k)] * count, kind) for k, kind in zip(key, types, strict=True)]
                    plain = [pa.array(piece["i"], pa.int32()), pa.array(piece["block"], pa.int32()), pa.array(piece["ci"])]
                    yield pa.RecordBatch.from_arrays([*own, *plain, *(_lists(piece[v]) for v in ("cj", *VECTORS))], [*names, "i", "block", "ci", "cj", *VECTORS])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types, names = list(batch.schema.types[:keys]), batch.schema.names[:keys]
            matrix = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[keys:]])
            for key, rows in _groups(batch, keys):
                x = matrix[rows]
                if key not in held:
                    held[key] = _Sums(x)
                held[key].add(x)
            if 32 * matrix.shape[1] ** 2 * len(held) > OPEN_BYTES:
                yield from out()
        yield from out()

    return run


def _moved(part: dict, ci: np.ndarray, cj: np.ndarray) -> dict:
    """Sums about other values: ``ci`` of the column, ``cj`` of the block's columns."""
    a, b = (part["ci"] - ci)[:, None], part["cj"] - cj
    n, s1, t1 = part["n"], part["s1"], part["t1"]
    return {
        "n": n,
        "s1": s1 + a * n,
        "t1": t1 + b * n,
        "s2": part["s2"] + 2 * a * s1 + a * a * n,
        "t2": part["t2"] + 2 * b * t1 + b * b * n,
        "sxy": part["sxy"] + a * t1 + b * s1 + a * b * n,
    }


def _merged(part: dict, head: np.ndarray) -> dict:
    """Neighbouring rows of one piece, from each of ``head`` on, as one."""
    of = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    moved = _moved(part, part["ci"][at][of], part["cj"][at][of])
    return {k: np.add.reduceat(v, at, axis=0) for k, v in moved.items()} | {k: part[k][at] for k in ("i", "block", "ci", "cj", "key")}


def _pieces_merged(keys: int, columns: int, width: int):
    """Pieces sorted by key, column and block: the last one of a batch stays open."""

    def read(batch: pa.RecordBatch, known: list) -> dict:
        codes = np.zeros(batch.num_rows, np.int64)
        for key, rows in _groups(batch, keys):
            if not known or known[-1] != key:
                known.append(key)
            codes[rows] = len(known) - 1
        flat = {v: batch.column(v).flatten().to_numpy().reshape(batch.num_rows, width) for v in ("cj", *VECTORS)}
        return flat | {"i": batch.column("i").to_numpy(), "block": batch.column("block").to_numpy(), "ci": batch.column("ci").to_numpy(), "key": codes}

    def told(part: dict, known: list, types: list, names: list[str]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(part["i"]), ROWS):
            some = {k: v[a : a + ROWS] for k, v in part.items()}
            j = some["block"][:, None] * width + np.arange(width)
            row, place = np.nonzero((j >= some["i"][:, None]) & (j < columns))
            n, s1, t1, s2, t2, sxy = (some[v][row, place] for v in VECTORS)
            safe = np.maximum(n, 1)
            near = 4 * np.finfo(float).eps * safe
            sxx, syy = s2 - s1 * s1 / safe, t2 - t1 * t1 / safe
            sxx, syy = np.where(sxx <= near * s2, 0.0, sxx), np.where(syy <= near * t2, 0.0, syy)
            mean_x, mean_y = some["ci"][row] + s1 / safe, some["cj"][row, place] + t1 / safe
            values = [mean_x, mean_y, sxx, syy, sxy - s1 * t1 / safe]
            own = [pa.array([_value(known[k][c]) for k in some["key"][row]], kind) for c, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(some["i"][row], pa.int32()), pa.array(j[row, place], pa.int32()), pa.array(n.astype(np.int64)), *(pa.array(v, mask=n == 0) for v in values)],
                [*names, "i", "j", "n", "mean_x", "mean_y", "sxx", "syy", "sxy"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []
        still, types, names = None, [], []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                types, names = list(batch.schema.types[:keys]), batch.schema.names[:keys]
                part = read(batch, known)
                if still is not None:
                    part = {k: np.concatenate([still[k], v]) for k, v in part.items()}
                ids = np.stack([part["key"], part["i"], part["block"]])
                part = _merged(part, np.append(True, (np.diff(ids) != 0).any(axis=0)))
                yield from told({k: v[:-1] for k, v in part.items()}, known, types, names)
                still = {k: v[-1:].copy() for k, v in part.items()}
                known[:] = known[-1:]
                still["key"][:] = 0
        if still is not None:
            yield from told(still, known, types, names)

    return run


def pair_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per group and pair of columns ``i <= j`` (places in ``columns``): n, means and centred sums over the rows that have both.

    Missing values and NaN are left out pair by pair. Two shuffles of sums, whatever the number of rows or columns.
    """
    keys, width = list(keys), min(BLOCK, len(columns))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    kinds = [f"`{n}` {df.schema[k].dataType.simpleString()}" for k, n in zip(keys, names, strict=True)]
    parts = rows.mapInArrow(_rows_to_pieces(len(keys), width), ", ".join([*kinds, PIECE]))
    dealt = parts.repartition(*names, "i", "block").sortWithinPartitions(*names, "i", "block")
    out = dealt.mapInArrow(_pieces_merged(len(keys), len(columns), width), ", ".join([*kinds, MOMENTS]))
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))
