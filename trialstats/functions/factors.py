"""Triangular factors of centred design matrices, made per Arrow batch and merged: least squares without squared columns.

A factor of some rows is their number, the column means, and R with R'R equal to the centred cross-products, from an
orthogonal decomposition of the rows themselves. Cross-products square a design's condition number, so they lose twice
the digits; R doesn't. Factors merge like the rows they stand for: the stacked R of all parts and one weighted row per
part for the distance of its mean have the merged factor as theirs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.functions.linalg import DOUBLES, FIT_TYPE, _frame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups whose factors a task keeps open; beyond it they are handed on and begun anew.
OPEN = 4096
#: Parts of one group that a merge takes at a time.
TOGETHER = 64
#: A column is aliased if less than this share of its length is left beside the columns before it.
ALIASED = 1e-11
#: ``white`` (k x k) turns centred columns into independent ones of length 1: leverages are 1/n and its squares.
FACTOR_FIT = T.StructType([*FIT_TYPE.fields, T.StructField("white", DOUBLES)])
PARTS = "n long, means array<double>, factor array<double>"

Part = tuple[int, np.ndarray, np.ndarray]


def factor_of(rows: np.ndarray) -> Part:
    """The factor of a matrix's rows."""
    means = rows.mean(axis=0)
    return len(rows), means, _triangle(rows - means)


def _triangle(rows: np.ndarray) -> np.ndarray:
    width = rows.shape[1]
    out = np.zeros((width, width))
    if np.isfinite(rows).all():
        r = np.linalg.qr(rows, mode="r")
        out[: len(r)] = r
    else:
        out[:] = np.nan
    return out


def merged(parts: Sequence[Part]) -> Part:
    """The factor of all rows that the parts stand for."""
    if len(parts) == 1:
        return parts[0]
    counts = np.array([p[0] for p in parts], float)
    means = np.array([p[1] for p in parts])
    total = counts @ means / counts.sum()
    apart = np.sqrt(counts)[:, None] * (means - total)
    return int(counts.sum()), total, _triangle(np.concatenate([*(p[2] for p in parts), apart]))


class _Open:
    """Factors of groups in progress, by their key values."""

    def __init__(self):
        self.parts: dict[tuple, list[Part]] = {}

    def add(self, key: tuple, part: Part) -> None:
        held = self.parts.setdefault(key, [])
        held.append(part)
        if len(held) >= TOGETHER:
            self.parts[key] = [merged(held)]

    def batch(self, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        done = [(key, *merged(held)) for key, held in self.parts.items()]
        self.parts = {}
        columns = [pa.array([_value(d[0][i]) for d in done], kind) for i, kind in enumerate(types)]
        lists = [pa.array([np.ravel(d[k]).tolist() for d in done], pa.list_(pa.float64())) for k in (2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64()), *lists], [*names, "n", "means", "factor"])


class _NaN:
    """One value for all NaN keys."""


def _hashable(value):
    return _NaN if isinstance(value, float) and value != value else value


def _value(value):
    return float("nan") if value is _NaN else value


def _groups(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key values and row numbers of each group of a batch; the keys are the first ``width`` columns."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(width):
        coded = batch.column(i).dictionary_encode(null_encoding="encode")
        indices = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * len(coded.dictionary) + indices, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(code[order]) != 0)), len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = int(order[a])
        yield tuple(_hashable(batch.column(i)[first].as_py()) for i in range(width)), order[a:b]


def _rows_to_factors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open()
        types, names = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            types, names = list(batch.schema.types[:width]), batch.schema.names[:width]
            matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[width:]])
            for key, rows in _groups(batch, width):
                held.add(key, factor_of(matrix[rows]))
            if len(held.parts) > OPEN:
                yield held.batch(types, names)
        if held.parts:
            yield held.batch(types, names)

    return run


def _factors_merged(width: int):
    """Parts sorted by key: one group is open at a time, and at most TOGETHER of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open()
        types, names = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            types, names = list(batch.schema.types[:width]), batch.schema.names[:width]
            counts = batch.column("n").to_pylist()
            means = batch.column("means").flatten().to_numpy().reshape(batch.num_rows, -1)
            factors = batch.column("factor").flatten().to_numpy().reshape(batch.num_rows, means.shape[1], -1)
            for key, rows in _groups(batch, width):
                for i in rows.tolist():
                    held.add(key, (counts[i], means[i], factors[i]))
            tail = tuple(_hashable(batch.column(i)[batch.num_rows - 1].as_py()) for i in range(width))
            still = held.parts.pop(tail)  # may go on in the next batch
            if held.parts:
                yield held.batch(types, names)
            held.parts = {tail: still}
        if held.parts:
            yield held.batch(types, names)

    return run


def group_factors(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, n, means, factor`` per group, of double ``columns`` without missing values.

    Every task hands on one small factor per group it has met; only those are shuffled, and they are merged as a sorted stream,
    so a hot group costs one row per task and neither side holds a group's rows.
    """
    keys = list(keys)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, PARTS])
    parts = df.select(*keys, *columns).mapInArrow(_rows_to_factors(len(keys)), schema)
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    return dealt.mapInArrow(_factors_merged(len(keys)), schema)


def _back(upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve with an upper triangle."""
    out = np.zeros_like(right)
    for i in range(len(upper) - 1, -1, -1):
        out[i] = (right[i] - upper[i, i + 1 :] @ out[i + 1 :]) / upper[i, i]
    return out


def solve_one(n: int, means: np.ndarray, factor: np.ndarray) -> tuple | None:
    """(coef, unscaled_cov, rss, rank, white) of the last column on the others; None with too few rows."""
    k = factor.shape[1] - 1
    if not np.isfinite(factor).all() or n < 2:
        return None
    length = np.linalg.norm(factor, axis=0)
    unit = factor / np.where(length > 0, length, 1.0)
    kept: list[int] = []
    basis = np.zeros((len(factor), 0))
    for j in range(k):  # a column that the ones before it determine moves out
        left = unit[:, j]
        for _ in range(2):  # twice is enough to be orthogonal to rounding
            left = left - basis @ (basis.T @ left)
        size = np.linalg.norm(left)
        if size > ALIASED:
            kept.append(j)
            basis = np.column_stack([basis, left / size])
    rank = len(kept)
    if n <= rank + 1:
        return None
    upper = np.linalg.qr(unit[:, [*kept, k]], mode="r")
    top, y = upper[:rank, :rank], upper[:rank, rank]
    slope = _back(top, y) * length[k] / length[kept]
    rss = float((upper[rank, rank] * length[k]) ** 2) if len(upper) > rank else 0.0
    inverse = _back(top, np.eye(rank)) / length[kept][:, None]
    cov = inverse @ inverse.T
    pull = means[kept] @ inverse
    coef: list = [float(means[k] - means[kept] @ slope), *([None] * k)]
    unscaled: list[list] = [[None] * (k + 1) for _ in range(k + 1)]
    unscaled[0][0] = float(1 / n + pull @ pull)
    beside = -(cov @ means[kept])
    for a, i in enumerate(kept):
        coef[i + 1] = float(slope[a])
        unscaled[0][i + 1] = unscaled[i + 1][0] = float(beside[a])
        for b, j in enumerate(kept):
            unscaled[i + 1][j + 1] = float(cov[a, b])
    white = np.zeros((k, k))
    white[np.ix_(range(rank), kept)] = inverse.T
    return coef, [x for row in unscaled for x in row], rss, rank, white.ravel().tolist()


@F.pandas_udf(FACTOR_FIT)
def solve_factor(n: pd.Series, means: pd.Series, factor: pd.Series, index: pd.Series) -> pd.DataFrame:
    """Least squares of the last of the columns ``index`` on the others, per group, from the group's factor."""
    out = {name: [None] * len(n) for name in FACTOR_FIT.names}
    for row, (count, mean, flat, at) in enumerate(zip(n, means, factor, index, strict=True)):
        if flat is None:
            continue
        at = np.asarray(at, np.int64)
        mean = np.asarray(mean, float)
        fit = solve_one(int(count), mean[at], np.asarray(flat, float).reshape(len(mean), -1)[:, at])
        if fit is not None:
            for name, value in zip(FACTOR_FIT.names, fit, strict=True):
                out[name][row] = value
    return _frame(out)
