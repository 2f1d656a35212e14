"""Small dense algebra on per-group moment arrays, batched over the rows of an Arrow batch.

Spark has already reduced every group to one row of means and centred cross-products; these functions
see one row per group, never its trials.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOUBLES = T.ArrayType(T.DoubleType())
FIT_TYPE = T.StructType(
    [
        T.StructField("coef", DOUBLES),
        T.StructField("unscaled_cov", DOUBLES),
        T.StructField("rss", T.DoubleType()),
        T.StructField("rank", T.LongType()),
    ]
)
#: A column is aliased if less than this share of its variance is left beside the columns before it.
ALIASED = 1e-12
PCA_TYPE = T.StructType([T.StructField("variances", DOUBLES), T.StructField("loadings", T.ArrayType(DOUBLES))])


def _stacked(rows: pd.Series, size: int) -> np.ndarray:
    """The rows' arrays as one matrix; NaN throughout where an array is missing or of another size."""
    out = np.full((len(rows), size), np.nan)
    fits = np.array([v is not None and len(v) == size for v in rows], dtype=bool)
    if fits.any():
        out[fits] = np.concatenate([v for v, ok in zip(rows, fits, strict=True) if ok]).astype(float).reshape(-1, size)
    return out


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


def independent_columns(standard: np.ndarray) -> list[int]:
    """Columns of a correlation matrix, in order, that aren't combinations of the ones kept before."""
    kept: list[int] = []
    for j in range(len(standard)):
        left = standard[j, j]
        if kept:
            beside = standard[np.ix_(kept, [j])][:, 0]
            left -= beside @ np.linalg.solve(standard[np.ix_(kept, kept)], beside)
        if standard[j, j] > 0 and left > ALIASED:
            kept.append(j)
    return kept


@F.pandas_udf(FIT_TYPE)
def solve_least_squares(n: pd.Series, means: pd.Series, cross: pd.Series) -> pd.DataFrame:
    """Least squares from centred moments of (x1..xk, y).

    ``means`` holds k + 1 means and ``cross`` the (k + 1)^2 centred cross-products. Gives the intercept
    and slopes, the unscaled covariance of all k + 1 coefficients, the residual sum of squares and the number of slopes
    that could be told apart. A column that the ones before it determine is aliased: its slope and covariances are
    missing, and the others are those of the model without it. Groups with too few rows give NULL.
    """
    out = {name: [None] * len(n) for name in FIT_TYPE.names}
    sizes = [len(m) for m in means if m is not None]
    if not sizes:
        return _frame(out)
    width = sizes[0]
    k = width - 1
    every_mean, every_cross = _stacked(means, width), _stacked(cross, width * width)
    usable = np.flatnonzero(~np.isnan(every_mean).any(1) & ~np.isnan(every_cross).any(1) & (n.to_numpy() > 1))
    if not len(usable):
        return _frame(out)
    count = n.to_numpy(dtype=float)[usable]
    mean, moment = every_mean[usable], every_cross[usable].reshape(-1, width, width)
    sxx, sxy, syy = moment[:, :k, :k], moment[:, :k, k], moment[:, k, k]
    scale = np.sqrt(np.einsum("gii->gi", sxx))
    safe = np.where(scale > 0, scale, 1.0)
    standard = sxx / (safe[:, :, None] * safe[:, None, :])
    plain = (scale > 0).all(axis=1) & (np.linalg.eigvalsh(standard)[:, 0] > 1e-12)
    inverse = np.linalg.inv(np.where(plain[:, None, None], standard, np.eye(k)))
    rank = np.full(len(usable), k)
    for g in np.flatnonzero(~plain):  # aliased terms are rare
        kept = independent_columns(standard[g])
        inverse[g], rank[g] = 0.0, len(kept)
        if kept:
            inverse[g][np.ix_(kept, kept)] = np.linalg.inv(standard[g][np.ix_(kept, kept)])
    inverse = inverse / (safe[:, :, None] * safe[:, None, :])
    slope = np.einsum("gij,gj->gi", inverse, sxy)
    intercept = mean[:, k] - np.einsum("gi,gi->g", slope, mean[:, :k])
    # the full quadratic form: rounding in the slopes then enters squared
    rss = syy - 2 * np.einsum("gi,gi->g", slope, sxy) + np.einsum("gi,gij,gj->g", slope, sxx, slope)
    rss = np.maximum(rss, 0.0)
    cov = np.empty((len(usable), width, width))
    pull = np.einsum("gij,gj->gi", inverse, mean[:, :k])
    cov[:, 1:, 1:] = inverse
    cov[:, 0, 1:] = cov[:, 1:, 0] = -pull
    cov[:, 0, 0] = 1 / count + np.einsum("gi,gi->g", pull, mean[:, :k])
    coef = np.column_stack([intercept, slope])
    gone = np.column_stack([np.zeros(len(usable), bool), np.einsum("gii->gi", inverse) == 0])
    coefs = np.where(gone, None, coef).tolist()
    flat = np.where(gone[:, :, None] | gone[:, None, :], None, cov).reshape(len(usable), -1).tolist()
    for g in np.flatnonzero(count > rank + 1):
        row = usable[g]
        out["coef"][row], out["unscaled_cov"][row], out["rss"][row], out["rank"][row] = coefs[g], flat[g], float(rss[g]), int(rank[g])
    return _frame(out)


@F.pandas_udf(PCA_TYPE)
def decompose_correlations(corr: pd.Series) -> pd.DataFrame:
    """Eigenvalues (largest first) and eigenvectors of flattened correlation matrices.

    Each eigenvector's entry of largest magnitude is positive.
    """
    out = {name: [None] * len(corr) for name in PCA_TYPE.names}
    sizes = [len(c) for c in corr if c is not None]
    if not sizes:
        return _frame(out)
    p = int(round(sizes[0] ** 0.5))
    every = _stacked(corr, p * p)
    usable = np.flatnonzero(~np.isnan(every).any(1))
    if not len(usable):
        return _frame(out)
    matrix = every[usable].reshape(-1, p, p)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = np.maximum(values[:, ::-1], 0.0), vectors[:, :, ::-1].transpose(0, 2, 1)
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], axis=2)
    vectors = vectors * np.where(top < 0, -1.0, 1.0)
    for row, spectrum, basis in zip(usable, values.tolist(), vectors.tolist(), strict=True):
        out["variances"][row], out["loadings"][row] = spectrum, basis
    return _frame(out)
