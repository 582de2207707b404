"""Elastic net per series: coordinate descent on Gram sums of one scan of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from foretally.operators.blocks import KEYS
from foretally.operators.ridge import gram

TOLERANCE = 1e-12
SWEEPS = 100_000


def descend(cov: np.ndarray, right: np.ndarray, lasso: float, ridge: float) -> np.ndarray:
    """Minimise w'Cw/2 - r'w + lasso |w| + ridge w'w/2, one coordinate after another.

    A run starts with a large penalty and carries its weights on to smaller ones; at each only
    coordinates that may become non-zero are visited until those left out agree.
    """
    w, n = np.zeros(len(right)), len(right)
    top = np.abs(right).max(initial=0.0)
    path = np.geomspace(top, lasso, 8)[:-1].tolist() if top > lasso > 0 else []
    for penalty in [*path, lasso]:
        active = (w != 0) | (np.abs(right - cov @ w) >= penalty)
        for _ in range(SWEEPS):
            moved = 0.0
            for j in np.flatnonzero(active):
                rho = right[j] - cov[j] @ w + cov[j, j] * w[j]
                size = cov[j, j] + ridge
                new = np.sign(rho) * max(abs(rho) - penalty, 0.0) / size if size > 0 else 0.0
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved <= TOLERANCE * max(1.0, np.abs(w).max(initial=0.0)):
                missed = ~active & (np.abs(right - cov @ w) > penalty)
                if not missed.any():
                    break
                active |= missed
    return w[:n]


def elastic_fit(rows: DataFrame, features, target: Column, alpha: float = 1e-3, share: float = 0.5, keys=KEYS) -> DataFrame:
    """keys, n, w: weights on the raw features, the intercept last.  Features are standardised by
    the rows given; ``share`` of the penalty is the sum of absolute weights, the rest the squares.
    A constant feature gets the weight 0."""
    fs, width = [*features, F.lit(1.0)], len(list(features))

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        out, at = [], np.triu_indices(width + 1)
        for gv, bv in zip(g, b):
            full = np.zeros((width + 1, width + 1))
            full[at] = gv
            full = full + np.triu(full, 1).T
            n, sums, b_ = full[-1, -1], full[:-1, -1], np.asarray(bv, float)
            mean, mean_y = sums / n, b_[-1] / n
            cov = full[:-1, :-1] / n - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
            spread[spread <= 1e-12 * np.maximum(np.abs(mean), 1.0)] = 0.0
            inv = np.divide(1.0, spread, out=np.zeros(width), where=spread > 0)
            w = descend(cov * np.outer(inv, inv), (b_[:-1] / n - mean * mean_y) * inv, alpha * share, alpha * (1 - share)) * inv
            out.append(np.r_[w, mean_y - w @ mean])
        return pd.Series(out)

    sums = gram(rows, fs, [target], keys)
    return sums.select(*keys, "n", solve("g", "b").alias("w"))
