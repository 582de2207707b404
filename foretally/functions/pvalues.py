"""p-values over Arrow batches (there is no built-in distribution function for them)."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(stat: float, df: float) -> float:
    if stat is None or not math.isfinite(stat) or df < 1:
        return float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + stat * stat))


@F.pandas_udf(DoubleType())
def student_t_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a whole batch at once."""
    t, n = stat.to_numpy(float), df.to_numpy(float)
    fit = np.isfinite(t) & (n >= 1)
    out = np.full(t.size, np.nan)
    out[fit] = beta_tail(n[fit] / 2, 0.5, n[fit] / (n[fit] + t[fit] ** 2))
    return pd.Series(out)


def beta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), elementwise, by its continued fraction."""
    b = np.full_like(x, b)
    turn = x > (a + 1) / (a + b + 2)  # there the other tail converges faster
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    steps = 400
    value = np.zeros_like(y)
    for m in range(steps, 0, -1):  # from the last term inwards
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m - 1) * (p + q + m - 1) * y / ((p + 2 * m - 2) * (p + 2 * m - 1))
        value = odd / (1 + even / (1 + value))
    tail = np.where(y <= 0, 0.0, front / (1 + value))
    return np.where(turn, 1 - tail, tail)


def u_greater(u: float, n1: int, n2: int, ties: float) -> float:
    """P(U >= u): exact counts for small samples without ties, else the normal form."""
    if n1 <= 0 or n2 <= 0:
        return float("nan")
    if ties == 0 and min(n1, n2) <= 8:
        ways = np.zeros((n1 + 1, n1 * n2 + 1))
        ways[0, 0] = 1.0
        for k in range(1, n1 + n2 + 1):  # choose which ranks belong to sample 1
            for i in range(min(k, n1), 0, -1):
                shift = k - i
                if shift <= n2:
                    ways[i, shift:] += ways[i - 1, : n1 * n2 + 1 - shift]
        return float(ways[n1, int(math.ceil(u)):].sum() / ways[n1].sum())
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return float("nan")
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([u_greater(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)], dtype=float)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the hypergeometric probabilities not above that of the seen table."""
    rows, cols, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, rows + cols - n), min(rows, cols)
    ks = np.arange(lo, hi + 1)
    lg = np.vectorize(math.lgamma)
    logp = (math.lgamma(rows + 1) + math.lgamma(n - rows + 1) + math.lgamma(cols + 1) + math.lgamma(n - cols + 1)
            - math.lgamma(n + 1) - lg(ks + 1.0) - lg(rows - ks + 1.0) - lg(cols - ks + 1.0)
            - lg(n - rows - cols + ks + 1.0))
    seen = logp[a - lo]
    return float(min(1.0, np.exp(logp[logp <= seen + 1e-7]).sum()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype=float)
