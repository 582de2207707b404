"""Delay vectors, forecast targets and feature expansions as column expressions."""

from itertools import combinations, combinations_with_replacement
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import BLOCK_ROWS, KEYS, in_block, with_halo


def delays(panel: DataFrame, taps: int, stride: int = 1, horizon: int = 0, keys=KEYS, column: str = "x",
           prefix: str = "d", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add d0 (now), d1, ... taps, left-padded with the first value, and the target ``y``.

    ``y`` is the value ``horizon`` steps ahead (NULL past the end).  Lags reach back a
    fixed number of rows, so blocks with a halo give the whole-series answer.
    """
    back = (taps - 1) * stride
    rows = with_halo(panel, back, horizon, block_rows)
    w = in_block(keys)
    first = F.first(column).over(w)
    added = [F.coalesce(F.lag(column, j * stride).over(w), first).alias(f"{prefix}{j}") if j
             else F.col(column).alias(f"{prefix}0") for j in range(taps)]
    if horizon:
        added.append(F.lead(column, horizon).over(w).alias("y"))
    return rows.select("*", *added).where("home").drop("home")


def delay_row(panel: DataFrame, columns, taps: int, stride: int = 1, keys=KEYS, prefix: str = "d",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Delays of several columns at once: array ``<column>_lags``, newest first."""
    rows = with_halo(panel, (taps - 1) * stride, 0, block_rows)
    w = in_block(keys)
    out = []
    for c in columns:
        first = F.first(c).over(w)
        out.append(F.array(*[F.coalesce(F.lag(c, j * stride).over(w), first) if j else F.col(c)
                             for j in range(taps)]).alias(f"{c}_lags"))
    return rows.select("*", *out).where("home").drop("home")


def taps_of(taps: int, prefix: str = "d", oldest_first: bool = False) -> list[Column]:
    cols = [F.col(f"{prefix}{j}") for j in range(taps)]
    return cols[::-1] if oldest_first else cols


def train_and_test(rows: DataFrame, taps: int, stride: int, horizon: int) -> DataFrame:
    """Keep the rows a windowed fit trains on or is tested on, with ``part`` naming which.

    Training starts after the washout and the first full window and stops ``horizon``
    before the end of train; testing starts at the test segment.
    """
    start = F.greatest(F.col("washout"), F.lit((taps - 1) * stride))
    part = (F.when((F.col("t") >= start) & (F.col("t") < F.col("train_end") - horizon), "train")
            .when((F.col("t") >= F.col("val_end")) & (F.col("t") < F.col("n") - horizon), "test"))
    return rows.withColumn("part", part).where(F.col("part").isNotNull())


def product(cols) -> Column:
    return reduce(mul, cols)


def monomials(cols, degree: int, bias: bool = True, linear: bool = True) -> list[Column]:
    """Bias, the taps, and every monomial of degree 2..degree."""
    out = [F.lit(1.0)] if bias else []
    if linear:
        out += list(cols)
    for d in range(2, degree + 1):
        out += [product(c) for c in combinations_with_replacement(cols, d)]
    return out


def normed_monomials(cols, degree: int) -> list[Column]:
    """Bias, the window norm, and monomials of the window divided by its norm."""
    norm = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in cols])) + F.lit(1e-12)
    unit = [c / norm for c in cols]
    return [F.lit(1.0), norm, *monomials(unit, degree, bias=False)]


def squares(cols, interactions: bool = False, linear: bool = True) -> list[Column]:
    """Squares, optional pairwise products, optional linear part."""
    out = list(cols) if linear else []
    out += [c * c for c in cols]
    if interactions:
        out += [a * b for a, b in combinations(cols, 2)]
    return out


def random_layer(cols, weights, bias) -> list[Column]:
    """tanh(W w + b) with a fixed weight table, as plain expressions."""
    return [F.tanh(reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in zip(row, cols)]) + F.lit(float(b)))
            for row, b in zip(weights, bias)]


def chebyshev(cols, degree: int, clip: float = 1e-6) -> list[Column]:
    """Bias, Chebyshev polynomials 1..degree of each tap (taps in [0, 1]), all products."""
    base = []
    for c in cols:
        z = F.least(F.greatest(2 * c - 1, F.lit(-1.0 + clip)), F.lit(1.0 - clip))
        base += [F.cos(F.lit(float(j)) * F.acos(z)) for j in range(1, degree + 1)]
    return [F.lit(1.0), *base, *[a * b for a, b in combinations_with_replacement(base, 2)]]


def angle(value: Column, scale: float = 1.0, span: float = 3.141592653589793) -> Column:
    """Input value to an angle: scale x range x value."""
    return F.lit(float(scale)) * F.lit(float(span)) * value


def column_block(features: Column, block: int, keep: int, repeats: int) -> Column:
    """The leading ``keep`` entries of each of ``repeats`` blocks of width ``block``."""
    pieces = [F.slice(features, v * block + 1, keep) for v in range(repeats)]
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)
