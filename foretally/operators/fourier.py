"""Fourier transforms of series of any length, cut over many tasks.

A series of n = R x C steps is seen as a table of R rows and C columns (step j in row j div C).
The four-step form transforms columns, turns each entry by a root of unity, and transforms
rows; the entry of frequency k then lies in row k mod R.  Tasks hold a few columns, later a
few rows, of at most ``CELLS`` entries.  R is the largest divisor up to the square root.  If
that leaves rows longer than ``LONGEST`` (a long series of prime length, say), the transform is
written as a convolution with a chirp (Bluestein), whose length is a power of two.

Results are those of one transform of the whole series, whatever the blocks.
"""

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, spread_join
from foretally.session import durable

CELLS = 1 << 18
LONGEST = 1 << 17
SHAPE = "r long, c long, chirp boolean"


def shape_of(n: int) -> tuple[int, int, bool]:
    """(rows, columns, written as a convolution)."""
    rows = next(r for r in range(isqrt(n), 0, -1) if n % r == 0)
    if n // rows <= LONGEST:
        return rows, n // rows, False
    power = (2 * n - 1 - 1).bit_length()
    return 1 << power // 2, 1 << power - power // 2, True


def turn(k: np.ndarray, n: int, sign: int) -> np.ndarray:
    """exp(sign 2 pi i k / n), with whole turns taken off before rounding can matter."""
    return np.exp(sign * 2j * np.pi * (k % n) / n)


def complex_of(values, width: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float).reshape(-1, width, 2) @ np.array([1, 1j]) if len(values) else np.zeros((0, width), complex)


def real_of(z: np.ndarray) -> list:
    return list(np.stack([z.real, z.imag], axis=-1).reshape(len(z), -1))


def transform(elements: DataFrame, keys, width: int, sign: int = -1) -> DataFrame:
    """keys, n, r, c, j, z -> the same with j a frequency.  ``z`` holds ``width`` complex numbers as
    pairs; elements that are missing are zero.  ``sign`` +1 is the inverse without its factor."""
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in elements.schema if f.name in keys)
    fft = (lambda x, axis: np.fft.fft(x, axis=axis)) if sign < 0 else (lambda x, axis: np.fft.ifft(x, axis=axis) * x.shape[axis])
    some = lambda length: F.greatest(F.floor(F.lit(CELLS) / (F.col(length) * width)), F.lit(1).cast("long"))

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        head, (n, r, c, slab) = pdf[keys].iloc[0].tolist(), pdf[["n", "r", "c", "slab"]].iloc[0].astype(int)
        each = max(CELLS // (r * width), 1)
        first, last = slab * each, min(c, (slab + 1) * each)
        j = pdf["j"].to_numpy(np.int64)
        x = np.zeros((r, last - first, width), complex)
        x[j // c, j % c - first] = complex_of(pdf["z"], width)
        k1, at = np.arange(r)[:, None], np.arange(first, last)[None, :]
        y = fft(x, 0) * turn(k1 * at, r * c, sign)[:, :, None]
        rows = max(CELLS // (c * width), 1)
        out = [(*head, n, r, c, b // rows, first, y[b:b + rows].tobytes()) for b in range(0, r, rows)]
        return pd.DataFrame(out, columns=[*keys, "n", "r", "c", "slab", "first", "part"])

    def rows_(pdf: pd.DataFrame) -> pd.DataFrame:
        head, (n, r, c, slab) = pdf[keys].iloc[0].tolist(), pdf[["n", "r", "c", "slab"]].iloc[0].astype(int)
        each = max(CELLS // (c * width), 1)
        low, high = slab * each, min(r, (slab + 1) * each)
        x = np.zeros((high - low, c, width), complex)
        for first, part in zip(pdf["first"], pdf["part"]):
            piece = np.frombuffer(part, complex).reshape(high - low, -1, width)
            x[:, first:first + piece.shape[1]] = piece
        y = fft(x, 1)
        k = np.arange(low, high)[:, None] + r * np.arange(c)[None, :]
        return pd.DataFrame({**{name: [v] * k.size for name, v in zip(keys, head)}, "n": n, "r": r, "c": c, "j": k.ravel(), "z": real_of(y.reshape(-1, width))})

    placed = elements.withColumn("slab", F.floor((F.col("j") % F.col("c")) / some("r")))
    half = placed.groupBy(*keys, "slab").applyInPandas(columns, f"{fields}, n long, r long, c long, slab long, first long, part binary")
    return half.groupBy(*keys, "slab").applyInPandas(rows_, f"{fields}, n long, r long, c long, j long, z array<double>")


def _map(elements: DataFrame, width: int, fn) -> DataFrame:
    """Multiply each element by ``fn(n, j)``."""
    @F.pandas_udf("array<double>")
    def times(n: pd.Series, j: pd.Series, z: pd.Series) -> pd.Series:
        factor = fn(n.to_numpy(np.int64), j.to_numpy(np.int64))
        return pd.Series(real_of(complex_of(z, width) * factor[:, None]), dtype=object)

    return elements.withColumn("z", times("n", "j", "z"))


def chirp(n: np.ndarray, j: np.ndarray, sign: int) -> np.ndarray:
    """exp(sign pi i j^2 / n)."""
    return np.exp(sign * 1j * np.pi * (j * j % (2 * n)) / n)


def convolved(elements: DataFrame, keys, width: int) -> DataFrame:
    """The transform of length n by three of a power of two."""
    keys = list(keys)
    a = transform(_map(elements, width, lambda n, j: chirp(n, j, -1)), keys, width)
    ones = elements.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "r", "c")])
    steps = ones.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 65536))))
    steps = steps.repartition(*keys, "piece").withColumn(
        "i", F.explode(F.sequence(F.col("piece") * 65536, F.least((F.col("piece") + 1) * 65536, F.col("n")) - 1)))
    both = F.array_distinct(F.array(F.col("i"), (F.col("r") * F.col("c") - F.col("i")) % (F.col("r") * F.col("c"))))
    kernel = steps.select(*keys, "n", "r", "c", "i", F.explode(both).alias("j"), F.array(F.lit(1.0), F.lit(0.0)).alias("z"))

    @F.pandas_udf("array<double>")
    def wave(n: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(real_of(chirp(n.to_numpy(np.int64), i.to_numpy(np.int64), 1)[:, None]), dtype=object)

    b = transform(kernel.withColumn("z", wave("n", "i")).drop("i"), keys, 1)

    @F.pandas_udf("array<double>")
    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(real_of(complex_of(x, width) * complex_of(y, 1)), dtype=object)

    met = a.join(b.select(*keys, "j", F.col("z").alias("k")), [*keys, "j"]).withColumn("z", product("z", "k")).drop("k")
    back = transform(met, keys, width, 1).where("j < n")
    return _map(back, width, lambda n, j: chirp(n, j, -1)).withColumn("z", F.transform("z", lambda v: v / (F.col("r") * F.col("c"))))


def power_spectrum(rows: DataFrame, columns, keys=KEYS) -> DataFrame:
    """keys, n, bin, power: squared size of the transform of each column without its mean, for the
    frequencies 0 to n div 2.  ``t`` numbers the steps; steps that are missing count as the mean."""
    keys, columns = list(keys), list(columns)
    sizes = rows.groupBy(*keys).agg(F.min("t").alias("_t0"), (F.max("t") - F.min("t") + 1).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])

    @F.pandas_udf(SHAPE)
    def shapes(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_of(int(v)) for v in n], columns=["r", "c", "chirp"])

    shaped = sizes.withColumn("s", shapes("n")).select("*", "s.*").drop("s")
    z = F.concat(*[F.array(F.col(c) - F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(columns)])
    elements = durable(spread_join(rows.select(*keys, "t", *columns), shaped, keys).select(
        *keys, "n", "r", "c", "chirp", (F.col("t") - F.col("_t0")).alias("j"), z.alias("z")))
    width, plain = len(columns), elements.where("NOT chirp").drop("chirp")
    out = transform(plain, keys, width)
    hard = elements.where("chirp").drop("chirp")
    if hard.limit(1).count():
        out = out.unionByName(convolved(hard, keys, width))
    size = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pow(F.get("z", 2 * i), 2) + F.pow(F.get("z", 2 * i + 1), 2))
    return out.where("j <= floor(n / 2)").select(*keys, "n", F.col("j").alias("bin"), size.alias("power"))
