"""Whitening of embeddings: leading principal components by block Jacobi-Davidson.

Each entry ``c`` of a vector becomes the integer ``x = floor(256 * c)``.  The covariance is
that of the *fit list*, every distinct x-vector once, with divisor n.  It is never formed:
the only thing Spark computes with it is the product with a few columns, a sum over blocks
of vectors of ``(x - mean) ((x - mean) . w)`` with one partial sum per task, and all work on
the ``width`` x ``a few`` numbers that come back is done in numpy by the driver.

The components are found by Jacobi-Davidson:

* a block Krylov start gives a subspace that leans towards the leading components,
* Rayleigh-Ritz in the subspace gives values, vectors and residuals,
* for each wanted vector the correction equation, projected to the complement of all
  current and locked vectors, is solved by a few steps of MINRES; the systems of one round
  move in step, so that one pass over the vectors serves all of them,
* vectors whose residual has reached double precision are locked, in order, and the others
  go on in their complement,
* a fresh block started in the complement of the locked vectors looks for a component that
  was overlooked; then all residuals are taken again from a product of their own.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are
dropped.  Vectors of different widths count as zero beyond their ends; entries outside the
range of a long are clipped to it.  Repeated vectors are one entry of the fit list and each
gets its rows.  A component whose variance is zero to double precision (fewer distinct
vectors than components, constant vectors) is left out, so a row may get fewer components
or none.  Of equal variances any basis of their space is taken, the same for all rows.
``deviation`` is null where the exact number does not fit a long.  An empty table gives no
rows.  Other columns of the input are only seen through ``carry`` and cannot clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import column
from foretally.session import durable

BLOCK_BYTES = 1 << 20  # of packed vectors in one row of the stored fit list
GUARD = 4              # vectors followed beyond the wanted ones
START = 4              # products of the block Krylov start
INNER = 6               # at most so many MINRES steps for one correction
SUBSPACE = 96          # the subspace is restarted beyond so many columns
ROUNDS = 60
EPS = float(np.finfo(float).eps)
SEED = 20

BLOCKS = "n long, high array<long>, low array<long>, data binary"


def integers(vector: Column) -> Column:
    """The x-vector of a vector of numbers, null where the vector is to be dropped."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(c * 256.0)))


def matrix(lists, width: int) -> np.ndarray:
    """A batch of lists of longs as rows of equal width, padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(fit: DataFrame, width: int) -> DataFrame:
    """The fit list as rows of about ``BLOCK_BYTES``, with sums of the upper and lower halves of
    the entries (so that sums stay exact)."""
    rows = max(1, BLOCK_BYTES // (8 * width))

    def run(batches):
        names = pa.schema([("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("data", pa.binary())])

        def block(x):
            return pa.RecordBatch.from_arrays([
                pa.array([len(x)]), pa.array([(x >> 32).sum(axis=0).tolist()], pa.list_(pa.int64())),
                pa.array([(x & 0xFFFFFFFF).sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())], schema=names)

        held = np.zeros((0, width), np.int64)
        for batch in batches:
            held = np.concatenate([held, matrix(batch.column(0), width)])
            while len(held) >= rows:
                yield block(held[:rows])
                held = held[rows:]
        if len(held):
            yield block(held)

    return fit.mapInArrow(run, BLOCKS)


class FitList:
    """The stored fit list: its size, exact sums, mean, and products with its covariance."""

    def __init__(self, blocks: DataFrame, width: int):
        self.blocks, self.width = blocks, width
        halves = (blocks.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("d", "s"))
                  .groupBy("d").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).collect())
        self.n = halves[0]["n"] if halves else 0
        self.sums = [0] * width
        for r in halves:
            self.sums[r["d"]] = (r["high"] << 32) + r["low"]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)
        self.products = 0

    def gather(self, of_block, size: int) -> np.ndarray:
        """Sum over all blocks of ``of_block(centred block)``, ``size`` numbers; one partial sum a task."""
        mean, width = self.mean, self.width

        def run(batches):
            total = None
            for batch in batches:
                for data in batch.column(0):
                    x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, width) - mean
                    part = of_block(x).ravel()
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

        parts = self.blocks.select("data").mapInArrow(run, "at long, value double")
        out = np.zeros(size)
        for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r["value"]
        return out / self.n

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``w``."""
        self.products += 1
        return self.gather(lambda x: x.T @ (x @ w), w.size).reshape(w.shape)

    def trace(self) -> float:
        return float(self.gather(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0])

    def identity_error(self, whitener: np.ndarray) -> float:
        """Largest absolute entry of (covariance of the whitened fit list) - identity."""
        k = whitener.shape[1]

        def both(x):
            y = x @ whitener
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

        got = self.gather(both, k + k * k)
        return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max(initial=0.0))


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns spanning ``new`` in the complement of ``against``; what vanishes there is left out."""
    scale = np.linalg.norm(new, axis=0)
    new = new[:, scale > 0] / scale[scale > 0]
    for _ in range(3):
        for q in against:
            new = new - q @ (q.T @ new)
    if not new.shape[1]:
        return new
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    for q in against:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def correct(product, shifts: np.ndarray, residuals: np.ndarray, away: np.ndarray, wanted: float) -> np.ndarray:
    """Solve P (C - shift) P t = -residual, P the projection away from ``away``, for all columns
    in step by MINRES, until each residual has shrunk to ``wanted`` or ``INNER`` steps are done.
    Returns the corrections and, behind them, the Lanczos vectors they are made of: these cost
    no pass of their own, and the subspace gains by all of them."""
    def project(t):
        return t - away @ (away.T @ t)

    right = project(-residuals)
    start = np.linalg.norm(right, axis=0)
    at = right / np.where(start > 0, start, 1.0)
    basis, diag, off = [at], [], []
    for step in range(INNER):
        image = project(product(at) - shifts * at)
        diag.append((at * image).sum(axis=0))
        for old in basis:  # the short recurrence, with full orthogonalisation
            image = image - old * (old * image).sum(axis=0)
        size = np.linalg.norm(image, axis=0)
        off.append(size)
        solved = [shortest(start[i], [d[i] for d in diag], [o[i] for o in off]) for i in range(len(start))]
        if all(rest <= wanted * start[i] for i, (_, rest) in enumerate(solved)) or step == INNER - 1 or not (size > 0).any():
            break
        at = image / np.where(size > 0, size, 1.0)
        basis.append(at)
    fixes = sum(np.array([y[j] for y, _ in solved]) * basis[j] for j in range(len(diag)))
    return np.concatenate([fixes, *basis[:len(diag)]], axis=1)


def shortest(start: float, diag: list[float], off: list[float]) -> tuple[np.ndarray, float]:
    """MINRES's small problem: coefficients of the smallest residual in the Lanczos basis, and its norm."""
    m = len(diag)
    t = np.zeros((m + 1, m))
    for j in range(m):
        t[j, j], t[j + 1, j] = diag[j], off[j]
        if j:
            t[j - 1, j] = off[j - 1]
    goal = np.r_[start, np.zeros(m)]
    y = np.linalg.lstsq(t, goal, rcond=None)[0]
    return y, float(np.linalg.norm(goal - t @ y))


def krylov(product, first: np.ndarray, depth: int, locked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block Krylov subspace in the complement of ``locked``, and its images."""
    base = np.zeros((first.shape[0], 0))
    images, new = base, orthonormal(first, locked)
    for _ in range(depth):
        if not new.shape[1]:
            break
        image = product(new)
        base, images = np.c_[base, new], np.c_[images, image]
        new = orthonormal(image, locked, base)
    return base, images


def rayleigh_ritz(base: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and images of the best approximations in a subspace."""
    inner = base.T @ images
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], base @ turn[:, ::-1], images @ turn[:, ::-1]


def leading(product, width: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading values (falling), their vectors, and the largest residual as a share of
    the leading value."""
    k = min(k, width)
    rng = np.random.default_rng(SEED)
    locked, top, probed, stuck, best = np.zeros((width, 0)), 0.0, False, 0, np.inf
    base, images = krylov(product, rng.normal(size=(width, k + GUARD)), START, locked)
    for round_ in range(ROUNDS):
        values, base, images = rayleigh_ritz(base, images)
        rest = images - base * values
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        top = max(top, values.max(initial=0.0))
        limit = 8 * EPS * np.sqrt(width) * top
        wanted = k - locked.shape[1]
        worst = norms[:wanted].max(initial=0.0)
        stuck, best = (0, worst) if worst < best / 2 else (stuck + 1, best)
        if stuck > 3:  # as small as the rounding of the sums lets it become
            limit = max(limit, 1e-12 * top)
        done = 0
        while done < min(wanted, len(values)) and norms[done] <= limit:
            done += 1
        if done:
            locked, best = np.linalg.qr(np.c_[locked, base[:, :done]])[0], np.inf
            values, rest, norms = values[done:], rest[:, done:], norms[done:]
            base, images, wanted = base[:, done:], images[:, done:], wanted - done
        if not wanted:
            found, vectors, image = rayleigh_ritz(locked, product(locked))
            if not probed and k < width:
                probed = True
                base, images = krylov(product, rng.normal(size=(width, k)), START, locked)
                seen = rayleigh_ritz(base, images)[0].max(initial=0.0)
                if seen > found[-1] + limit:  # one was overlooked
                    base, images, locked = np.c_[vectors, base], np.c_[image, images], locked[:, :0]
                    continue
            worst = np.linalg.norm(image - vectors * found, axis=0).max(initial=0.0)
            return found, vectors, float(worst / top) if top else 0.0
        if base.shape[1] > SUBSPACE:
            base, images = base[:, :SUBSPACE // 2], images[:, :SUBSPACE // 2]
        new = np.zeros((width, 0))
        if len(values) >= wanted:
            open_ = np.flatnonzero(norms[:wanted] > limit)
            away = np.linalg.qr(np.c_[locked, base[:, :wanted]])[0]
            new = orthonormal(correct(product, values[open_], rest[:, open_], away, 0.5 ** (round_ + 2)), locked, base)
        if not new.shape[1]:
            new = orthonormal(rng.normal(size=(width, wanted)), locked, base)
        base, images = np.c_[base, new], np.c_[images, product(new) if new.shape[1] else new]
    raise ArithmeticError(f"no convergence in {ROUNDS} rounds")


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df`` that keeps a vector and per component: ``row`` (the columns in
    ``carry``, all by default), ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error`` and ``residual`` (largest residual over the leading value)."""
    carry = df.columns if carry is None else carry
    seen = df.select(F.struct(*[column(df, c).alias(c) for c in carry]).alias("row"), integers(column(df, vector)).alias("x"))
    rows = seen.where(F.col("x").isNotNull())
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    kind = rows.select("row").schema["row"].dataType.simpleString()
    if not width:
        fit, k = None, 0
    else:
        fit = FitList(durable(packed(rows.select("x").distinct(), width)), width)
        values, vectors, residual = leading(fit.product, width, components)
        trace = fit.trace()
        k = int((values > 64 * EPS * np.sqrt(width) * max(trace, 0.0)).sum())
    if not k:
        return rows.select("row", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"),
            ("identity_error", "double"), ("residual", "double"))]).where(F.lit(False))
    whitener = vectors[:, :k] / np.sqrt(values[:k])
    error, n, sums, mean = fit.identity_error(whitener), fit.n, fit.sums, fit.mean

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            flat = ((x - mean) @ whitener).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), lists], names=["row", "deviation", "w"])

    made = rows.mapInArrow(run, f"row {kind}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:k]])
    spread = made.select("row", "deviation", F.posexplode("w").alias("at", "whitened"))
    return spread.select("row", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                         F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.lit(residual).alias("residual"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, exact; null beyond a long."""
    if not len(x):
        return []
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if most < 1 << 62 and x.shape[1] * most * most < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]
