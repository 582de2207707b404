"""Bootstraps whose draws are a function of (seed, resample, position).

The draws come from a hash, so every executor makes its own and a recomputed task makes
the same ones.  ``draw`` may be replaced by any other function of the same three numbers.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import BLOCK_ROWS, block_of, cogroup_blocks, sorted_blocks, spread_join
from foretally.operators.ridge import add_up
from foretally.session import durable

CELLS = 1 << 20  # numbers of a resample table held at once


class Draw:
    """A position below n from (b, j, seed): ``column`` as an expression, ``numbers`` for numpy arrays."""

    def __init__(self, column, numbers):
        self.column, self.numbers = column, numbers

    def __call__(self, b, j, n, seed: int = 0):
        return self.column(b, j, n, seed)


def _congruential(b, j, n, seed: int = 0):
    x = ((b * 7919 + j * 104729 + 12345 + seed) % 1000003) * 48271 % 2147483647
    return (x * 16807 % 2147483647) % n


# fixed values: the five primes of xxHash64
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _spun(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xx_long(value: np.ndarray, h: np.ndarray) -> np.ndarray:
    """xxHash64 of one long on top of the hash so far."""
    p1, p2, p3, p4, p5 = PRIMES
    h = (h + p5 + np.uint64(8)) ^ (_spun(value * p2, 31) * p1)
    h = _spun(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _hashed(b, j, n, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.asarray(42, np.uint64)
        for v in (np.asarray(seed, np.int64), b, j):
            h = _xx_long(np.asarray(v, np.int64).astype(np.uint64), h)
    return h.astype(np.int64) % n


hash_draw = Draw(lambda b, j, n, seed=0: F.pmod(F.xxhash64(F.lit(seed).cast("long"), b, j), n), _hashed)
# a closed form any SQL engine can repeat: used where results are cross-checked
congruential_draw = Draw(_congruential, _congruential)


def block_starts(cells: DataFrame, keys, n_boot: int, block_length: int, draw=hash_draw, seed: int = 0) -> DataFrame:
    """Circular block starts: keys, n, b, j, start, width (the last block may be shorter)."""
    keys = list(keys)
    boots = cells.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    boots = boots.repartition(*keys, "b")  # one long series still spreads over tasks
    last = F.ceil(F.col("n") / F.lit(block_length)).cast("int") - 1
    each = boots.select("*", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    b, j = F.col("b").cast("long"), F.col("j").cast("long")
    width = F.least(F.lit(block_length).cast("long"), F.col("n") - j * block_length)
    return each.withColumn("start", draw(b, j, F.col("n"), seed)).withColumn("width", width)


def block_means(wide: DataFrame, columns, keys, n_boot: int, block_length: int, draw: Draw = hash_draw, seed: int = 0,
                time: str = "t", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bootstrap mean of each column per (cell, b).  ``time`` must count 0..n-1 per cell.

    A slice of a cell makes the circular blocks of all resamples itself and adds up what of
    them falls inside, by two look-ups in its own running totals; one row of sums per slice
    leaves the task, and neither blocks nor resampled rows are ever rows of a table.
    """
    keys, columns = list(keys), list(columns)
    width = len(columns)
    cut = wide.select(*keys, F.col(time).alias("t"), *columns).withColumn("_cut", block_of(F.col("t"), block_rows))
    cells = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema if f.name in keys)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n, low = int(pdf["n"].iloc[0]), int(pdf["t"].iloc[0])
        high = low + len(pdf)
        upto = np.vstack([np.zeros(width), pdf[columns].to_numpy(float).cumsum(axis=0)])
        j = np.arange(-(-n // block_length), dtype=np.int64)
        long = np.minimum(block_length, n - j * block_length)
        out = np.zeros((n_boot, width))
        inside = lambda t: upto[np.clip(t, low, high) - low]
        each = max(1, CELLS // (len(j) * width))
        for a in range(0, n_boot, each):
            b = np.arange(a, min(n_boot, a + each), dtype=np.int64)
            start = draw.numbers(b[:, None], j[None, :], n, seed)
            end = start + long
            over = np.maximum(end - n, 0)  # what goes round to the beginning
            part = inside(np.minimum(end, n)) - inside(start) + inside(over) - inside(np.zeros_like(over))
            out[b] = part.sum(axis=1) / n
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), n, out.ravel())], columns=[*keys, "n", "sums"])

    parts = spread_join(cut, cells, keys).groupBy(*keys, "_cut").applyInPandas(sums, f"{fields}, n long, sums array<double>")
    total = add_up(parts, keys)
    rows = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda i: F.slice("sums", i * width + 1, F.lit(width))))
    return total.select(*keys, rows.alias("b", "m")).select(*keys, "b", *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def confidence_set(boot_means: DataFrame, full_means: DataFrame, models, keys) -> DataFrame:
    """Model Confidence Set by the range statistic (Hansen, Lunde and Nason, 2011).

    Per cell there are n_boot rows and one row of ``l_i`` columns.  Who is eliminated next
    depends on the losses and one covariance matrix only, so the order comes first.  Taken
    backwards the sets grow by one model at a time, and each resample's largest statistic is a
    running maximum: every pair of models is looked at once for all rounds, and never more than
    n_boot x models numbers are held.
    """
    keys, models = list(keys), list(models)
    size = len(models)
    cols = [f"l_{i}" for i in range(size)]
    full = full_means.select(*keys, *[F.col(c).alias(f"f_{c}") for c in cols])
    joined = boot_means.join(full, keys)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in keys)

    def ratio(value, variance):
        """value / sqrt(variance), 0 where there is no variance."""
        return np.divide(value, np.sqrt(np.maximum(variance, 0)), out=np.zeros(np.broadcast(value, variance).shape), where=variance > 1e-30)

    def test_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        loss = pdf[[f"f_{c}" for c in cols]].iloc[0].to_numpy(float)
        moved = pdf.sort_values("b")[cols].to_numpy(float) - loss
        cov = np.cov(moved, rowvar=False).reshape(size, size)
        spread = cov.diagonal()[:, None] + cov.diagonal()[None, :] - 2 * cov
        inside = np.ones(size, bool)
        order = []
        for _ in range(size - 1):
            block = cov[np.ix_(inside, inside)]
            own = block.diagonal() - 2 * block.mean(axis=1) + block.mean()  # variance of a model's gap to the mean
            out = int(np.flatnonzero(inside)[np.argmax(ratio(loss[inside] - loss[inside].mean(), own))])
            order.append(out)
            inside[out] = False
        order.append(int(np.flatnonzero(inside)[0]))
        seen, drawn, p_values = 0.0, np.zeros(len(moved)), [1.0]
        for at in range(size - 2, -1, -1):
            i, rest = order[at], order[at + 1:]
            seen = max(seen, np.abs(ratio(loss[i] - loss[rest], spread[i, rest])).max())
            drawn = np.maximum(drawn, np.abs(ratio(moved[:, [i]] - moved[:, rest], spread[i, rest][None, :])).max(axis=1))
            p_values.append((drawn >= seen).mean())
        p_values = np.maximum.accumulate(p_values[:0:-1]).tolist() + [1.0]
        found = pd.DataFrame({"model": [models[i] for i in order], "eliminated": range(size), "mcs_pvalue": p_values})
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "model", "eliminated", "mcs_pvalue"]]

    sets = joined.groupBy(*keys).applyInPandas(test_cell, f"{key_fields}, model string, eliminated long, mcs_pvalue double")
    return sets.withColumn("in_set_10", F.col("mcs_pvalue") >= 0.10).withColumn("in_set_25", F.col("mcs_pvalue") >= 0.25)


def times_drawn(b: np.ndarray, members: np.ndarray, n: int, draw: Draw, seed: int) -> np.ndarray:
    """[resample, member]: how often a closed form draws each of the positions ``members`` in n slots."""
    order = np.argsort(members)
    at = members[order]
    picked = draw.numbers(b[:, None], np.arange(n, dtype=np.int64)[None, :], n, seed)
    place = np.minimum(np.searchsorted(at, picked), len(at) - 1)
    hit = at[place] == picked
    flat = (np.arange(len(b))[:, None] * len(at) + place)[hit]
    counts = np.bincount(flat, minlength=len(b) * len(at)).reshape(len(b), len(at))
    out = np.empty_like(counts)
    out[:, order] = counts
    return out


def stream_of(*parts) -> np.random.Generator:
    """Random numbers that depend on the parts alone."""
    return np.random.default_rng([zlib.crc32(repr(p).encode()) for p in parts])


def resample_stats(pairs: DataFrame, keys, value: str, n_boot: int, draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """keys, b, mean, median of n_boot resamples with replacement of each group's values.

    No resampled row is made.  Values are cut into ordered slices.  How many draws of a
    resample fall into each slice is settled first, by splitting n draws over the slices
    (a binomial for each slice, given those before it); a slice then knows which ranks it
    holds, draws how often each of its own values comes, and gives a sum and, if the middle
    ranks are its own, their values.  With a closed-form ``draw`` (by the position ``j``, 0..n-1
    per group) slices count what it draws instead.  What is shuffled is n_boot rows a slice.
    """
    keys = list(keys)
    ids = [*keys, "run"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys)
    cut = sorted_blocks(pairs.select(*keys, "j", F.col(value).cast("double").alias("v")), keys, ["v", "j"])
    sizes = cut.groupBy(*ids).agg(F.count(F.lit(1)).alias("m"))
    totals = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    every = np.arange(n_boot, dtype=np.int64)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        members, n = pdf["j"].to_numpy(np.int64), int(pdf["n"].iloc[0])
        each = max(1, CELLS // max(n, len(members)))
        counts = np.concatenate([times_drawn(every[a:a + each], members, n, draw, seed).sum(axis=1) for a in range(0, n_boot, each)])
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in ids), len(members), counts)], columns=[*ids, "m", "count"])

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Draws in each slice and in the slices before it; one row a slice."""
        pdf = pdf.sort_values("run")
        m = pdf["m"].to_numpy(np.int64)
        if draw is not None:
            counts = np.stack(pdf["count"].to_numpy())
        else:
            rng, left, counts = stream_of(seed, *(pdf[k].iloc[0] for k in keys)), np.full(n_boot, m.sum()), []
            for size, rest in zip(m, m[::-1].cumsum()[::-1]):
                counts.append(rng.binomial(left, size / rest))
                left = left - counts[-1]
            counts = np.stack(counts)
        before = counts.cumsum(axis=0) - counts
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in ids}, "n": int(m.sum()), "count": list(counts), "before": list(before)})

    if draw is None:
        known = sizes.withColumn("count", F.lit(None).cast("array<long>"))
    else:
        known = spread_join(cut, totals, keys, "j").groupBy(*ids).applyInPandas(counted, f"{fields}, run long, m long, count array<long>")
    heads = durable(known.groupBy(*keys).applyInPandas(placed, f"{fields}, run long, n long, count array<long>, before array<long>"))

    def summed(pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "b", "s", "low", "high"]
        if not len(pdf) or not len(other):
            return pd.DataFrame([], columns=names)
        head, pdf = other.iloc[0], pdf.sort_values(["v", "j"])
        v, members, n = pdf["v"].to_numpy(float), pdf["j"].to_numpy(np.int64), int(head["n"])
        count, before = np.asarray(head["count"], np.int64), np.asarray(head["before"], np.int64)
        rng, each, out = stream_of(seed, *(head[k] for k in ids)), max(1, CELLS // max(n if draw else 0, len(v))), []
        for a in range(0, n_boot, each):
            b = every[a:a + each]
            times = times_drawn(b, members, n, draw, seed) if draw else rng.multinomial(count[b], np.full(len(v), 1 / len(v)))
            upto = before[b][:, None] + times.cumsum(axis=1)
            part = {"b": b, "s": times @ v}
            for name, rank in (("low", (n - 1) // 2), ("high", n // 2)):
                mine = (before[b] <= rank) & (rank < upto[:, -1])
                part[name] = np.where(mine, v[np.minimum((upto <= rank).sum(axis=1), len(v) - 1)], np.nan)
            out.append(pd.DataFrame(part))
        return pd.concat(out).assign(**{k: head[k] for k in keys})[names]

    parts = cogroup_blocks(cut, heads, ids, summed, f"{fields}, b long, s double, low double, high double")
    real = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    got = parts.groupBy(*keys, "b").agg(F.sum("s").alias("s"), real("low").alias("low"), real("high").alias("high"))
    return spread_join(got, totals, keys, "b").select(*keys, "b", (F.col("s") / F.col("n")).alias("mean"), ((F.col("low") + F.col("high")) / 2).alias("median"))


def interval(boots: DataFrame, keys, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of ``stat`` over the resamples of each group."""
    q = F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return boots.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"))


def bootstrap_ci(pairs: DataFrame, keys, value: str = "d", stat: str = "median", n_boot: int = 10_000,
                 alpha: float = 0.05, draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """Estimate, interval and the excludes-zero flag of the median or mean of ``value``."""
    fn = {"median": F.median, "mean": F.avg}[stat]
    boots = resample_stats(pairs, keys, value, n_boot, draw, seed).select(*keys, "b", F.col(stat).alias("stat"))
    point = pairs.groupBy(*keys).agg(fn(value).alias("estimate"), F.count(F.lit(1)).alias("n_pairs"))
    ci = interval(boots, keys, alpha)
    zero = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return point.join(ci, list(keys)).withColumn("excludes_zero", zero)
