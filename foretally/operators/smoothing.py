"""Exponential smoothing and Theta forecasts with parameters fitted to the history.

Level and trend are linear in what came before, so blocks of a series run from zero side by
side, their end states are chained (one row a block), and blocks run again from their true
starts.  Many candidate parameters run at once as columns of one state.

* Smoothing: the squared error on train is searched over a grid of ``GRID`` x ``GRID`` points, then
  around each series' best point with ever smaller steps; the best point so far is always
  among the candidates, so no round can be worse than the one before.
* Theta: errors are added up as time goes on, and each forecast takes the parameter with the
  least error so far: a fit of its own for every step, in one pass over the rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, cogroup_blocks, running_sums
from foretally.operators.ridge import add_up
from foretally.operators.windows import delays
from foretally.session import durable

GRID = 33
ROUNDS, AROUND, SHRINK = 6, 9, 4.0
THETA_GRID = tuple(a / 100 for a in range(1, 100))
CELLS = 1 << 19  # states held at once inside a task
RUN = 64         # values of a run; the runs of a chunk go side by side


def powers_of(alphas: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """The first ``RUN`` powers of the step from (level, trend) to the next, per candidate."""
    out, power = np.empty((RUN, 2, 2, len(alphas))), np.eye(2)[:, :, None] * np.ones(len(alphas))
    for i in range(RUN):
        up = (1 - alphas) * (power[0] + power[1])
        out[i] = power = np.stack([up, betas * (up - power[0]) + (1 - betas) * power[1]])
    return out


def chunk_of(candidates: int) -> int:
    """Values smoothed at once: their states of all candidates stay in the cache."""
    return max(CELLS // candidates // RUN, 1) * RUN


def smooth(x: np.ndarray, level: np.ndarray, trend: np.ndarray, alphas: np.ndarray, betas: np.ndarray, powers: np.ndarray | None = None):
    """(level, trend) after each value, one column per candidate.  The state after k values is what they lead to from
    zero plus the k-th power of the step times the state before, so runs of ``RUN`` values go side by side."""
    size, each = len(alphas), -(-len(x) // RUN)
    powers = powers_of(alphas, betas) if powers is None else powers
    keep_a, keep_b = 1 - alphas, 1 - betas
    padded = np.zeros(each * RUN)
    padded[:len(x)] = x
    padded = padded.reshape(each, RUN)
    levels, trends = np.empty((each, RUN, size)), np.empty((each, RUN, size))
    l, t = np.zeros((each, size)), np.zeros((each, size))
    for i in range(RUN):
        new = alphas * padded[:, i, None] + keep_a * (l + t)
        t = betas * (new - l) + keep_b * t
        l = new
        levels[:, i], trends[:, i] = l, t
    for j in range(each):
        levels[j] += powers[:, 0, 0] * level + powers[:, 0, 1] * trend
        trends[j] += powers[:, 1, 0] * level + powers[:, 1, 1] * trend
        level, trend = levels[j, -1], trends[j, -1]
    return levels.reshape(-1, size)[:len(x)], trends.reshape(-1, size)[:len(x)]


def _fields(df: DataFrame, keys) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)


def _first(x: np.ndarray, t0: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The state before a block from zero; a series begins as if its first value had come before."""
    return np.full(size, x[0] if t0 == 0 else 0.0), np.zeros(size)


def block_heads(rows: DataFrame, params: DataFrame, keys) -> DataFrame:
    """keys, block, alphas, betas, start: parameters and true first state (level, then trend) of each block."""
    keys = list(keys)
    blocks = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("m")).join(params, keys)
    last = rows.groupBy(*keys).agg(F.max("block").alias("top"))
    heads = durable(blocks.join(last, keys))
    inner = heads.where("block < top")

    def ends(pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "block", "end"]
        if not len(pdf) or not len(other):
            return pd.DataFrame([], columns=names)
        pdf, head = pdf.sort_values("t"), other.iloc[0]
        alphas, betas, x = np.asarray(head["alphas"], float), np.asarray(head["betas"], float), pdf["x"].to_numpy(float)
        level, trend = _first(x, int(pdf["t"].iloc[0]), len(alphas))
        chunk, powers = chunk_of(len(alphas)), powers_of(alphas, betas)
        for a in range(0, len(x), chunk):
            levels, trends = smooth(x[a:a + chunk], level, trend, alphas, betas, powers)
            level, trend = levels[-1], trends[-1]
        return pd.DataFrame([(*(head[k] for k in keys), head["block"], np.r_[level, trend])], columns=names)

    def fold(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now, a, b = tuple(getattr(row, k) for k in keys), np.asarray(row.alphas, float), np.asarray(row.betas, float)
                if now != key:
                    key, state = now, np.zeros((2, len(a)))
                out.append((*now, row.block, row.alphas, row.betas, state.ravel()))
                if row.end is not None:
                    step = np.stack([np.stack([1 - a, 1 - a], -1), np.stack([-a * b, 1 - a * b], -1)], -2)
                    power = np.stack([np.linalg.matrix_power(s, int(row.m)) for s in step])
                    state = np.einsum("gij,jg->ig", power, state) + np.asarray(row.end, float).reshape(2, -1)
            yield pd.DataFrame(out, columns=[*keys, "block", "alphas", "betas", "start"])

    typed = _fields(rows, keys)
    some = rows.join(inner.select(*keys, "block"), [*keys, "block"], "left_semi").select(*keys, "block", "t", "x")
    got = cogroup_blocks(some, inner, [*keys, "block"], ends, f"{typed}, block long, end array<double>")
    placed = heads.join(got, [*keys, "block"], "left").repartition(*keys).sortWithinPartitions(*keys, "block")
    return durable(placed.mapInPandas(fold, f"{typed}, block long, alphas array<double>, betas array<double>, start array<double>"))


def block_runs(rows: DataFrame, heads: DataFrame, keys, fn, schema: str) -> DataFrame:
    """``fn(rows of a run, levels, trends, head)`` over runs of bounded size of each block."""
    def run(pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(pdf) and len(other):
            pdf, head = pdf.sort_values("t"), other.iloc[0]
            alphas, betas, x = np.asarray(head["alphas"], float), np.asarray(head["betas"], float), pdf["x"].to_numpy(float)
            start = np.asarray(head["start"], float).reshape(2, -1)
            level, trend = _first(x, int(pdf["t"].iloc[0]), len(alphas)) if head["block"] == 0 else (start[0], start[1])
            chunk, powers = chunk_of(len(alphas)), powers_of(alphas, betas)
            for a in range(0, len(x), chunk):
                levels, trends = smooth(x[a:a + chunk], level, trend, alphas, betas, powers)
                parts.append(fn(pdf.iloc[a:a + chunk], levels, trends, head, level))
                level, trend = levels[-1], trends[-1]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])

    return cogroup_blocks(rows, heads, [*keys, "block"], run, schema)


def fitted_smoothing(rows: DataFrame, keys, horizon: int, trend: bool = True) -> DataFrame:
    """keys, alphas, betas (one each), sse: the parameters of least squared error on train."""
    keys = list(keys)
    at = (np.arange(GRID) + 0.5) / GRID
    a, b = (g.ravel() for g in np.meshgrid(at, at if trend else np.zeros(1)))
    lists = lambda v: F.lit([float(x) for x in v])
    params = rows.select(*keys).distinct().select(*keys, lists(a).alias("alphas"), lists(b).alias("betas"))

    def errors(pdf, levels, trends, head, _):
        t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy(float)
        train = (t >= pdf["washout"].to_numpy()) & (t + horizon < pdf["train_end"].to_numpy())
        gap = (levels + horizon * trends - y[:, None])[train]
        return pd.DataFrame([(*(head[k] for k in keys), 0, (gap ** 2).sum(axis=0))], columns=[*keys, "n", "sums"])

    def narrowed(round_: int):
        step = 1 / GRID / SHRINK ** round_
        near = step * np.arange(-(AROUND // 2), AROUND // 2 + 1) / (AROUND // 2)

        @F.pandas_udf("alphas array<double>, betas array<double>, sse double")
        def pick(alphas: pd.Series, betas: pd.Series, sums: pd.Series) -> pd.DataFrame:
            out = []
            for a, b, s in zip(alphas, betas, sums):
                i = int(np.argmin(s))
                da, db = (g.ravel() for g in np.meshgrid(near, near if trend else np.zeros(1)))
                keep = round_ == ROUNDS
                out.append(([a[i]] if keep else np.clip(a[i] + da, 1e-4, 1.0), [b[i]] if keep else np.clip(b[i] + db, 0.0, 1.0), s[i]))
            return pd.DataFrame(out, columns=["alphas", "betas", "sse"])

        return pick

    schema = f"{_fields(rows, keys)}, n long, sums array<double>"
    for round_ in range(ROUNDS + 1):
        sums = add_up(block_runs(rows, block_heads(rows, params, keys), keys, errors, schema), keys)
        chosen = params.join(sums, keys).select(*keys, narrowed(round_)("alphas", "betas", "sums").alias("c"))
        params = durable(chosen.select(*keys, "c.alphas", "c.betas", "c.sse")).drop(*(["sse"] if round_ < ROUNDS else []))
    return params


def smoothing_forecasts(labelled: DataFrame, keys=KEYS, horizon: int = 1, grid=None) -> DataFrame:
    """Trend smoothing: parameters from train, then run on through the test segment.  A ``grid`` of
    one (alpha, beta) fixes them."""
    keys = list(keys)
    rows = durable(delays(labelled, 1, 1, horizon, keys).select(*keys, "block", "t", "x", "y", "washout", "train_end", "val_end"))
    if grid is None:
        params = fitted_smoothing(rows, keys, horizon).drop("sse")
    else:
        (a, b), = grid
        params = rows.select(*keys).distinct().select(*keys, F.array(F.lit(float(a))).alias("alphas"), F.array(F.lit(float(b))).alias("betas"))

    def forecast(pdf, levels, trends, head, _):
        out = pdf[[*keys, "t"]].assign(y_true=pdf["y"], y_pred=(levels + horizon * trends)[:, 0])
        return out[(pdf["t"] >= pdf["val_end"]) & pdf["y"].notna()]

    return block_runs(rows, block_heads(rows, params, keys), keys, forecast, f"{_fields(rows, keys)}, t long, y_true double, y_pred double")


def theta_forecasts(labelled: DataFrame, keys=KEYS, horizon: int = 1, grid=THETA_GRID) -> DataFrame:
    """Smoothed level plus half the slope of the line fitted to the history so far.

    Smoothing parameter and line are fitted anew at every step, to all values up to it: the
    parameter by the sum of squared one-step errors, the line by two running sums.
    """
    keys = list(keys)
    rows = durable(delays(labelled, 1, 1, horizon, keys).select(*keys, "block", "t", "x", "y", "val_end"))
    alphas = F.lit([float(a) for a in grid])
    params = rows.select(*keys).distinct().select(*keys, alphas.alias("alphas"), F.lit([0.0] * len(grid)).alias("betas"))
    heads = block_heads(rows, params, keys)
    typed = _fields(rows, keys)

    def gaps(pdf, levels, before):
        """One-step squared errors: the level before each value against the value; none for a series' first."""
        ahead = np.vstack([before, levels[:-1]])
        return (ahead - pdf["x"].to_numpy(float)[:, None]) ** 2 * (pdf["t"].to_numpy() > 0)[:, None]

    def totals(pdf, levels, trends, head, before):
        return pd.DataFrame([(*(head[k] for k in keys), head["block"], 0, gaps(pdf, levels, before).sum(axis=0))], columns=[*keys, "block", "n", "sums"])

    each = add_up(block_runs(rows, heads, keys, totals, f"{typed}, block long, n long, sums array<double>"), [*keys, "block"])

    def upto(batches):
        key, total = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                key, total = now, np.zeros(len(grid)) if now != key else total
                out.append((*now, row.block, total))
                total = total + np.asarray(row.sums, float)
            yield pd.DataFrame(out, columns=[*keys, "block", "errors"])

    so_far = each.repartition(*keys).sortWithinPartitions(*keys, "block").mapInPandas(upto, f"{typed}, block long, errors array<double>")

    def chosen(pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        parts, names = [], [*keys, "t", "x", "y", "val_end", "level", "alpha"]
        if len(pdf) and len(other):
            pdf, head = pdf.sort_values("t"), other.iloc[0]
            a, x = np.asarray(head["alphas"], float), pdf["x"].to_numpy(float)
            total = np.asarray(head["errors"], float)
            level, trend = _first(x, int(pdf["t"].iloc[0]), len(a)) if head["block"] == 0 else tuple(np.asarray(head["start"], float).reshape(2, -1))
            chunk, powers = chunk_of(len(a)), powers_of(a, np.zeros(len(a)))
            for at in range(0, len(x), chunk):
                body = pdf.iloc[at:at + chunk]
                levels, trends = smooth(x[at:at + chunk], level, trend, a, np.zeros(len(a)), powers)
                errors = total + gaps(body, levels, level).cumsum(axis=0)
                best = errors.argmin(axis=1)
                parts.append(body[[*keys, "t", "x", "y", "val_end"]].assign(level=levels[np.arange(len(best)), best], alpha=a[best]))
                level, trend, total = levels[-1], trends[-1], errors[-1]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame([], columns=names)

    full = heads.join(so_far, [*keys, "block"])
    level = cogroup_blocks(rows, full, [*keys, "block"], chosen, f"{typed}, t long, x double, y double, val_end long, level double, alpha double")
    t = F.col("t").cast("double")
    summed = running_sums(level, keys, ["t"], {"sx": F.col("x"), "stx": t * F.col("x")})
    n = t + 1
    st, stt = t * (t + 1) / 2, t * (t + 1) * (2 * t + 1) / 6
    spread = n * stt - st * st
    slope = (n * F.col("stx") - st * F.col("sx")) / F.when(spread > 0, spread)
    ahead = (horizon - 1) + (1 - F.pow(1 - F.col("alpha"), n)) / F.col("alpha")
    pred = F.col("level") + 0.5 * F.coalesce(slope, F.lit(0.0)) * ahead
    return summed.where((F.col("t") >= F.col("val_end")) & F.col("y").isNotNull() & ~F.isnan("y")).select(
        *keys, "t", F.col("y").alias("y_true"), pred.alias("y_pred"))
