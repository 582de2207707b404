"""Studies over any pipeline axis from one pass over the rows.

A study changes a scaler, its scope, the split, the washout, the look-back, the horizon, the
penalty, a post-processing or an encoding scale, and fits a ridge model for each level.
None of that needs the rows again.  Time is cut where any level begins or ends a segment; for
every (series, interval) one pass adds up the products of a *lattice* of columns: the lags
of the series, its targets, squares, leaky averages and encoded angles, and a one.  Then

* a segment of any level is a sum of intervals,
* a scaler is an affine map, so its features are the lattice times a small matrix, and the
  normal equations of a level are a congruence of the summed products,
* test errors are a quadratic form of the weights in the products of the test segment.

A level therefore costs a small solve per series, and rows are never multiplied.  Products
are kept on the min-max scale of the whole series, so that they are of similar size; errors
far below 1e-7 of the spread are lost to cancellation.

Series too short for a level (no train row, or no test row) have null scores.
"""

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, attach, with_halo
from foretally.operators.recursion import leaky
from foretally.operators.ridge import add_up
from foretally.operators.scaling import fit_scaler
from foretally.operators.split import FRACTIONS, label_split, split_bounds
from foretally.session import durable

ROWS = 8192  # rows multiplied out at once inside a task


@dataclass(frozen=True)
class Level:
    """One configuration: the base with some axes changed, under the name of what changed."""

    axis: str = "base"
    level: str = "base"
    scaler: str = "minmax"
    scope: str = "train"
    split: tuple = FRACTIONS
    washout: int = 20
    lookback: int = 2
    horizon: int = 1
    alpha: float = 1e-6
    postprocess: str = "none"
    encoding: float | None = None  # None: plain lags; else cosines of scale x pi x value


def leak_of(postprocess: str) -> float | None:
    return float(postprocess.removeprefix("leaky")) if postprocess.startswith("leaky") else None


class Columns:
    """Which columns the levels need, and where each lies."""

    def __init__(self, levels: list[Level]):
        base = [x for x in levels if x.postprocess == "none" and x.encoding is None]
        most = max((x.lookback for x in levels), default=1)
        shaped = max((x.lookback for x in levels if x not in base), default=0)
        self.horizons = sorted({x.horizon for x in levels})
        self.leaks = sorted({leak_of(x.postprocess) for x in levels} - {None})
        self.scales = sorted({x.encoding for x in levels} - {None})
        names = [("one",)] + [("lag", j) for j in range(most)] + [("target", h) for h in self.horizons]
        names += [("square", j) for j in range(shaped)] if any(x.postprocess == "poly2" for x in levels) else []
        for e in self.leaks:
            names += [("ramp", e)] + [("leaky", e, j) for j in range(shaped)]
        names += [("angle", s, j) for s in self.scales for j in range(shaped)]
        self.names, self.at, self.lags, self.shaped = names, {n: i for i, n in enumerate(names)}, most, shaped

    def values(self, t: np.ndarray, u: np.ndarray, leaks: dict, first: float, start: float, slope: float, wanted: np.ndarray) -> np.ndarray:
        """The columns of the rows ``wanted`` (places in ``u``, which holds the rows a lag or lead away as well)."""
        out = np.empty((len(wanted), len(self.names)))
        time = t[wanted].astype(float)

        def back(of, j, pad):
            place = wanted - j
            return np.where(time < j, pad, of[np.maximum(place, 0)])

        for i, name in enumerate(self.names):
            kind = name[0]
            if kind == "one":
                out[:, i] = 1.0
            elif kind == "lag":
                out[:, i] = back(u, name[1], first)
            elif kind == "target":
                ahead = wanted + name[1]
                out[:, i] = np.where(ahead < len(u), u[np.minimum(ahead, len(u) - 1)], 0.0)  # past the end: never used
            elif kind == "square":
                out[:, i] = back(u, name[1], first) ** 2
            elif kind == "ramp":  # a leaky average of ones
                out[:, i] = 1 - (1 - name[1]) ** (time + 1)
            elif kind == "leaky":  # of a lag whose first entries are padded
                e, j = name[1:]
                padded = first * (1 - (1 - e) ** np.minimum(time + 1, j)) * (1 - e) ** np.maximum(time + 1 - j, 0)
                out[:, i] = back(leaks[e], j, 0.0) + padded
            elif kind == "angle":
                out[:, i] = np.cos(name[1] * np.pi * (start + slope * back(u, name[2], first)))
        return out

    def features(self, x: Level, shift: float, slope: float) -> np.ndarray:
        """Rows: the level's features as combinations of columns, the bias last."""
        rows = []
        unit = np.eye(len(self.names))
        one = unit[self.at["one",]]
        for j in range(x.lookback):
            plain = shift * one + slope * unit[self.at["lag", j]]
            if x.encoding is not None:
                rows.append(unit[self.at["angle", x.encoding, j]])
            elif leak_of(x.postprocess) is not None:
                e = leak_of(x.postprocess)
                rows.append(shift * unit[self.at["ramp", e]] + slope * unit[self.at["leaky", e, j]])
            else:
                rows.append(plain)
        if x.postprocess == "poly2":
            rows += [shift**2 * one + 2 * shift * slope * unit[self.at["lag", j]] + slope**2 * unit[self.at["square", j]] for j in range(x.lookback)]
        return np.array([*rows, one])


def bounds_of(n: int, fracs) -> tuple[int, int]:
    return int(np.floor(fracs[0] * n)), int(np.floor((fracs[0] + fracs[1]) * n))


def segment_of(x: Level, n: int, part: str) -> tuple[int, int]:
    """First row and end of a level's train, validation or test segment."""
    train_end, val_end = bounds_of(n, x.split)
    if part == "fit":  # what the scaler may see
        return (0, n) if x.scope == "global" else (min(x.washout, train_end), train_end)
    if part == "train":
        return max(x.washout, x.lookback - 1), train_end - x.horizon
    return (train_end, val_end - x.horizon) if part == "validation" else (val_end, n - x.horizon)


def cuts_of(levels: list[Level], n: int) -> np.ndarray:
    """All times at which a segment of some level begins or ends."""
    ends = {0, n}
    for x in levels:
        for part in ("fit", "train", "validation", "test"):
            ends.update(segment_of(x, n, part))
    return np.array(sorted(e for e in ends if 0 <= e <= n))


def check(levels: list[Level]) -> Level:
    """Encoded columns are made on the first level's min-max scaling."""
    base = levels[0]
    plain = ("scaler", "scope", "split", "washout")
    for x in levels:
        if x.encoding is not None and any(getattr(x, a) != getattr(base, a) for a in plain):
            raise ValueError(f"level {x.axis} {x.level}: encoded angles are made with the scaling of the first level")
        if x.encoding is not None and x.postprocess != "none":
            raise ValueError(f"level {x.axis} {x.level}: encoded angles take no post-processing")
    if base.scaler != "minmax":
        raise ValueError("the first level is scaled by minmax")
    return base


def intervals(panel: DataFrame, levels: list[Level], keys=KEYS) -> DataFrame:
    """keys, n, shift, scale, parts: per series the products, least and largest value of every interval."""
    keys, columns, base = list(keys), Columns(levels), check(levels)
    bounds = split_bounds(panel, keys, base.split, base.washout)
    first = panel.groupBy(*keys).agg(F.min_by("x", "t").alias("first"))
    of_base = fit_scaler(label_split(panel, bounds, keys, base.scope), "minmax", keys).select(*keys, F.col("shift").alias("base_shift"), F.col("scale").alias("base_scale"))
    whole = fit_scaler(label_split(panel, bounds, keys, "global"), "minmax", keys).drop("span", "offset")
    params = durable(whole.join(of_base, keys).join(first, keys))
    scaled = attach(panel, params, keys)
    on_scale = lambda c: (c - F.col("shift")) / F.col("scale")
    # a cosine of scale x pi x (first + slope x u); no scaling, no angle
    slope = F.coalesce(F.col("scale") / F.col("base_scale"), F.lit(0.0)).alias("slope")
    start = F.coalesce((F.col("shift") - F.col("base_shift")) / F.col("base_scale"), F.lit(0.0)).alias("start")
    rows = scaled.select(*keys, "block", "t", on_scale(F.col("x")).alias("u"), "n", on_scale(F.col("first")).alias("first"), start, slope)
    for i, e in enumerate(columns.leaks):
        rows = leaky(rows, e, keys, "u", f"leaky{i}")
    halo = with_halo(rows, columns.lags, max(columns.horizons))
    upper = np.triu_indices(len(columns.names))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, u, home = pdf["t"].to_numpy(np.int64), pdf["u"].to_numpy(float), np.flatnonzero(pdf["home"].to_numpy())
        n, head = int(pdf["n"].iloc[0]), [pdf[k].iloc[0] for k in keys]
        leaks = {e: pdf[f"leaky{i}"].to_numpy(float) for i, e in enumerate(columns.leaks)}
        of = np.searchsorted(cuts_of(levels, n), t[home], side="right") - 1
        out = []
        for interval in np.unique(of):
            mine, total = home[of == interval], 0.0
            for a in range(0, len(mine), ROWS):
                z = columns.values(t, u, leaks, *(float(pdf[c].iloc[0]) for c in ("first", "start", "slope")), mine[a:a + ROWS])
                total = total + z.T @ z
            out.append((*head, int(interval), n, u[mine].min(), u[mine].max(), total[upper]))
        return pd.DataFrame(out, columns=[*keys, "interval", "n", "least", "most", "sums"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema if f.name in keys)
    each = durable(halo.groupBy(*keys, "block").applyInPandas(products, f"{fields}, interval long, n long, least double, most double, sums array<double>"))
    sums = add_up(each, [*keys, "interval"])
    edges = each.groupBy(*keys, "interval").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    both = sums.join(edges, [*keys, "interval"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("interval", "least", "most", "sums"))).alias("parts"))
    return both.join(params.select(*keys, "n", "shift", "scale"), keys)


def robust_fits(panel: DataFrame, levels: list[Level], keys) -> DataFrame | None:
    """keys, robust: (median, quartile distance) for each fit that a robust level asks for."""
    fits, out = robust_keys(levels), None
    for i, (scope, split, washout) in enumerate(fits):
        labelled = label_split(panel, split_bounds(panel, keys, split, washout), keys, scope)
        got = fit_scaler(labelled, "robust", keys).select(*keys, F.array("shift", "scale").alias(f"q{i}"))
        out = got if out is None else out.join(got, list(keys), "left")
    return None if out is None else out.select(*keys, F.array(*[f"q{i}" for i in range(len(fits))]).alias("robust"))


def robust_keys(levels: list[Level]) -> list[tuple]:
    return sorted({(x.scope, x.split, x.washout) for x in levels if x.scaler == "robust"})


class Solver:
    """All levels of one series from its intervals."""

    def __init__(self, levels: list[Level], n: int, shift: float, scale: float, parts, robust):
        self.columns, self.n, self.shift, self.scale, self.robust = Columns(levels), n, shift, scale, robust
        self.wanted = robust_keys(levels)
        cuts = cuts_of(levels, n)
        self.low, self.high = [], []
        self.parts = {}
        width, upper = len(self.columns.names), np.triu_indices(len(self.columns.names))
        for p in parts:
            m = np.zeros((width, width))
            m[upper] = p["sums"]
            i = p["interval"]
            self.parts[int(cuts[i]), int(cuts[i + 1])] = (m + np.triu(m, 1).T, p["least"], p["most"])

    def within(self, a: int, b: int) -> list:
        return [v for (low, high), v in self.parts.items() if a <= low and high <= b]

    def total(self, a: int, b: int) -> np.ndarray:
        return sum((v[0] for v in self.within(a, b)), np.zeros((len(self.columns.names),) * 2))

    def scaling(self, x: Level) -> tuple[float, float]:
        """(shift, slope): the level's scaled value of a value on the lattice's scale."""
        if x.scaler in ("identity", "none"):
            return self.shift, self.scale
        span = segment_of(x, self.n, "fit")
        seen = self.within(*span)
        if not seen:
            return np.nan, np.nan
        if x.scaler == "minmax":
            low, high = min(v[1] for v in seen), max(v[2] for v in seen)
            slope = 1 / (high - low) if high > low else self.scale  # a spread of zero counts as one, for raw values
            return -low * slope, slope
        if x.scaler in ("standard", "standardize"):
            m, lag = self.total(*span), self.columns.at["lag", 0]
            mean = m[0, lag] / m[0, 0]
            spread = np.sqrt(max(m[lag, lag] / m[0, 0] - mean * mean, 0.0))
            slope = 1 / spread if spread > 0 else self.scale  # a spread of zero counts as one, for raw values
            return -mean * slope, slope
        if x.scaler == "robust":
            middle, distance = self.robust[self.wanted.index((x.scope, x.split, x.washout))]
            return (self.shift - middle) / distance, self.scale / distance
        raise ValueError(f"unknown scaler {x.scaler!r}")

    def score(self, x: Level, part: str = "test") -> tuple[int, float, float]:
        """(rows, RMSE, RMSE over the spread of the targets); null without a train or test row."""
        shift, slope = self.scaling(x)
        train, test = self.total(*segment_of(x, self.n, "train")), self.total(*segment_of(x, self.n, part))
        rows = int(round(test[0, 0]))
        if not np.isfinite(slope) or train[0, 0] < 1 or rows < 1:
            return rows, np.nan, np.nan
        f = self.columns.features(x, shift, slope)
        target = np.zeros(len(self.columns.names))
        target[self.columns.at["one",]], target[self.columns.at["target", x.horizon]] = shift, slope
        if x.postprocess == "zscore":
            mean = f[:-1] @ train[:, 0] / train[0, 0]
            spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", f[:-1], train, f[:-1]) / train[0, 0] - mean**2, 0.0))
            spread[spread <= 1e-8 * np.abs(mean)] = 1.0
            f[:-1] = (f[:-1] - mean[:, None] * f[-1]) / spread[:, None]
        gram = f @ train @ f.T + x.alpha * np.eye(len(f))
        try:
            w = np.linalg.solve(gram, f @ train @ target)
        except np.linalg.LinAlgError:
            w = np.linalg.pinv(gram) @ (f @ train @ target)
        gap = w @ f - target
        mse = max(float(gap @ test @ gap) / test[0, 0], 0.0)
        mean = target @ test[:, 0] / test[0, 0]
        spread = np.sqrt(max(float(target @ test @ target) / test[0, 0] - mean * mean, 0.0))
        return rows, float(np.sqrt(mse)), float(np.sqrt(mse) / spread) if spread > 0 else np.nan


def sweep(panel: DataFrame, levels: list[Level], keys=KEYS, segments=("test",)) -> DataFrame:
    """keys, axis, level, segment, scope, split, alpha, n_rows, rmse, nrmse of every level and series.
    The first level is the base."""
    keys = list(keys)
    parts = intervals(panel, levels, keys)
    robust = robust_fits(panel, levels, keys)
    parts = parts.join(robust, keys, "left") if robust is not None else parts.withColumn("robust", F.lit(None).cast("array<array<double>>"))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                of = Solver(levels, int(row.n), row.shift, row.scale, row.parts, row.robust)
                for i, x in enumerate(levels):
                    out += [(*(getattr(row, k) for k in keys), i, s, *of.score(x, s)) for s in segments]
            yield pd.DataFrame(out, columns=[*keys, "number", "segment", "n_rows", "rmse", "nrmse"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema if f.name in keys)
    got = parts.select(*keys, "n", "shift", "scale", "parts", "robust").mapInPandas(
        solve, f"{fields}, number int, segment string, n_rows long, rmse double, nrmse double")
    names = F.array(*[F.struct(F.lit(x.axis).alias("axis"), F.lit(x.level).alias("level"), F.lit(x.scope).alias("scope"),
                               F.lit(split_name(x.split)).alias("split"), F.lit(float(x.alpha)).alias("alpha"), F.lit(x.lookback).alias("lookback"))
                      for x in levels])
    score = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return got.select(*keys, F.get(names, F.col("number")).alias("l"), "segment", "n_rows", score("rmse"), score("nrmse")).select(
        *keys, "l.*", "segment", "n_rows", "rmse", "nrmse")


def split_name(fracs) -> str:
    return "/".join(f"{round(100 * f)}" for f in fracs)


def axis_levels(presets: dict, base: Level = Level()) -> list[Level]:
    """The base, then one level after another of every axis, all else as in the base."""
    out = [base]
    for axis, values in presets.items():
        for v in values:
            name = split_name(v) if axis == "split" else v if isinstance(v, str) else f"{v:g}"
            out.append(replace(base, axis=axis, level=name, **{axis: v}))
    return out


def leakage_levels(scopes, splits, alphas, base: Level = Level()) -> list[Level]:
    """The base, then scope x split x penalty."""
    return [base] + [replace(base, axis="leakage", level=f"{scope} {split_name(split)} {alpha:g}", scope=scope, split=split, alpha=alpha)
                     for scope in scopes for split in splits for alpha in alphas]
