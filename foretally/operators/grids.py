"""Studies over many configurations on shared work.

A variant (scaler, scope, split) only changes the per-series parameters, so the parameter
rows are multiplied, not the job: one pass scales, windows and sums all variants.  Every
look-back and penalty is then a small solve on a variant's Gram matrix.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from foretally.operators.blocks import KEYS, attach
from foretally.operators.ridge import behind_weights, gram_in_tasks, same
from foretally.operators.scaling import fit_scaler
from foretally.operators.split import FRACTIONS, label_split, split_bounds
from foretally.operators.windows import delays

VARIANT = ("scaler", "scope", "split")


def variant_parameters(panel: DataFrame, scalers, scopes, splits, washout: int, keys=KEYS) -> DataFrame:
    """Split bounds and scaler parameters of every variant: a few rows per series."""
    out = None
    for fracs in splits:
        bounds = split_bounds(panel, keys, fracs, washout)
        name = "/".join(f"{round(100 * f)}" for f in fracs)
        for scope in scopes:
            rows = label_split(panel, bounds, keys, scope)
            for kind in scalers:
                got = fit_scaler(rows, kind, keys).drop("n").join(bounds, list(keys)).select(
                    "*", F.lit(kind).alias("scaler"), F.lit(scope).alias("scope"), F.lit(name).alias("split"))
                out = got if out is None else out.unionByName(got)
    return out


def _solve_all(taps: int, combos):
    """Weights of every (lookback, alpha), padded to all taps, one after another."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        full = taps + 1
        iu = np.triu_indices(full)
        out = []
        for gv, bv in zip(g, b):
            m = np.zeros((full, full))
            m[iu] = gv
            m = m + m.T - np.diag(np.diag(m))
            row = []
            for lookback, alpha in combos:
                use = [*range(lookback), taps]
                w = np.zeros(full)
                w[use] = np.linalg.solve(m[np.ix_(use, use)] + alpha * np.eye(len(use)), np.asarray(bv)[use])
                row.append(w)
            out.append(np.concatenate(row))
        return pd.Series(out)

    return solve


def linear_grid(panel: DataFrame, scalers=("minmax",), scopes=("train",), splits=(FRACTIONS,), lookbacks=(2,),
                alphas=(1e-6,), washout: int = 20, horizon: int = 1, keys=KEYS) -> DataFrame:
    """keys, scaler, scope, split, segment, lookback, alpha, n_rows, rmse, nrmse."""
    taps = max(lookbacks)
    by = [*keys, *VARIANT]
    combos = [(lb, a) for lb in lookbacks for a in alphas]
    start = max(washout, taps - 1)
    params = variant_parameters(panel, scalers, scopes, splits, washout, keys)
    rows = attach(panel, params, keys)
    u = F.col("offset") + (F.col("x") - F.col("shift")) / F.col("scale") * F.col("span")
    scaled = rows.select(*by, "block", "t", u.alias("u"), "n", "train_end", "val_end")
    seen = delays(scaled, taps, 1, horizon, by, column="u").where("y IS NOT NULL")
    t, cols = F.col("t"), [f"d{j}" for j in range(taps)]
    train = seen.where((t >= start) & (t < F.col("train_end") - horizon))
    sums = gram_in_tasks(train, cols, same, taps, by)
    weights = sums.select(*by, "n", _solve_all(taps, combos)("g", "b").alias("w"))
    tested = (F.when((t >= F.col("train_end")) & (t < F.col("val_end") - horizon), "validation")
              .when(t >= F.col("val_end"), "test"))
    judged = seen.withColumn("segment", tested).where("segment IS NOT NULL")

    def errors(body: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
        w = w.reshape(len(combos), taps + 1)
        out = []
        for segment, part in body.groupby("segment"):
            gap = part[cols].to_numpy(float) @ w[:, :-1].T + w[:, -1] - part["y"].to_numpy(float)[:, None]
            head = [part[k].iloc[0] for k in by]
            out += [(*head, segment, i, s) for i, s in enumerate((gap ** 2).sum(axis=0))]
        return pd.DataFrame(out, columns=[*by, "segment", "combo", "sse"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in judged.schema if f.name in by)
    sse = behind_weights(judged.select(*by, "block", "segment", "y", *cols), weights, by, errors,
                         f"{fields}, segment string, combo int, sse double")
    sse = sse.groupBy(*by, "segment", "combo").agg(F.sum("sse").alias("sse"))
    spread = judged.groupBy(*by, "segment").agg(F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n_rows"))
    combo = F.element_at(F.array(*[F.struct(F.lit(lb).alias("lookback"), F.lit(float(a)).alias("alpha")) for lb, a in combos]),
                         F.col("combo") + 1)
    rmse = F.sqrt(F.col("sse") / F.col("n_rows"))
    return sse.join(spread, [*by, "segment"]).select(
        *by, "segment", combo.lookback.alias("lookback"), combo.alpha.alias("alpha"), "n_rows", rmse.alias("rmse"),
        (rmse / F.nullif("sd", F.lit(0.0))).alias("nrmse"))
