"""Every level of every axis against a fit on its own rows."""

import numpy as np
import pytest

from foretally.operators import lattice
from foretally.operators.blocks import number_rows
from foretally.plans.models import AXIS_LEVELS

PRESETS = {axis: levels for axis, levels in AXIS_LEVELS.items() if axis != "windowing"}


def plain_score(x, level):
    """Scale, window, shape, fit and score one series for one level, on rows."""
    n = len(x)
    train_end, val_end = int(np.floor(level.split[0] * n)), int(np.floor((level.split[0] + level.split[1]) * n))
    fit = x if level.scope == "global" else x[level.washout:train_end]
    if not len(fit):
        return None
    one = lambda s: s if s > 0 else 1.0
    q1, q2, q3 = np.quantile(fit, [0.25, 0.5, 0.75])
    shift, scale = {"minmax": (fit.min(), one(fit.max() - fit.min())), "standard": (fit.mean(), one(fit.std())),
                    "robust": (q2, one(q3 - q1)), "identity": (0.0, 1.0)}[level.scaler]
    u = (x - shift) / scale
    d = np.stack([np.r_[np.full(min(j, n), u[0]), u[:n - j]] for j in range(level.lookback)], axis=1)
    rows = np.arange(n)
    train = rows[(rows >= max(level.washout, level.lookback - 1)) & (rows < train_end - level.horizon)]
    test = rows[(rows >= val_end) & (rows < n - level.horizon)]
    if not len(train) or not len(test):
        return None
    f = d
    if level.encoding is not None:
        f = np.cos(level.encoding * np.pi * d)
    elif level.postprocess.startswith("leaky"):
        e, f, state = float(level.postprocess[5:]), np.empty_like(d), np.zeros(level.lookback)
        for t in range(n):
            f[t] = state = (1 - e) * state + e * d[t]
    elif level.postprocess == "poly2":
        f = np.hstack([d, d**2])
    elif level.postprocess == "zscore":
        spread = d[train].std(axis=0)
        f = (d - d[train].mean(axis=0)) / np.where(spread > 1e-12, spread, 1.0)
    f, y = np.hstack([f, np.ones((n, 1))]), np.r_[u[level.horizon:], np.full(level.horizon, np.nan)]
    w = np.linalg.solve(f[train].T @ f[train] + level.alpha * np.eye(f.shape[1]), f[train].T @ y[train])
    rmse = np.sqrt(np.mean((f[test] @ w - y[test]) ** 2))
    return len(test), rmse, rmse / y[test].std()


@pytest.fixture(scope="module")
def panel(skewed):
    parts, df = skewed
    return parts, number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x")


def test_all_presets_equal_fits_on_rows(panel):
    parts, rows = panel
    levels = lattice.axis_levels(PRESETS, lattice.Level(lookback=3))
    levels += [lattice.Level(axis="mixed", level="a", scaler="standard", scope="global", split=(0.5, 0.25, 0.25), washout=50, lookback=8, horizon=5, alpha=0.5),
               lattice.Level(axis="mixed", level="b", scaler="robust", postprocess="poly2", horizon=2, washout=100),
               lattice.Level(axis="mixed", level="c", scaler="standard", postprocess="leaky0.1", lookback=3, horizon=3)]
    got = {(r["series_id"], r["axis"], r["level"]): r for r in lattice.sweep(rows, levels).collect()}
    assert len(got) == len(levels) * len(parts) and {x.axis for x in levels} == {*PRESETS, "base", "mixed"}
    scored = 0
    for name, x in parts.items():
        for level in levels:
            want, mine = plain_score(x, level), got[name, level.axis, level.level]
            if want is None:
                assert mine["nrmse"] is None and mine["rmse"] is None
                continue
            scored += 1
            assert mine["n_rows"] == want[0], (name, level)
            np.testing.assert_allclose([mine["rmse"], mine["nrmse"]], want[1:], rtol=2e-6, err_msg=f"{name} {level}")
    assert scored > 75


def test_encoded_levels_keep_the_first_scaling(panel):
    with pytest.raises(ValueError, match="first level"):
        lattice.sweep(panel[1], [lattice.Level(), lattice.Level(encoding=1.0, scaler="standard")])
    with pytest.raises(ValueError, match="minmax"):
        lattice.sweep(panel[1], [lattice.Level(scaler="standard")])


def test_leakage_levels_cross_all_axes():
    levels = lattice.leakage_levels(("train", "global"), AXIS_LEVELS["split"], (1e-8, 1e-2))
    assert len(levels) == 1 + 2 * 3 * 2 and len({x.level for x in levels}) == len(levels)
