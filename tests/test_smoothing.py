"""Fitted smoothing and Theta against plain loops, over several blocks."""

import numpy as np
import pytest

from foretally.operators.blocks import number_rows
from foretally.operators.smoothing import fitted_smoothing, smoothing_forecasts, theta_forecasts
from foretally.operators.split import label_split, split_bounds
from foretally.operators.windows import delays


@pytest.fixture(scope="module")
def labelled(skewed):
    parts, df = skewed
    panel = number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x").where("series_id <> 'one'")
    return {k: v for k, v in parts.items() if k != "one"}, label_split(panel, split_bounds(panel, washout=10)).cache()


def plain(x, a, b, horizon):
    level, trend, out = x[0], 0.0, []
    for v in x:
        new = a * v + (1 - a) * (level + trend)
        level, trend = new, b * (new - level) + (1 - b) * trend
        out.append(level + horizon * trend)
    return np.array(out)


def error(x, a, b, horizon, washout=10):
    train_end = int(0.6 * len(x))
    t = np.arange(washout, train_end - horizon)
    return ((plain(x, a, b, horizon)[t] - x[t + horizon]) ** 2).sum()


@pytest.mark.parametrize("horizon", [1, 3])
def test_fit_is_no_worse_than_a_grid_of_a_thousand_points(labelled, horizon):
    parts, rows = labelled
    ready = delays(rows, 1, 1, horizon)
    fits = {r["series_id"]: (r["alphas"][0], r["betas"][0], r["sse"]) for r in fitted_smoothing(ready, ["series_id"], horizon).collect()}
    for k, x in parts.items():
        a, b, sse = fits[k]
        assert sse == pytest.approx(error(x, a, b, horizon), rel=1e-9)
        grid = (np.arange(32) + 0.5) / 32
        assert sse <= min(error(x, p, q, horizon) for p in grid[::2] for q in grid[::2]) * (1 + 1e-9)
    got = smoothing_forecasts(rows, horizon=horizon).collect()
    for k, x in parts.items():
        want = plain(x, *fits[k][:2], horizon)
        for r in got:
            if r["series_id"] == k:
                assert r["y_pred"] == pytest.approx(want[r["t"]], rel=1e-9) and r["y_true"] == x[r["t"] + horizon]
        assert sum(r["series_id"] == k for r in got) == len(x) - horizon - int((0.6 + 0.2) * len(x))


def test_theta_refits_at_every_step(labelled):
    parts, rows = labelled
    grid = (0.05, 0.2, 0.5, 0.9)
    got = theta_forecasts(rows, grid=grid).collect()
    for k, x in parts.items():
        for r in [r for r in got if r["series_id"] == k][::7]:
            t = r["t"]
            levels = np.array([plain(x[:t + 1], a, 0.0, 1) for a in grid])
            best = int(np.argmin(((levels[:, :-1] - x[1:t + 1]) ** 2).sum(axis=1)))
            slope = np.polyfit(np.arange(t + 1), x[:t + 1], 1)[0]
            want = levels[best, -1] + 0.5 * slope * (1 - (1 - grid[best]) ** (t + 1)) / grid[best]
            assert r["y_pred"] == pytest.approx(want, rel=1e-8)


def test_runs_side_by_side_equal_one_value_after_another():
    """The state also holds no more than CELLS numbers, however many candidates there are."""
    from foretally.operators import smoothing
    rng = np.random.default_rng(0)
    x, a, b = rng.random(333), rng.random(7), rng.random(7)
    levels, trends = smoothing.smooth(x, np.full(7, 0.3), np.full(7, 0.1), a, b)
    level, trend = np.full(7, 0.3), np.full(7, 0.1)
    for i, v in enumerate(x):
        new = a * v + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        np.testing.assert_allclose([levels[i], trends[i]], [level, trend], rtol=1e-9, atol=1e-12)
    assert smoothing.chunk_of(1089) * 1089 <= smoothing.CELLS < 4096 * 1089
