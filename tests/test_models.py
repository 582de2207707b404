"""Fits, neighbours, matrices and roll-outs against direct numpy results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.operators.blocks import number_rows
from foretally.operators.grids import linear_grid
from foretally.operators.matrices import project, rank_report, residual_power, right_vectors
from foretally.operators.neighbours import nearest
from foretally.operators.ridge import ridge_fit, ridge_predict, same, wide_fit, wide_predict
from foretally.operators.rollouts import roll_out
from foretally.operators.split import label_split, split_bounds
from foretally.operators.windows import delays, monomials, taps_of, train_and_test


@pytest.fixture(scope="module")
def windows(skewed):
    parts, df = skewed
    panel = number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x").where("series_id <> 'one'")
    rows = label_split(panel, split_bounds(panel, washout=10))
    return parts, train_and_test(delays(rows, 3, 1, 1), 3, 1, 1)


def numpy_windows(x, taps=3, washout=10):
    n = len(x)
    d = np.stack([np.concatenate([np.full(j, x[0]), x[:n - j]]) for j in range(taps)], axis=1)
    train, test = slice(max(washout, taps - 1), int(0.6 * n) - 1), slice(int((0.6 + 0.2) * n), n - 1)
    return d[train], x[1:][train], d[test], x[1:][test]


def numpy_ridge(x, y, alpha):
    x = np.hstack([x, np.ones((len(x), 1))])
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def test_ridge_matches_the_normal_equations(windows):
    parts, rows = windows
    fit = ridge_fit(rows.where("part = 'train'"), taps_of(3), F.col("y"), 0.5)
    pred = ridge_predict(rows.where("part = 'test'"), fit, taps_of(3)).orderBy("t").collect()
    for row in fit.collect():
        x, y, xt, yt = numpy_windows(parts[row["series_id"]])
        w = numpy_ridge(x, y, 0.5)
        np.testing.assert_allclose(row["w"], w, rtol=1e-8)
        got = [p["y_pred"] for p in pred if p["series_id"] == row["series_id"]]
        np.testing.assert_allclose(got, np.hstack([xt, np.ones((len(xt), 1))]) @ w)


def test_wide_fit_equals_the_column_form(windows):
    """Gram sums made in tasks and as columns give the same forecasts."""
    _, rows = windows
    inputs = ["d0", "d1", "d2"]
    wide = wide_predict(rows, wide_fit(rows, inputs, same, 3, 0.5), inputs, same)
    narrow = ridge_predict(rows.where("part = 'test'"), ridge_fit(rows.where("part = 'train'"), taps_of(3), F.col("y"), 0.5), taps_of(3))
    both = wide.join(narrow.select("series_id", "t", F.col("y_pred").alias("other")), ["series_id", "t"])
    assert both.count() == wide.count() > 0
    assert both.agg(F.max(F.abs(F.col("y_pred") - F.col("other")))).first()[0] < 1e-9


@pytest.mark.parametrize("slice_rows", [16, 100000])
def test_neighbours_are_the_brute_force_ones(windows, slice_rows):
    parts, rows = windows
    got = nearest(rows.where("part = 'train'"), rows.where("part = 'test'"), ["d0", "d1"], 4, slice_rows=slice_rows).collect()
    for name in ("hot", "warm"):
        x = parts[name]
        xtr, ytr, xte, _ = numpy_windows(x)
        first_train, first_test = max(10, 2), int((0.6 + 0.2) * len(x))
        for i in (0, 3, len(xte) - 1):
            d = (xte[i, 0] - xtr[:, 0]) ** 2 + (xte[i, 1] - xtr[:, 1]) ** 2
            order = np.lexsort((np.arange(len(d)), d))[:4]
            mine = sorted([r for r in got if r["series_id"] == name and r["t"] == first_test + i], key=lambda r: r["rank"])
            assert [r["nt"] - first_train for r in mine] == list(order)


def test_grid_scores_match_single_fits(skewed):
    parts, df = skewed
    panel = number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x").where("series_id <> 'one'")
    grid = linear_grid(panel, scalers=("identity",), lookbacks=(1, 3), alphas=(0.1,), washout=10).where("segment = 'test'").collect()
    for row in grid:
        x = parts[row["series_id"]]
        xtr, ytr, xte, yte = numpy_windows(x, 3)
        use = xtr[:, :row["lookback"]], xte[:, :row["lookback"]]
        w = numpy_ridge(use[0], ytr, 0.1)
        rmse = np.sqrt(np.mean((np.hstack([use[1], np.ones((len(yte), 1))]) @ w - yte) ** 2))
        assert row["rmse"] == pytest.approx(rmse)
        assert row["nrmse"] == pytest.approx(rmse / np.std(yte))
    assert len(grid) == 4


def test_rank_and_condition(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 3))
    m = np.hstack([base, base[:, :1] + base[:, 1:2]])
    rows = spark.createDataFrame([("k", *map(float, r)) for r in m], "k string, a double, b double, c double, d double").repartition(4)
    got = rank_report(rows, ["a", "b", "c", "d"], ["k"]).first()
    assert (got["feature_rank"], got["effective_rank"], got["n_features"]) == (3, 3, 4)
    got = rank_report(rows, ["a", "b", "c"], ["k"]).first()
    assert got["condition_number"] == pytest.approx(np.linalg.cond(base))


def test_residual_power(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(300, 2))
    z = np.stack([s[:, 0] + rng.normal(size=300), s[:, 0] * s[:, 1]], axis=1)
    rows = spark.createDataFrame([("k", *map(float, r)) for r in np.hstack([s, z])], "k string, a double, b double, u double, v double").repartition(3)
    sc, want = s - s.mean(axis=0), []
    for j in range(2):
        t = z[:, j] - z[:, j].mean()
        beta = np.linalg.lstsq(sc, t, rcond=None)[0]
        want.append(np.sum((t - sc @ beta) ** 2) / np.sum(t ** 2))
    got = residual_power(rows, ["a", "b"], ["u", "v"], ["k"]).first()["residual_power_fraction"]
    assert got == pytest.approx(np.mean(want))


def test_low_rank_projection(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 5))
    rows = spark.createDataFrame([(1, [float(v) for v in r]) for r in m], "one int, f array<double>").repartition(3)
    basis = right_vectors(rows, ["f"], ["one"], 2)
    back = rows.join(basis, "one").select("f", project(F.col("f"), F.col("v"), 2, 5).alias("g")).collect()
    for r in back:
        np.testing.assert_allclose(r["f"], r["g"], atol=1e-9)


def test_rollout_feeds_back_and_freezes(spark):
    starts = spark.createDataFrame([("a", [2.0, 1.0], [1.0, 1.0, 0.0]), ("b", [1.0, 1.0], [1e200, 0.0, 0.0])], "k string, window array<double>, w array<double>")
    rows = roll_out(starts, 5, 2, ["k"]).collect()
    fib = [r["y_pred"] for r in sorted(rows, key=lambda r: r["step"]) if r["k"] == "a"]
    assert fib == [3.0, 5.0, 8.0, 13.0, 21.0]
    blown = [r["y_pred"] for r in sorted(rows, key=lambda r: r["step"]) if r["k"] == "b"]
    assert blown == [1e200] * 5  # the step that overflows repeats the last finite value


def test_monomial_count():
    assert len(monomials(taps_of(5), 3)) == 56


def test_close_neighbours_are_told_apart(spark):
    """Ten windows a millionth apart: the nearest are the last ones, not the oldest."""
    train = spark.createDataFrame([("s", i, float(i), 0.5 + (9 - i) * 1e-6) for i in range(10)], "series_id string, t long, y double, d0 double")
    test = spark.createDataFrame([("s", 20, 0.0, 0.5)], "series_id string, t long, y double, d0 double")
    got = sorted(nearest(train, test, ["d0"], 3).collect(), key=lambda r: r["rank"])
    assert [r["nt"] for r in got] == [9, 8, 7]


def test_states_do_not_depend_on_blocks(windows):
    from foretally.operators.reservoir import ReservoirConfig, reservoir_summary
    _, rows = windows
    panel = rows.select("series_id", "block", "t", F.col("d0").alias("x"))
    moved = panel.withColumn("block", F.lit(0).cast("long"))
    cfg = ReservoirConfig(units=8, leak_rate=0.05, spectral_radius=0.99)
    brief = lambda df: {r["series_id"]: r["mean_state"] for r in reservoir_summary(df, [1], cfg).collect()}
    one, two = brief(panel), brief(moved)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_estimator_is_saved_loaded_and_copied(windows, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from foretally.operators.estimators import PanelRidge, PanelRidgeModel
    _, rows = windows
    panel = rows.select("series_id", "block", "t", F.col("d0").alias("x"))
    forecasts = lambda model: {(r["series_id"], r["t"]): r["y_pred"] for r in model.transform(panel).collect()}
    ridge = PanelRidge(taps=3, alpha=0.5, washout=5)
    one, strict = ridge.fit(panel, [{}, {ridge.alpha: 50.0, ridge.taps: 2}])
    assert (one.getOrDefault("alpha"), strict.getOrDefault("alpha"), strict.getOrDefault("taps"), ridge.getOrDefault("taps")) == (0.5, 50.0, 2, 3)
    first = forecasts(one)
    assert first != forecasts(strict)
    one.write().overwrite().save(str(tmp_path / "model"))
    ridge.save(str(tmp_path / "estimator"))
    again = PanelRidgeModel.load(str(tmp_path / "model"))
    assert again.uid == one.uid and again.getOrDefault("keys") == ["series_id"]
    assert forecasts(again) == first == forecasts(PanelRidge.load(str(tmp_path / "estimator")).fit(panel))
    Pipeline(stages=[ridge]).fit(panel).write().overwrite().save(str(tmp_path / "pipeline"))
    assert forecasts(PipelineModel.load(str(tmp_path / "pipeline"))) == first


def test_solver_holds_one_matrix_at_a_time():
    import tracemalloc
    import numpy as np
    import pandas as pd
    from foretally.operators.ridge import solver
    width, rows = 57, 1000
    g = pd.Series([np.eye(width)[np.triu_indices(width)]] * rows)
    b = pd.Series([np.arange(width, dtype=float)] * rows)
    tracemalloc.start()
    got = solver(width, 1.0).func(g, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(np.stack(got), np.stack(b) / 2)
    assert peak < 10e6
