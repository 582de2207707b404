"""Trees and elastic nets per series against plain versions; series grown in Spark and in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.operators import elastic, trees
from foretally.operators.blocks import number_rows
from foretally.operators.estimators import window_forecasts
from foretally.operators.split import label_split, split_bounds
from foretally.operators.windows import delays, train_and_test


@pytest.fixture(scope="module")
def windows(skewed):
    parts, df = skewed
    panel = number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x").where("series_id <> 'one'")
    rows = label_split(panel, split_bounds(panel, washout=10))
    return train_and_test(delays(rows, 3, 1, 1), 3, 1, 1).cache()


def plain_tree(x, y, w, depth, penalty):
    """(feature, bin, left, right) or a value, by trying every cut."""
    on = w > 0
    tw, ts = w[on].sum(), (w * y)[on].sum()
    best = (1e-12 * (w * y * y)[on].sum(), None)
    if depth != 0:
        for f in range(x.shape[1]):
            for b in np.unique(x[on, f])[:-1]:
                l = on & (x[:, f] <= b)
                cw, cs = w[l].sum(), (w * y)[l].sum()
                gain = cs**2 / (cw + penalty) + (ts - cs)**2 / (tw - cw + penalty) - ts**2 / (tw + penalty)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, b))
    if best[1] is None:
        return ts / (tw + penalty)
    f, b = best[1]
    l = x[:, f] <= b
    next_ = None if depth is None else depth - 1
    return f, b, plain_tree(x, y, w * l, next_, penalty), plain_tree(x, y, w * ~l, next_, penalty)


def plain_walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth, penalty", [(None, 0.0), (3, 1.0)])
def test_tree_equals_a_plain_one(depth, penalty):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (150, 3)).astype(np.uint8)
    y, w = rng.normal(size=150) + x[:, 1], rng.integers(0, 3, 150).astype(float)
    tree = trees.grow(x, y, w, trees.orders_of(x), depth, penalty)
    plain = plain_tree(x, y, w, depth, penalty)
    np.testing.assert_allclose(trees.walk(tree, x), [plain_walk(plain, r) for r in x], rtol=1e-9)


def test_odd_tables_of_one_task():
    one = np.zeros((1, 2), np.uint8)
    assert trees.grow(one, np.array([3.0]), np.ones(1), trees.orders_of(one), None, 0.0)[0].tolist() == [-1, 0, -1, 3.0]
    same = np.zeros((5, 2), np.uint8)
    assert len(trees.grow(same, np.arange(5.0), np.ones(5), trees.orders_of(same), None, 0.0)) == 1
    none = trees.grow(same, np.arange(5.0), np.zeros(5), trees.orders_of(same), None, 0.0)
    assert trees.walk(none, same).tolist() == [0.0] * 5


def by_key(got):
    return {(r["series_id"], r["t"]): r["y_pred"] for r in got.collect()}


@pytest.mark.parametrize("kind, how", [("random_forest", {"trees": 12}), ("boosted_trees", {"rounds": 4, "depth": 3})])
def test_spark_levels_equal_one_task(windows, monkeypatch, kind, how):
    """The hot series above LOCAL is split in Spark, and gets the trees it would get in one task."""
    names = ["d0", "d1", "d2"]
    whole = by_key(window_forecasts(windows, kind, names, **how))
    monkeypatch.setattr(trees, "LOCAL", 120)
    cut = by_key(window_forecasts(windows, kind, names, **how))
    assert whole.keys() == cut.keys() and len({k[0] for k in whole}) == 2
    np.testing.assert_allclose([cut[k] for k in sorted(cut)], [whole[k] for k in sorted(cut)], rtol=1e-9)
    assert len(by_key(windows.where("part = 'test'").select("series_id", "t", F.lit(0.0).alias("y_pred")))) == len(whole)


def test_forest_is_the_mean_of_its_trees(windows):
    names = ["d0", "d1", "d2"]
    got = by_key(window_forecasts(windows, "random_forest", names, trees=3))
    rows = windows.where("series_id = 'warm'").orderBy("t").collect()
    train, test = ([r for r in rows if r["part"] == p] for p in ("train", "test"))
    raw = np.array([[r[n] for n in names] for r in train])
    edges = [np.unique(np.sort(c)[np.maximum(np.ceil(np.arange(1, 256) / 256 * len(c)).astype(int), 1) - 1]) for c in raw.T]
    bins = lambda part: np.stack([np.searchsorted(e, [r[n] for r in part]) for e, n in zip(edges, names)], axis=1)
    x, y, t = bins(train), np.array([r["y"] for r in train]), np.array([r["t"] for r in train])
    grown = [plain_tree(x, y, trees.weights_of("forest", t, i, 0, 1.0), None, 0.0) for i in range(3)]
    for r, b in zip(test, bins(test)):
        assert got["warm", r["t"]] == pytest.approx(np.mean([plain_walk(g, b) for g in grown]), rel=1e-9)


def test_draws_have_their_means():
    t = np.arange(200_000)
    poisson = trees.weights_of("forest", t, 3, 1, 1.0)
    assert abs(poisson.mean() - 1) < 0.01 and abs(poisson.var() - 1) < 0.02
    assert abs(trees.weights_of("boosting", t, 3, 1, 0.9).mean() - 0.9) < 0.005
    assert (trees.draws(t, 0, 0) != trees.draws(t, 1, 0)).all()


def test_elastic_net_against_a_plain_solver(windows):
    names = ["d0", "d1", "d2"]
    rows = windows.withColumn("d2", F.when(F.col("series_id") == "warm", 4.0).otherwise(F.col("d2")))  # a constant feature
    fits = {r["series_id"]: r["w"] for r in elastic.elastic_fit(rows.where("part = 'train'"), [F.col(n) for n in names], F.col("y"), 0.05).collect()}
    for key in ("hot", "warm"):
        got = rows.where(f"part = 'train' AND series_id = '{key}'").collect()
        raw, y = np.array([[r[n] for n in names] for r in got]), np.array([r["y"] for r in got])
        spread = raw.std(axis=0)
        z = (raw - raw.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        w = np.zeros(3)
        step = 1 / (np.linalg.eigvalsh(z.T @ z / len(z))[-1] + 0.025)
        for _ in range(20_000):  # proximal gradient
            w = w - step * (z.T @ (z @ w - (y - y.mean())) / len(z) + 0.025 * w)
            w = np.sign(w) * np.maximum(np.abs(w) - step * 0.025, 0)
        np.testing.assert_allclose(np.array(fits[key][:3]) * spread, np.where(spread > 0, w, 0.0), atol=1e-8)
        assert fits[key][3] == pytest.approx(y.mean() - np.array(fits[key][:3]) @ raw.mean(axis=0))


@pytest.mark.parametrize("lasso", [0.0, 0.1, 0.5, 10.0])
def test_descent_on_correlated_features(lasso):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 3))
    z = np.c_[base, base @ rng.normal(size=(3, 9)) + 0.05 * rng.normal(size=(400, 9))]
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    cov, right = z.T @ z / 400, z.T @ (base[:, 0] + 0.1 * rng.normal(size=400)) / 400
    w = elastic.descend(cov, right, lasso, 0.01)
    slack = right - cov @ w - 0.01 * w  # zero where w is not, within the penalty elsewhere
    assert np.abs(slack - lasso * np.sign(w))[w != 0].max(initial=0.0) < 1e-8 and np.abs(slack).max() <= lasso + 1e-8


def test_boosting_above_local_stores_no_table_a_round(windows, monkeypatch):
    from foretally.session import tables_made
    monkeypatch.setattr(trees, "LOCAL", 120)
    monkeypatch.setattr(trees, "LINEAGE", 2)
    made, got = [], []
    for rounds in (1, 5):
        with tables_made() as paths:
            got.append(by_key(window_forecasts(windows, "boosted_trees", ["d0", "d1", "d2"], rounds=rounds)))
        made.append(len(paths))
    assert made[0] == made[1] and got[0].keys() == got[1].keys()


@pytest.mark.parametrize("near", [1, 20, 1000])
def test_nodes_split_by_bins_and_grown_apart_equal_a_plain_tree(monkeypatch, near):
    """A task may grow far more rows than it holds side by side."""
    monkeypatch.setattr(trees, "NEAR", near)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (150, 3)).astype(np.uint8)
    y, w = rng.normal(size=150) + x[:, 1], rng.integers(0, 3, 150).astype(float)
    tree, plain = trees.slim(trees.grow_apart(x, y, w, 0.0)), plain_tree(x, y, w, None, 0.0)
    np.testing.assert_allclose(trees.walk(tree, x), [plain_walk(plain, r) for r in x], rtol=1e-9)
    assert trees.LOCAL >= 8 * trees.BOOSTED  # series of a million rows need no routing of rows to nodes


@pytest.mark.parametrize("near", [5, 1000])
def test_forest_of_equal_rows_is_grown_from_the_different_ones(monkeypatch, near):
    """A series six times the driver's 1 GB is one task a group of trees, and its repeated rows are grown once."""
    monkeypatch.setattr(trees, "NEAR", near)
    rng = np.random.default_rng(9)
    few = rng.integers(0, 4, (60, 3)).astype(np.uint8)
    x = few[rng.integers(0, 60, 900)]
    y, t, test = rng.normal(size=900) + x[:, 1], np.arange(900), rng.integers(0, 5, (40, 3)).astype(np.uint8)
    columns, number = trees.alike(x)
    assert columns.shape == (3, len({tuple(r) for r in x.tolist()})) and (columns.T[number] == x).all()
    plain = [plain_tree(x, y, trees.weights_of("forest", t, i, 7, 1.0), None, 0.0) for i in (2, 3)]
    want = [sum(plain_walk(p, r) for p in plain) for r in test]
    np.testing.assert_allclose(trees.forest_sums(x, y, t, [2, 3], 7, test), want, rtol=1e-9)
    assert trees.LOCAL >= 0.6 * 360 * 20_400  # the largest train part of events at 360 x sf0.1


def test_rows_of_many_columns_keep_their_differences():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 19)).astype(np.uint8) * 255
    columns, number = trees.alike(x)
    assert columns.shape[1] == len(np.unique(x, axis=0)) and (columns.T[number] == x).all()
    assert trees.alike(x[:0])[0].shape == (19, 0)


def test_a_forest_without_drawn_rows_gives_zero():
    x = np.zeros((1, 2), np.uint8)
    drawn = [i for i in range(20) if trees.weights_of("forest", np.zeros(1, int), i, 0, 1.0)[0] > 0]
    assert 0 < len(drawn) < 20
    assert trees.forest_sums(x, np.array([3.0]), np.zeros(1, int), range(20), 0, x).tolist() == [3.0 * len(drawn)]
    assert len(trees.forest_sums(x, np.array([3.0]), np.zeros(1, int), range(20), 0, x[:0])) == 0


def test_more_test_rows_than_a_task_holds_are_forecast_in_turns(windows, monkeypatch):
    rows = windows.where("part = 'test' OR t < 60")
    whole = by_key(window_forecasts(rows, "random_forest", ["d0", "d1", "d2"], trees=2))
    monkeypatch.setattr(trees, "LOCAL", 51)  # no less than the train rows, so that each series stays in a task
    assert by_key(window_forecasts(rows, "random_forest", ["d0", "d1", "d2"], trees=2)) == whole


def test_rows_behind_weights_carry_no_null_list(windows):
    """A null list costs 27 microseconds a row on the way to Python, an empty one hardly any."""
    from foretally.operators.ridge import behind_weights
    heads = windows.groupBy("series_id").agg(F.max("n").alias("n"), F.array(F.lit(1.5)).alias("w"))
    nulls = lambda body, w: body[["t"]].assign(none=body["w"].isna(), w=w[0])
    got = behind_weights(windows.select("series_id", "block", "t"), heads, ["series_id"], nulls, "t long, none boolean, w double").collect()
    assert len(got) == windows.count() and not any(r["none"] for r in got) and {r["w"] for r in got} == {1.5}
