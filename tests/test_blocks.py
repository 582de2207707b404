"""Blocked operators against whole-series numpy results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.operators.blocks import attach, number_rows, running_sums
from foretally.operators.quantiles import exact_quantiles
from foretally.operators.recursion import leaky, scan_line
from foretally.operators.reservoir import ReservoirConfig, drive, reservoir_map, reservoir_weights
from foretally.operators.spectra import wasserstein
from foretally.operators.split import label_split, split_bounds
from foretally.operators.windows import delays


@pytest.fixture(scope="module")
def panel(skewed):
    parts, df = skewed
    return parts, number_rows(df, ["series_id"], ["order"]).select("series_id", "block", "t", "x")


def by_series(df, column):
    out = {}
    for row in df.select("series_id", "t", column).collect():
        out.setdefault(row["series_id"], {})[row["t"]] = row[column]
    return {k: [v[t] for t in sorted(v)] for k, v in out.items()}


def test_numbering_is_the_order_and_blocks_are_bounded(panel):
    parts, df = panel
    got = by_series(df, "x")
    for name, x in parts.items():
        np.testing.assert_array_equal(got[name], x)
    assert df.groupBy("series_id", "block").count().agg(F.max("count")).first()[0] <= 64
    assert df.where("series_id = 'hot'").select("block").distinct().count() == 11


def test_running_sums_across_slices(skewed):
    parts, df = skewed
    got = running_sums(df, ["series_id"], ["order"], {"s": F.col("x")}).withColumn("t", F.col("order"))
    for name, s in by_series(got, "s").items():
        np.testing.assert_allclose(s, np.cumsum(parts[name]))


def test_delays_cross_block_edges_and_pad_with_the_first_value(panel):
    parts, df = panel
    rows = delays(df, 4, stride=30, horizon=2)  # taps reach back 90 rows, over a block
    d3, y = by_series(rows, "d3"), by_series(rows, "y")
    for name, x in parts.items():
        np.testing.assert_array_equal(d3[name], np.concatenate([np.full(min(90, len(x)), x[0]), x[:-90]]) if len(x) > 90 else np.full(len(x), x[0]))
        np.testing.assert_array_equal([v for v in y[name] if v is not None], x[2:])


def test_delays_are_causal(panel, spark):
    parts, df = panel
    changed = df.withColumn("x", F.when(F.col("t") > 100, F.col("x") + 99).otherwise(F.col("x")))
    a, b = by_series(delays(df, 3), "d2")["hot"], by_series(delays(changed, 3), "d2")["hot"]
    assert a[:101] == b[:101] and a[110:] != b[110:]


def test_attach_keeps_every_row_once(panel):
    parts, df = panel
    rows = label_split(df, split_bounds(df, washout=5))
    assert rows.count() == df.count()
    n = len(parts["hot"])
    segments = {r["segment"]: r["count"] for r in rows.where("series_id = 'hot'").groupBy("segment").count().collect()}
    assert segments == {"train": int(0.6 * n), "validation": int((0.6 + 0.2) * n) - int(0.6 * n), "test": n - int((0.6 + 0.2) * n)}


def test_exact_quantiles(skewed):
    parts, df = skewed
    got = exact_quantiles(df, ["series_id"], "x", {"a": 0.25, "b": 0.5, "c": 0.97})
    for row in got.collect():
        np.testing.assert_allclose([row["a"], row["b"], row["c"]], np.percentile(parts[row["series_id"]], [25, 50, 97]))


def test_leaky_integrator(panel):
    parts, df = panel
    got = by_series(leaky(df, 0.2), "r")
    for name, x in parts.items():
        r, want = 0.0, []
        for v in x:
            r = 0.8 * r + 0.2 * v
            want.append(r)
        np.testing.assert_allclose(got[name], want)


def test_leaky_with_eps_one_is_the_identity():
    x = np.arange(200.0)
    np.testing.assert_allclose(scan_line(1.0 * x, 0.0), x)


@pytest.mark.parametrize("leak, radius", [(0.9, 0.2), (0.3, 0.9), (0.05, 0.99)])
def test_reservoir_blocks_match_one_run(panel, leak, radius):
    """States equal one run in order, however long the state remembers its start."""
    parts, df = panel
    cfg = ReservoirConfig(units=8, leak_rate=leak, spectral_radius=radius, density=0.5)

    def two_states(pdf, states, _):
        return pdf[["series_id", "run_seed", "t"]].assign(s=states[:, 0], z=states[:, 7])

    got = reservoir_map(df, (3, 4), two_states, "series_id string, run_seed long, t long, s double, z double", cfg).orderBy("t").collect()
    for name, x in parts.items():
        for seed in (3, 4):
            want = drive(x[:, None], np.zeros(8), reservoir_weights(cfg, seed), cfg.leak_rate)
            mine = np.array([(r["s"], r["z"]) for r in got if r["series_id"] == name and r["run_seed"] == seed])
            np.testing.assert_allclose(mine, want[:, [0, 7]], atol=1e-9)


def test_reservoir_of_several_channels(panel):
    parts, df = panel
    cfg = ReservoirConfig(units=6, leak_rate=0.1, density=0.5, bias_scaling=0.2)
    rows = df.withColumn("z", F.sin("x"))
    got = reservoir_map(rows, (1,), lambda pdf, states, _: pdf[["series_id", "t"]].assign(s=states.sum(axis=1)),
                        "series_id string, t long, s double", cfg, columns=["x", "z"])
    got = by_series(got, "s")
    for name, x in parts.items():
        want = drive(np.c_[x, np.sin(x)], np.zeros(6), reservoir_weights(cfg, 1, 2), cfg.leak_rate).sum(axis=1)
        np.testing.assert_allclose(got[name], want, atol=1e-8)


def test_wasserstein_over_slices(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300), rng.normal(0.5, 2, 300)
    b[7] = np.inf
    rows = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b)], "k string, y_true double, y_pred double")
    z = np.sort(np.concatenate([a, b[np.isfinite(b)]]))
    fa = np.searchsorted(np.sort(a), z[:-1], side="right") / len(a)
    good = np.sort(b[np.isfinite(b)])
    fb = np.searchsorted(good, z[:-1], side="right") / len(good)
    want = float(np.sum(np.abs(fa - fb) * np.diff(z)))
    assert wasserstein(rows, ["k"]).first()["wasserstein"] == pytest.approx(want)


def test_rows_are_numbered_alike_by_stretch_and_by_range(skewed):
    _, df = skewed
    whole = number_rows(df, ["series_id"], ["order"])
    cut = number_rows(df, ["series_id"], ["order"], stretch=F.floor(F.col("order") / 50))
    assert sorted(map(tuple, whole.select("series_id", "order", "t").collect())) == sorted(map(tuple, cut.select("series_id", "order", "t").collect()))


@pytest.mark.parametrize("stretch", [1.0, 40.0])
def test_lanes_of_a_block_equal_one_run(stretch):
    """Lanes driven side by side; weights that do not forget as the settings say are driven in order again."""
    from foretally.operators import reservoir as res
    cfg = ReservoirConfig(units=8, leak_rate=0.9, spectral_radius=0.3, density=0.9)
    w_in, w, bias = reservoir_weights(cfg, 2)
    made, u, first = (w_in * 0.01, w * stretch, bias), np.random.default_rng(1).random((2003, 1)), np.full(8, 0.2)
    assert res.wide(len(u), cfg) and not res.wide(len(u), ReservoirConfig())
    got = res.over_runs(u, first, made, cfg, lambda at, states: (np.arange(len(u))[at], states))
    at, states = (np.concatenate(v) for v in zip(*got))
    want = drive(u, first, made, cfg.leak_rate)
    np.testing.assert_allclose(states[np.argsort(at)], want, atol=1e-12)
    assert len(np.unique(at)) == len(u) and len(got) == 1
    if stretch > 1:
        with pytest.raises(ArithmeticError):
            list(res.driven_side_by_side(u, first, made, cfg))
    np.testing.assert_allclose(res.drive_on(u, first, None, made, cfg)[0], want[-1], atol=1e-12)


def test_state_blocks_hold_only_what_is_driven(spark, tiny, monkeypatch):
    """A block is whole in its task, so the recurrent queries send no column there that they do not use."""
    from foretally.operators import reservoir
    from foretally.plans.catalogue import load_all
    from foretally.plans.queries import feature_steps
    seen = []
    watched = lambda rows, *a, **k: seen.append(rows.columns) or reservoir_map(rows, *a, **k)
    for module in (reservoir, feature_steps):
        monkeypatch.setattr(module, "reservoir_map", watched)
    for name in ("recurrent_states", "recurrent_features"):
        load_all()[name].run(spark, tiny)
    assert [sorted(c) for c in seen] == [["block", "d0", "series_id", "t"], ["block", "series_id", "t", "u"]]
