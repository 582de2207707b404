"""Known answers of the tests of skill."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.functions.pvalues import fisher_two_sided, t_two_sided, u_greater
from foretally.operators import bootstrap as boot
from foretally.operators import significance as sig


def frame(spark, errors, models):
    rows = [("s", m, t, 0.0, float(e)) for m, es in zip(models, errors) for t, e in enumerate(es)]
    return spark.createDataFrame(rows, "series_id string, model string, t long, y_true double, y_pred double")


def dm(spark, e1, e2, h=1):
    wide = sig.losses_wide(frame(spark, [e1, e2], ["a", "b"]), ["a", "b"], ["series_id"])
    row = sig.with_p(sig.pairwise_dm(wide, ["a", "b"], ["series_id"], h)).where("model_i = 'a'").first()
    return row["dm_stat"], row["dm_pval"]


def numpy_dm(e1, e2, h=1):
    d = e1 ** 2 - e2 ** 2
    n, lag, c = len(d), h - 1, d - d.mean()
    var = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    return d.mean() / math.sqrt(var / n) * math.sqrt((n + 1 - 2 * lag + lag * (lag - 1) / n) / n)


def test_identical_forecasts(spark):
    e = np.random.default_rng(0).normal(size=500)
    assert dm(spark, e, e) == (0.0, 1.0)


@pytest.mark.parametrize("h", [1, 3])
def test_sign_size_and_lags(spark, h):
    rng = np.random.default_rng(1)
    e1, e2 = rng.normal(0, 1, 500), rng.normal(0, 2, 500)
    stat, p = dm(spark, e1, e2, h)
    assert stat == pytest.approx(numpy_dm(e1, e2, h)) and stat < 0 and p < 1e-6
    assert dm(spark, e2, e1, h)[0] == pytest.approx(-stat)


@pytest.mark.parametrize("scale", [1e-1, 1e-7])
def test_scale_invariance(spark, scale):
    rng = np.random.default_rng(2)
    e1, e2 = rng.normal(0, 1, 400), rng.normal(0, 1.3, 400)
    assert dm(spark, e1 * scale, e2 * scale)[0] == pytest.approx(dm(spark, e1, e2)[0], rel=1e-6)


def test_zero_loss(spark):
    assert dm(spark, np.zeros(200), np.zeros(200)) == (0.0, 1.0)


def test_p_values():
    assert t_two_sided(0.0, 10) == pytest.approx(1.0)
    assert t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)  # Cauchy quartile
    assert fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert u_greater(9, 3, 3, 0) == pytest.approx(1 / 20)
    assert math.isnan(t_two_sided(float("nan"), 5))


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, i int, p double")
    got = [r["p_holm"] for r in sig.holm(df, ["f"], "p", ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.5])
    loud = spark.createDataFrame([("f", 0, 0.9), ("f", 1, 0.8)], "f string, i int, p double")
    assert [r["p_holm"] for r in sig.holm(loud, ["f"], "p", ["i"]).orderBy("i").collect()] == [1.0, 1.0]
    assert [r["p_holm"] for r in sig.holm(loud, ["f"], "p", ["i"], cap=False).orderBy("i").collect()] == [1.6, 1.6]


@pytest.mark.parametrize("length", [7, 10])
def test_block_means_are_the_resampled_means(spark, length):
    """Prefix sums against the resampled rows themselves, with and without a short last block."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=150)
    wide = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "series_id string, t long, l_0 double")
    cells = spark.createDataFrame([("s", 150)], "series_id string, n long")
    starts = boot.block_starts(cells, ["series_id"], 5, length).collect()
    got = {r["b"]: r["l_0"] for r in boot.block_means(wide, ["l_0"], ["series_id"], 5, length).collect()}
    for b in range(5):
        idx = np.concatenate([(np.arange(r["start"], r["start"] + length)) % 150 for r in sorted((r for r in starts if r["b"] == b), key=lambda r: r["j"])])[:150]
        assert got[b] == pytest.approx(x[idx].mean())


def confidence(spark, scales, same=False):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(len(scales), 600))
    if same:
        base[:] = base[0]
    names = [f"m{i}" for i in range(len(scales))]
    losses = (base * np.array(scales)[:, None]) ** 2
    wide = spark.createDataFrame([("s", t, *map(float, losses[:, t])) for t in range(600)],
                                 "series_id string, t long, " + ", ".join(f"l_{i} double" for i in range(len(scales))))
    cols = [f"l_{i}" for i in range(len(scales))]
    means = boot.block_means(wide, cols, ["series_id"], 200, 10)
    full = wide.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in cols])
    return {r["model"]: r for r in boot.confidence_set(means, full, names, ["series_id"]).collect()}


def test_confidence_set_keeps_the_dominant_model(spark):
    got = confidence(spark, [0.3, 0.9, 4.0])
    assert got["m0"]["mcs_pvalue"] == 1.0 and got["m0"]["in_set_10"]
    assert not got["m2"]["in_set_10"] and got["m2"]["eliminated"] == 0


def test_confidence_set_keeps_equal_models(spark):
    assert all(r["in_set_25"] for r in confidence(spark, [1.0, 1.0, 1.0], same=True).values())


def test_bootstrap_interval(spark):
    d = [-1.0, -1.2, -0.9, -1.1, -1.0]
    df = spark.createDataFrame([("k", j, v) for j, v in enumerate(d)], "k string, j long, d double")
    row = boot.bootstrap_ci(df, ["k"], n_boot=200).first()
    assert row["estimate"] == -1.0 and row["excludes_zero"] and row["n_pairs"] == 5
    assert -1.2 <= row["ci_lo"] <= row["ci_hi"] <= -0.9


def test_suffix_alignment(spark):
    e = np.arange(200.0)
    df = frame(spark, [e, e], ["a", "b"]).where("model = 'a' OR t >= 70")
    got = sig.align_suffix(df, ["series_id"])
    assert got.count() == 2 * 130
    assert sig.target_agreement(got, ["series_id"]).first()["targets_agree"]
