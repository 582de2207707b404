"""Distributed transforms against numpy's, for lengths that factor well, badly and not at all."""

import numpy as np
import pandas as pd
import pytest

from foretally.operators import fourier
from foretally.operators.spectra import new_frequency_fraction, spectral_mse


def table(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    parts = {f"n{n}": (rng.normal(5, 2, n), np.cumsum(rng.normal(size=n))) for n in lengths}
    rows = pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(3, 3 + len(a)), "a": a, "b": b}) for k, (a, b) in parts.items()])
    return parts, spark.createDataFrame(rows.sample(frac=1, random_state=1))


@pytest.mark.parametrize("cells, longest", [(1 << 20, 1 << 20), (64, 40), (16, 4)])
def test_power_equals_one_transform(spark, monkeypatch, cells, longest):
    """Whole series in a task, several slabs, and convolutions for all lengths above the longest row."""
    monkeypatch.setattr(fourier, "CELLS", cells)
    monkeypatch.setattr(fourier, "LONGEST", longest)
    parts, rows = table(spark, [1, 2, 7, 12, 97, 144, 211])
    got = {}
    for r in fourier.power_spectrum(rows, ["a", "b"]).collect():
        got.setdefault(r["series_id"], {})[r["bin"]] = r["power"]
    for name, columns in parts.items():
        want = np.stack([np.abs(np.fft.rfft(c - c.mean())) ** 2 for c in columns], axis=1)
        mine = np.array([got[name][k] for k in range(len(want))])
        assert len(got[name]) == len(want)
        np.testing.assert_allclose(mine, want, rtol=1e-9, atol=1e-9 * want.max() + 1e-18)


def test_shapes_cover_the_length():
    for n in (1, 2, 1000, 1 << 20, 1_000_003, 999_983 * 2, 10**9 + 7):
        r, c, chirp = fourier.shape_of(n)
        assert (r * c == n) != chirp and (not chirp or r * c >= 2 * n - 1) and max(r, c) <= fourier.LONGEST


def test_fraction_and_log_spectrum_on_whole_series(spark, monkeypatch):
    monkeypatch.setattr(fourier, "CELLS", 64)
    parts, rows = table(spark, [60, 101], 4)
    rows = rows.selectExpr("*", "a * b AS ab", "a AS y_true", "b AS y_pred")
    got = {r["series_id"]: r["new_frequency_fraction"] for r in new_frequency_fraction(rows, ["a", "b"], ["ab", "b"], threshold=0.05).collect()}
    gaps = {r["series_id"]: r["spectral_mse"] for r in spectral_mse(rows, ["series_id"]).collect()}
    power = lambda x: np.abs(np.fft.rfft(x - x.mean())) ** 2
    for name, (a, b) in parts.items():
        support = power(a) + power(b)
        outside = support <= 0.05 * support.max()
        want = np.mean([power(x)[outside].sum() / power(x).sum() for x in (a * b, b)])
        assert got[name] == pytest.approx(want, rel=1e-9)
        log = lambda x: np.log10(power(x) + 1e-12)
        assert gaps[name] == pytest.approx(np.mean((log(a) - log(b)) ** 2), rel=1e-6)


def test_no_task_holds_a_row_of_half_a_million_entries():
    half = 600_011  # a prime
    assert all(half % d for d in range(2, 775))
    assert max(fourier.shape_of(2 * half)[:2]) <= 1 << 17 and fourier.CELLS <= 1 << 18
