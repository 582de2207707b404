"""Whitening against numpy's eigenvectors, and odd rows."""

import numpy as np
import pytest

from foretally.llm import whitening
from foretally.llm.queries import op11_jacobi_davidson_whitening


def plain(vectors, k=4):
    """x-vectors, exact deviations, values, vectors and trace by numpy."""
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1][:k], turn[:, ::-1][:, :k], values.sum()


def check(got, keys, vectors, k=4):
    x, n, s, values, turn, trace = plain(vectors, k)
    want = (x - s / n) @ turn / np.sqrt(values)
    mine = np.full(want.shape, np.nan)
    for r in got:
        mine[keys.index(r["row"]["id"]), r["component"] - 1] = r["whitened"]
        assert r["n"] == n and abs(r["identity_error"]) < 1e-10 and r["residual"] < 1e-12
        assert r["deviation"] == int(((n * x[keys.index(r["row"]["id"])] - s) ** 2).sum())
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-10)
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * sign).max() < 1e-8


def test_query_against_numpy(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    got = op11_jacobi_davidson_whitening(spark, tiny).collect()
    assert len(got) == 4 * len(rows)
    made = [{"row": {"id": r["vec_id"]}, **r.asDict()} for r in got]
    check(made, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_nulls_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1000)  # many blocks
    rng = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 7)) * np.arange(1, 8))]
    good += [(300 + i, good[0][1]) for i in range(200)]  # one vector holds much of the table
    bad = [(1000, None), (1001, [None] + [0.0] * 6), (1002, [float("nan")] * 7), (1003, [float("inf")] + [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 5, "x") for i, v in good + bad], "id long, embedding array<double>, n int, row string")
    got = whitening.whiten(frame.repartition(5)).collect()
    assert {r["row"]["id"] for r in got} == {i for i, _ in good} and got[0]["row"]["n"] == 5
    check(got, [i for i, _ in good], [v for _, v in good])


@pytest.mark.parametrize("vectors, components", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0], [2.0]], 1), ([[1.0, 2.0], [3.0, 5.0]], 1),
                                                 ([[], []], 0), ([[1.0, 0.0], [1.0], [0.0, 1.0], []], 2), ([[3e38, 0.0], [-3e38, 1.0]], 1)])
def test_small_and_odd_tables(spark, vectors, components):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    got = whitening.whiten(frame).collect()
    assert len(got) == components * len(vectors)
    assert all(np.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in got)


def test_deviations_beyond_a_long():
    assert whitening.deviations(np.array([[3], [-3]]), 2, [0]) == [36, 36]
    assert whitening.deviations(np.array([[1 << 40]]), 1 << 30, [0]) == [None]
    assert whitening.deviations(np.array([[1 << 31, 1]]), 1, [0, 0]) == [(1 << 62) + 1]


@pytest.mark.parametrize("spectrum", [np.ones(20), np.r_[np.full(6, 9.0), np.ones(30)], np.zeros(8), np.r_[100 + 1e-6 * np.arange(5), np.arange(90.0)],
                                      np.geomspace(1, 1e-8, 60)])
def test_hard_spectra(spectrum):
    """Equal and nearly equal values, none at all, and none overlooked."""
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(len(spectrum),) * 2))[0]
    cov = (turn * spectrum) @ turn.T
    values, vectors, residual = whitening.leading(lambda w: cov @ w, len(spectrum), 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-12, atol=1e-13)
    assert residual < 1e-12 and np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
