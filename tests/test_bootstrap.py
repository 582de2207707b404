"""Resampling without resampled rows, and Confidence Sets of many models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretally.operators import bootstrap as boot


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    parts = {"hot": np.round(rng.normal(size=400), 1), "odd": rng.normal(5, 1, 31), "one": np.array([2.0])}
    rows = pd.concat([pd.DataFrame({"k": k, "j": np.arange(len(v)), "d": v}) for k, v in parts.items()])
    return parts, spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(5)


def test_hash_draw_is_the_same_in_both_forms(spark):
    rows = spark.range(50).select(F.col("id").alias("b"), (F.col("id") * 7 - 20).alias("j"), F.lit(1000).cast("long").alias("n"))
    got = [r["x"] for r in rows.select(boot.hash_draw(F.col("b"), F.col("j"), F.col("n"), 5).alias("x")).collect()]
    b = np.arange(50)
    assert boot.hash_draw.numbers(b, b * 7 - 20, 1000, 5).tolist() == got


@pytest.mark.parametrize("cells", [1 << 20, 700])
def test_closed_form_resamples_equal_resampled_rows(pairs, monkeypatch, cells):
    """Values lie in several slices; sums and middle values are those of the rows themselves."""
    monkeypatch.setattr(boot, "CELLS", cells)
    parts, df = pairs
    got = {(r["k"], r["b"]): (r["mean"], r["median"]) for r in boot.resample_stats(df, ["k"], "d", 40, boot.congruential_draw, 2).collect()}
    assert len(got) == 40 * len(parts)
    for k, v in parts.items():
        n = len(v)
        for b in range(40):
            rows = v[boot.congruential_draw.numbers(np.int64(b), np.arange(n), n, 2)]
            np.testing.assert_allclose(got[k, b], (rows.mean(), np.median(rows)), rtol=1e-12, atol=1e-12)


def test_split_draws_have_the_right_spread(pairs):
    parts, df = pairs
    rows = boot.resample_stats(df, ["k"], "d", 2000).collect()
    again = boot.resample_stats(df, ["k"], "d", 2000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for k, v in parts.items():
        means = np.array([r["mean"] for r in rows if r["k"] == k])
        assert means.size == 2000 and abs(means.mean() - v.mean()) <= 5 * v.std() / np.sqrt(len(v) * 2000) + 1e-9
        assert means.std() == pytest.approx(v.std() / np.sqrt(len(v)), rel=0.08, abs=1e-9)
        medians = np.array([r["median"] for r in rows if r["k"] == k])
        assert v.min() <= medians.min() and medians.max() <= v.max() and abs(np.median(medians) - np.median(v)) < 0.3


@pytest.mark.parametrize("draw", [boot.hash_draw, boot.congruential_draw])
def test_block_means_over_slices(spark, draw):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(211, 3))
    wide = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(211), "l_0": x[:, 0], "l_1": x[:, 1], "l_2": x[:, 2]}))
    got = {r["b"]: [r["l_0"], r["l_1"], r["l_2"]] for r in boot.block_means(wide, ["l_0", "l_1", "l_2"], ["k"], 30, 8, draw, block_rows=64).collect()}
    assert sorted(got) == list(range(30))
    for b in range(30):
        rows = []
        for j in range(-(-211 // 8)):
            start = int(draw.numbers(np.int64(b), np.int64(j), 211))
            rows += [(start + i) % 211 for i in range(min(8, 211 - 8 * j))]
        np.testing.assert_allclose(got[b], x[rows].mean(axis=0), rtol=1e-10, atol=1e-12)


def plain_set(loss, means):
    """Every round from the statistics of all pairs still in."""
    moved, inside, order, p = means - loss, list(range(len(loss))), [], []
    sd = lambda z: np.sqrt(z.var(ddof=1))
    while len(inside) > 1:
        pairs = [(i, j) for i in inside for j in inside if i < j]
        seen = max(abs(loss[i] - loss[j]) / sd(moved[:, i] - moved[:, j]) for i, j in pairs)
        drawn = np.max([np.abs(moved[:, i] - moved[:, j]) / sd(moved[:, i] - moved[:, j]) for i, j in pairs], axis=0)
        p.append((drawn >= seen).mean())
        t = [(loss[i] - loss[inside].mean()) / sd(moved[:, i] - moved[:, inside].mean(axis=1)) for i in inside]
        order.append(inside.pop(int(np.argmax(t))))
    return order + inside, [*np.maximum.accumulate(p), 1.0]


def frames(spark, loss, means):
    names = [f"l_{i}" for i in range(len(loss))]
    resampled = spark.createDataFrame(pd.DataFrame(means, columns=names).assign(k="a", b=np.arange(len(means))))
    return resampled, spark.createDataFrame(pd.DataFrame([loss], columns=names).assign(k="a")), [f"m{i}" for i in range(len(loss))]


def test_confidence_set_equals_all_pairs_each_round(spark):
    rng = np.random.default_rng(1)
    loss = 1 + 0.1 * rng.random(9)
    means = loss + 0.05 * rng.normal(size=(120, 9)) @ rng.normal(size=(9, 9)) / 3
    got = boot.confidence_set(*frames(spark, loss, means), ["k"]).orderBy("eliminated").collect()
    order, p = plain_set(loss, means)
    assert [r["model"] for r in got] == [f"m{i}" for i in order]
    np.testing.assert_allclose([r["mcs_pvalue"] for r in got], p)


def test_two_hundred_models_and_a_thousand_resamples(spark):
    rng = np.random.default_rng(2)
    loss = np.r_[np.ones(20), 1.5 + rng.random(180)]
    means = loss + 0.02 * rng.normal(size=(1000, 200))
    got = boot.confidence_set(*frames(spark, loss, means), ["k"]).collect()
    kept = {r["model"] for r in got if r["in_set_10"]}
    assert len(got) == 200 and kept <= {f"m{i}" for i in range(20)} and kept
