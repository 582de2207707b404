"""Model fitting and forecasting queries."""

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators import metrics, windows as win
from foretally.operators.baselines import baseline_forecasts, persistence
from foretally.operators.blocks import attach
from foretally.operators.estimators import PanelRidge, window_forecasts
from foretally.operators.matrices import matrix_of
from foretally.operators.neighbours import knn_forecast
from foretally.operators.reservoir import ReservoirConfig, reservoir_forecasts
from foretally.operators.ridge import ridge_fit, ridge_fit_many, ridge_predict, dot, wide_fit, wide_predict
from foretally.operators.rollouts import roll_out
from foretally.operators.scaling import fit_scaler, scale
from foretally.operators.smoothing import smoothing_forecasts, theta_forecasts
from foretally.operators.spectra import spectral_mse
from foretally.operators.split import label_split, split_bounds
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, cell_forecasts, cell_results, labelled_types
from foretally.plans.models import CATALOGUE
from foretally.plans.queries import sqltext as q
from foretally.plans.queries.feature_steps import _scaled_sql, vector_panel
from foretally.sources.tables import panel_by_supplier, panel_by_type, panel_by_user, panel_cells, panel_daily, table


def scaled_windows(spark, sf_dir, taps: int, horizon: int = 1, stride: int = 1, labelled=None) -> DataFrame:
    """Train and test windows (d0.., y, part) of the min-max scaled type panel."""
    rows = labelled if labelled is not None else labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax"))
    return win.train_and_test(win.delays(scaled, taps, stride, horizon, column="u"), taps, stride, horizon)


def poly_expand(taps: int, degree: int):
    """(width, function): window matrix -> taps and monomials up to ``degree`` (no bias)."""
    picks = [list(c) for d in range(2, degree + 1) for c in combinations_with_replacement(range(taps), d)]

    def expand(x):
        out = np.empty((len(x), x.shape[1] + len(picks)))
        out[:, :x.shape[1]] = x
        for i, c in enumerate(picks):
            col = x[:, c[0]] * x[:, c[1]]
            for j in c[2:]:
                col = col * x[:, j]
            out[:, x.shape[1] + i] = col
        return out

    return taps + len(picks), expand


def random_expand(taps: int, units: int, seed: int):
    """A random tanh layer; the weights come from the seed, inside the task."""
    def expand(x):
        rng = np.random.default_rng(seed)
        w = rng.uniform(-1, 1, (units, taps))
        return np.tanh(x @ w.T + rng.uniform(-1, 1, units))
    return units, expand


# ---- SQL for a fit with two taps and a bias: Cramer's rule on the 3 x 3 system ---------

def _det(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


def two_tap_fit(alpha: str, where: str = "part = 'train'", source: str = "parts") -> str:
    g = [["g00", "g01", "g02"], ["g01", "g11", "g12"], ["g02", "g12", "g22"]]
    col = lambda k: [[("b" + str(i)) if j == k else g[i][j] for j in range(3)] for i in range(3)]
    return (f"sums AS (SELECT series_id, sum(d0*d0) + {alpha} AS g00, sum(d0*d1) AS g01, sum(d0) AS g02, sum(d1*d1) + {alpha} AS g11, "
            f"sum(d1) AS g12, count(*) + {alpha} AS g22, sum(d0*y) AS b0, sum(d1*y) AS b1, sum(y) AS b2 FROM {source} WHERE {where} GROUP BY 1), "
            f"weights AS (SELECT series_id, {_det(col(0))}/{_det(g)} AS w0, {_det(col(1))}/{_det(g)} AS w1, {_det(col(2))}/{_det(g)} AS w2 FROM sums)")


_TWO = f"{_scaled_sql('minmax')}, {q.lagged(2, 1, 1, 'scaled', 'u')}, {q.parts(2)}, {two_tap_fit('1e-6::DOUBLE')}"


@query("M1", q.select(_TWO, "SELECT series_id, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS bias FROM weights"))
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_windows(spark, sf_dir, 2)
    fit = ridge_fit(rows.where("part = 'train'"), win.taps_of(2), F.col("y"), 1e-6)
    return fit.select("series_id", *[r(F.col("w")[i]).alias(n) for i, n in enumerate(("w0", "w1", "bias"))])


@query("M2", q.select(_TWO, "SELECT series_id, t, round(y, 6) AS y_true, round(w0*d0 + w1*d1 + w2, 6) AS y_pred "
                            "FROM parts JOIN weights USING (series_id) WHERE part = 'test'"))
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_windows(spark, sf_dir, 2)
    fit = ridge_fit(rows.where("part = 'train'"), win.taps_of(2), F.col("y"), 1e-6)
    test = ridge_predict(rows.where("part = 'test'"), fit, win.taps_of(2))
    return test.select("series_id", "t", r("y").alias("y_true"), r("y_pred").alias("y_pred"))


@query("M9", q.select(_TWO + ", forecasts AS (SELECT series_id, y AS y_true, w0*d0 + w1*d1 + w2 AS y_pred FROM parts JOIN weights "
                      "USING (series_id) WHERE part = 'test')",
       "SELECT series_id, count(*) AS n_test, round(sqrt(avg((y_pred-y_true)^2))/stddev_pop(y_true), 6) AS nrmse, "
       "round(avg(abs(y_pred-y_true)), 6) AS mae FROM forecasts GROUP BY 1"))
def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_windows(spark, sf_dir, 2)
    fit = ridge_fit(rows.where("part = 'train'"), win.taps_of(2), F.col("y"), 1e-6)
    test = ridge_predict(rows.where("part = 'test'"), fit, win.taps_of(2)).withColumnRenamed("y", "y_true")
    return test.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_test"), r(metrics.nrmse()).alias("nrmse"),
                                         r(metrics.mae()).alias("mae"))


@query("M6", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(2)}, {q.parts(2)}, {two_tap_fit('0')}",
       "SELECT series_id, t, round(y, 6) AS y_true, round(w0*d0 + w1*d1 + w2, 5) AS y_pred FROM parts JOIN weights USING (series_id) WHERE part = 'test'"))
def autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lags by conditional least squares on train, one step ahead, never refitted."""
    rows = win.train_and_test(win.delays(labelled_types(spark, sf_dir), 2, 1, 1), 2, 1, 1)
    fit = ridge_fit(rows.where("part = 'train'"), win.taps_of(2), F.col("y"), 0.0)
    test = ridge_predict(rows.where("part = 'test'"), fit, win.taps_of(2))
    return test.select("series_id", "t", r("y").alias("y_true"), r("y_pred", 5).alias("y_pred"))


def vector_windows(spark, sf_dir) -> DataFrame:
    """The train and test rows of ``vector_rows``."""
    return win.train_and_test(vector_rows(spark, sf_dir), 2, 1, 1)


def vector_rows(spark, sf_dir) -> DataFrame:
    """Vector panel rows with flat delays (tap after tap) and the next state."""
    cols = ["c0", "c1", "c2"]
    panel = vector_panel(spark, sf_dir)
    rows = label_split(panel, split_bounds(panel, washout=20))
    from foretally.operators.blocks import in_block, with_halo
    ahead = with_halo(win.delay_row(rows, cols, 2), 0, 1)
    nxt = [F.lead(c, 1).over(in_block()).alias(f"y_{c}") for c in cols]
    ahead = ahead.select("*", *nxt).where("home").drop("home")
    flat = [F.col(f"{c}_lags")[j].alias(f"{c}_{j}") for j in range(2) for c in cols]
    return ahead.select("*", *flat)


VECTOR = ("c0", "c1", "c2")
VECTOR_IN = tuple(f"{c}_{j}" for j in range(2) for c in VECTOR)


def vector_forecasts(spark, sf_dir) -> DataFrame:
    """Test forecasts t_c0.., p_c0.. of a joint ridge on the vector delays."""
    rows = vector_windows(spark, sf_dir)
    feats = [F.col(c) for c in VECTOR_IN]
    fit = ridge_fit_many(rows.where("part = 'train'"), feats, [F.col(f"y_{c}") for c in VECTOR], 1e-6)
    test = attach(rows.where("part = 'test'").drop("n"), fit)
    full = [*feats, F.lit(1.0)]
    return test.select("series_id", "block", "t", *[F.col(f"y_{c}").alias(f"t_{c}") for c in VECTOR],
                       *[dot(full, F.col("w"), i * len(full)).alias(f"p_{c}") for i, c in enumerate(VECTOR)])


@query("M3")
def vector_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forecasts(spark, sf_dir).select(
        "series_id", "t", *[r(f"{a}_{c}").alias(f"{a}_{c}") for a in "tp" for c in VECTOR])


def _scored(forecasts: DataFrame, keys=("series_id",)) -> DataFrame:
    got = metrics.score(forecasts, list(keys))
    return got.select(*keys, "n_test", *[r(c).alias(c) for c in ("nrmse", "rmse", "mae", "r2")])


@query("M4")
def polynomial_delay_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, pairs, ridge and test forecast of the polynomial-delay model, scored."""
    rows = scaled_windows(spark, sf_dir, 3)
    feats = win.monomials(win.taps_of(3), 2, bias=False)
    fit = ridge_fit(rows.where("part = 'train'"), feats, F.col("y"), 1e-6)
    test = ridge_predict(rows.where("part = 'test'"), fit, feats)
    return _scored(test.withColumnRenamed("y", "y_true"))


def volume_forecasts(spark, sf_dir, taps: int = 5, degree: int = 3) -> DataFrame:
    """Polynomial-delay model on the line-item panel: 55 features and a bias, expanded in
    the task and reduced to Gram entries there."""
    panel = panel_by_supplier(spark, sf_dir)
    rows = label_split(panel, split_bounds(panel, washout=10))
    rows = win.train_and_test(win.delays(rows, taps, 1, 1), taps, 1, 1)
    width, expand = poly_expand(taps, degree)
    fit = wide_fit(rows, [f"d{j}" for j in range(taps)], expand, width, 1e-3)
    # the same monomials in the same order as column expressions: forecasts stay in the JVM
    feats = win.monomials(win.taps_of(taps), degree, bias=False)
    test = ridge_predict(rows.where("part = 'test'"), fit, feats)
    return test.select("series_id", "t", F.col("y").alias("y_true"), "y_pred")


@query("M4 F16")
def polynomial_delay_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(volume_forecasts(spark, sf_dir))


@query("M4 F18")
def random_projection_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 random tanh features of five taps per series."""
    rows = scaled_windows(spark, sf_dir, 5)
    width, expand = random_expand(5, 300, 42)
    inputs = [f"d{j}" for j in range(5)]
    return _scored(wide_predict(rows, wide_fit(rows, inputs, expand, width, 1e-6), inputs, expand))


@query("M4 F19")
def recurrent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 recurrent states, ridge per (series, seed), test forecast, scored."""
    rows = labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax"))
    # states run over every row: a fit only sees the train rows
    every = win.delays(scaled, 1, 1, 1, column="u").select("series_id", "block", "t", "u", "y", "n", "washout", "train_end", "val_end")
    got = reservoir_forecasts(every, (0, 1), ReservoirConfig()).withColumnRenamed("run_seed", "seed")
    return _scored(got, ("series_id", "seed"))


@query("M5", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(1)}",
       "SELECT series_id, t, round(y, 6) AS y_true, round(d0, 6) AS y_pred FROM lagged WHERE t >= val_end AND y IS NOT NULL"))
def persistence_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence(panel_by_type(spark, sf_dir)).select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


@query("M7")
def smoothing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(smoothing_forecasts(labelled_types(spark, sf_dir)))


@query("M8")
def theta_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(theta_forecasts(labelled_types(spark, sf_dir)))


def _by_name(spark, sf_dir, kind, taps: int = 5, **how) -> DataFrame:
    return window_forecasts(scaled_windows(spark, sf_dir, taps), kind, [f"d{j}" for j in range(taps)], **how)


@query("M10 M14")
def random_forest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest per series: 200 trees of unlimited depth."""
    return _scored(_by_name(spark, sf_dir, "random_forest", trees=200))


@query("M11 M14")
def boosted_trees_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting per series: 300 rounds of trees of four levels."""
    return _scored(_by_name(spark, sf_dir, "boosted_trees", rounds=300))


@query("M12 M14")
def elastic_net_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_by_name(spark, sf_dir, "elastic_net"))


def stump_sql(taps: int) -> str:
    """One split of the train rows: at most 256 quantile bins, largest drop of the squared error."""
    cols = ", ".join(f"({j}, d{j})" for j in range(taps))
    return (f"{_scaled_sql('minmax')}, {q.lagged(taps, 1, 1, 'scaled', 'u')}, {q.parts(taps)}, "
            f"long AS (SELECT series_id, t, part, y, f, v FROM parts, LATERAL (VALUES {cols}) AS z(f, v)), "
            "ranked AS (SELECT series_id, f, v, row_number() OVER (PARTITION BY series_id, f ORDER BY v) AS rk, count(*) OVER (PARTITION BY series_id, f) AS n FROM long WHERE part = 'train'), "
            "edges AS (SELECT DISTINCT r.series_id, r.f, r.v AS edge FROM ranked r JOIN range(1, 256) k(i) ON r.rk = ceil(i / 256.0 * r.n)), "
            "whole AS (SELECT series_id, count(*) AS tw, sum(y) AS ts FROM parts WHERE part = 'train' GROUP BY 1), "
            "cuts AS (SELECT l.series_id, l.f, e.edge, count(*) AS cw, sum(l.y) AS cs FROM long l JOIN edges e ON l.series_id = e.series_id AND l.f = e.f AND l.v <= e.edge WHERE l.part = 'train' GROUP BY 1, 2, 3), "
            "best AS (SELECT * FROM cuts JOIN whole USING (series_id) WHERE cw < tw QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY cs * cs / cw + (ts - cs) * (ts - cs) / (tw - cw) DESC, f, edge) = 1) "
            "SELECT l.series_id, l.t, round(l.y, 6) AS y_true, round(CASE WHEN l.v <= edge THEN cs / cw ELSE (ts - cs) / (tw - cw) END, 6) AS y_pred "
            "FROM long l JOIN best b ON l.series_id = b.series_id AND l.f = b.f WHERE l.part = 'test'")


@query("M11 M14", "WITH " + stump_sql(3))
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round with a tree of one split on all rows: boosting small enough for SQL."""
    got = _by_name(spark, sf_dir, "boosted_trees", 3, rounds=1, depth=1, rate=1.0, share=1.0, penalty=0.0)
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


_ONE_TAP = (f"{_scaled_sql('minmax')}, {q.lagged(1, 1, 1, 'scaled', 'u')}, {q.parts(1)}, "
            "m AS (SELECT series_id, avg(d0) AS mx, stddev_pop(d0) AS sx, avg(y) AS my, covar_pop(d0, y) AS c FROM parts WHERE part = 'train' GROUP BY 1), "
            "w AS (SELECT *, sign(c) * greatest(abs(c / sx) - 0.005, 0) / (1 + 0.005) / sx AS w FROM m)")


@query("M12 M14", q.select(_ONE_TAP, "SELECT series_id, t, round(y, 6) AS y_true, round(my + w * (d0 - mx), 6) AS y_pred FROM parts JOIN w USING (series_id) WHERE part = 'test'"))
def elastic_net_one_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature: the weight is a soft threshold of its covariance."""
    got = _by_name(spark, sf_dir, "elastic_net", 1, alpha=0.01)
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


_KNN = (f"{_scaled_sql('minmax')}, {q.lagged(2, 1, 1, 'scaled', 'u')}, {q.parts(2)}, "
        "pairs AS (SELECT a.series_id, a.t, a.y AS y_true, b.y AS ny, row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY "
        "(a.d0-b.d0)*(a.d0-b.d0) + (a.d1-b.d1)*(a.d1-b.d1), b.t) AS rk FROM parts a JOIN parts b ON a.series_id = b.series_id "
        "AND a.part = 'test' AND b.part = 'train')")


@query("M13", q.select(_KNN, "SELECT series_id, t, round(min(y_true), 6) AS y_true, round(avg(ny), 6) AS y_pred FROM pairs WHERE rk <= 5 GROUP BY 1, 2"))
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_windows(spark, sf_dir, 2)
    got = knn_forecast(rows.where("part = 'train'"), rows.where("part = 'test'"), ["d0", "d1"])
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


def closed_loop(spark, sf_dir, steps: int = 300, taps: int = 3) -> DataFrame:
    """(series_id, model, t, y_true, y_pred): free runs of two models from the test start."""
    rows = labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax")).select("series_id", "block", "t", "u", "n", "washout", "train_end", "val_end")
    lagged = win.delays(scaled, taps, 1, 1, column="u")
    train = win.train_and_test(lagged, taps, 1, 1).where("part = 'train'")
    anchor = lagged.where(F.col("t") == F.col("val_end") - 1).select(
        "series_id", "val_end", F.array(*[f"d{j}" for j in range(taps)]).alias("window"))
    _, expand = poly_expand(taps, 2)
    linear = ridge_fit(train, win.taps_of(taps), F.col("y"), 1e-6).withColumn("model", F.lit("linear"))
    poly = ridge_fit(train, win.monomials(win.taps_of(taps), 2, bias=False), F.col("y"), 1e-6).withColumn("model", F.lit("poly_delay"))
    runs = roll_out(linear.join(anchor, "series_id"), steps, taps, ["series_id", "model", "val_end"]).unionByName(
        roll_out(poly.join(anchor, "series_id"), steps, taps, ["series_id", "model", "val_end"], expand))
    truth = scaled.select("series_id", F.col("t"), F.col("u").alias("y_true"))
    runs = runs.withColumn("t", F.col("val_end") + F.col("step"))
    return runs.join(truth, ["series_id", "t"]).select("series_id", "model", F.col("step").alias("t"), "y_true", "y_pred")


@query("M15 M16")
def closed_loop_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_loop(spark, sf_dir).select("series_id", "model", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


def vector_closed_loop(spark, sf_dir, steps: int = 300) -> DataFrame:
    rows = vector_rows(spark, sf_dir)
    feats = [F.col(c) for c in VECTOR_IN]
    train = win.train_and_test(rows, 2, 1, 1).where("part = 'train'")
    fit = ridge_fit_many(train, feats, [F.col(f"y_{c}") for c in VECTOR], 1e-6)
    # the last state before the test rows: a free run sees none of them
    anchor = rows.where(F.col("t") == F.col("val_end") - 1).select("series_id", "val_end", F.array(*VECTOR_IN).alias("window"))
    runs = roll_out(fit.join(anchor, "series_id"), steps, 2, ["series_id", "val_end"], dims=3)
    truth = rows.select("series_id", "t", *[F.col(f"y_{c}").alias(f"t_{c}") for c in VECTOR])
    runs = runs.withColumn("t", F.col("val_end") - 1 + F.col("step"))  # the row whose next state step 0 forecasts
    return runs.join(truth, ["series_id", "t"]).select(
        "series_id", F.col("step").alias("t"), *[f"t_{c}" for c in VECTOR],
        *[F.col("y_pred")[i].alias(f"p_{c}") for i, c in enumerate(VECTOR)])


@query("M17")
def vector_closed_loop_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_closed_loop(spark, sf_dir)


_EST = (f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(2)}, " + two_tap_fit("1e-6::DOUBLE", "t >= 20 AND t < train_end - 1", "lagged"))


@query("M18", q.select(_EST, "SELECT series_id, t, round(w0*d0 + w1*d1 + w2, 5) AS y_pred FROM lagged JOIN weights USING (series_id)"))
def estimator_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the first 60 % of every series, predict along the full series."""
    panel = panel_by_type(spark, sf_dir)
    rows = label_split(panel, split_bounds(panel))
    prefix = rows.where("segment = 'train'").select("series_id", "block", "t", "x")
    model = PanelRidge(taps=2, washout=20).fit(prefix)
    return model.transform(panel).select("series_id", "t", r("y_pred", 5).alias("y_pred"))


@query("M19", q.select(f"{q.DAILY}, {q.bounds(washout=10)}, {q.labelled()}, {q.lagged(1)}, forecasts AS (SELECT series_id, y AS y_true, d0 AS y_pred "
                       "FROM lagged WHERE t >= val_end AND y IS NOT NULL)",
       "SELECT series_id, count(*) AS n_test, round(sqrt(avg((y_pred-y_true)^2))/stddev_pop(y_true), 6) AS nrmse FROM forecasts GROUP BY 1"))
def supplied_series_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run on a series that comes from a table (every run here does)."""
    got = persistence(panel_daily(spark, sf_dir))
    return got.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_test"), r(metrics.nrmse()).alias("nrmse"))


_NAMES = ("nrmse", "rmse", "mae", "mse", "r2", "smape", "max_error")
_RUN = (f"{_scaled_sql('minmax')}, {q.lagged(1, 1, 1, 'scaled', 'u')}, forecasts AS (SELECT series_id, 'persistence' AS model, y AS y_true, d0 AS y_pred "
        f"FROM lagged WHERE t >= val_end AND y IS NOT NULL), {q.results('series_id')}")


@query("M20", q.select(_RUN, "SELECT series_id, n_test, " + ", ".join(f"round({m}, 6) AS {m}" for m in _NAMES) + " FROM results"))
def experiment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for the whole panel: split, train-only scaling, forecast, seven scores."""
    rows = labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax"))
    test = win.delays(scaled, 1, 1, 1, column="u").where((F.col("t") >= F.col("val_end")) & F.col("y").isNotNull())
    got = metrics.score(test.select("series_id", "t", F.col("y").alias("y_true"), F.col("d0").alias("y_pred")), ["series_id"])
    return got.select("series_id", "n_test", *[r(m).alias(m) for m in _NAMES])


@query("M21", q.select(q.CELL_RESULTS, "SELECT series_id, model, count(*) AS n_seeds, round(avg(nrmse), 6) AS nrmse_mean, round(stddev_pop(nrmse), 6) AS nrmse_std FROM results GROUP BY 1, 2"))
def multi_seed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_results(spark, sf_dir).groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n_seeds"), r(F.avg("nrmse")).alias("nrmse_mean"), r(F.stddev_pop("nrmse")).alias("nrmse_std"))


@query("D1", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(3)}",
       "SELECT series_id, t, round(y, 6) AS y_true, round(0.5*d0 + 0.3*d1 + 0.2*d2, 6) AS y_pred FROM lagged WHERE t >= val_end AND y IS NOT NULL"))
def forecaster_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's forecaster sees batches of windows and returns one forecast per window."""
    def forecaster(window):  # any function of a window matrix
        return window @ np.array([0.5, 0.3, 0.2])

    def run(batches):
        for pdf in batches:
            yield pdf[["series_id", "t"]].assign(y_true=pdf["y"], y_pred=forecaster(pdf[["d0", "d1", "d2"]].to_numpy(float)))

    rows = win.delays(labelled_types(spark, sf_dir), 3, 1, 1).where((F.col("t") >= F.col("val_end")) & F.col("y").isNotNull())
    got = rows.select("series_id", "t", "y", "d0", "d1", "d2").mapInPandas(run, "series_id string, t long, y_true double, y_pred double")
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


@query("D4", q.select(q.CELL_RESULTS + ", catalogue AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{f}', '{a}')" for k, f, a in CATALOGUE) + ") v(model, family, axes))",
       "SELECT model, family, axes, count(*) AS n_runs, round(avg(nrmse), 6) AS nrmse_mean FROM results JOIN catalogue USING (model) GROUP BY 1, 2, 3"))
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with what the catalogue says about each model (a fixed list of 17 rows)."""
    lookup = spark.createDataFrame(CATALOGUE, "model string, family string, axes string")
    return cell_results(spark, sf_dir).join(lookup, "model").groupBy("model", "family", "axes").agg(
        F.count(F.lit(1)).alias("n_runs"), r(F.avg("nrmse")).alias("nrmse_mean"))


_SQUARE = (f"{_scaled_sql('minmax')}, {q.lagged(1, 1, 1, 'scaled', 'u')}, {q.parts(1)}, sq AS (SELECT * REPLACE (d0 AS d0), d0 * d0 AS d1 FROM parts), "
           + two_tap_fit("1e-6::DOUBLE", source="sq") + ", forecasts AS (SELECT series_id, y AS y_true, w0*d0 + w1*d1 + w2 AS y_pred FROM sq JOIN weights USING (series_id) WHERE part = 'test')")


@query("M4", q.select(_SQUARE, "SELECT series_id, count(*) AS n_test, round(sqrt(avg((y_pred-y_true)^2))/stddev_pop(y_true), 6) AS nrmse, round(sqrt(avg((y_pred-y_true)^2)), 6) AS rmse, "
                               "round(avg(abs(y_pred-y_true)), 6) AS mae, round(1 - avg((y_pred-y_true)^2)/var_pop(y_true), 6) AS r2 FROM forecasts GROUP BY 1"))
def quadratic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest polynomial-delay model: one tap and its square."""
    rows = scaled_windows(spark, sf_dir, 1)
    feats = win.monomials(win.taps_of(1), 2, bias=False)
    test = ridge_predict(rows.where("part = 'test'"), ridge_fit(rows.where("part = 'train'"), feats, F.col("y"), 1e-6), feats)
    return _scored(test.withColumnRenamed("y", "y_true"))


_LEVEL = ("runs AS (SELECT series_id, t, x AS level FROM series WHERE t = 0 UNION ALL SELECT s.series_id, s.t, 0.3::DOUBLE * s.x + 0.7::DOUBLE * runs.level FROM runs "
          "JOIN series s ON s.series_id = runs.series_id AND s.t = runs.t + 1)")
_SMOOTH = f"RECURSIVE {q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(1)}, {_LEVEL}"


@query("M7", q.select(_SMOOTH, "SELECT series_id, t, round(y, 6) AS y_true, round(level, 6) AS y_pred FROM lagged JOIN runs USING (series_id, t) WHERE t >= val_end AND y IS NOT NULL"))
def simple_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing with one fixed parameter and no trend."""
    got = smoothing_forecasts(labelled_types(spark, sf_dir), grid=((0.3, 0.0),))
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


@query("M8", q.select(_SMOOTH + ", acc AS (SELECT series_id, t, y, val_end, (t + 1)::DOUBLE AS n1, sum(x) OVER w AS sx, sum(t * x) OVER w AS stx, t * (t + 1) / 2.0::DOUBLE AS st, t * (t + 1) * (2 * t + 1) / 6.0::DOUBLE AS stt "
                      "FROM lagged WINDOW w AS (PARTITION BY series_id ORDER BY t))",
       "SELECT series_id, t, round(y, 6) AS y_true, round(level + 0.5::DOUBLE * (n1 * stx - st * sx) / (n1 * stt - st * st) * (1 - pow(0.7::DOUBLE, n1)) / 0.3::DOUBLE, 6) AS y_pred FROM acc JOIN runs USING (series_id, t) WHERE t >= val_end AND y IS NOT NULL"))
def theta_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta with one fixed smoothing parameter: level plus half the expanding slope."""
    got = theta_forecasts(labelled_types(spark, sf_dir), grid=(0.3,))
    return got.select("series_id", "t", r("y_true").alias("y_true"), r("y_pred").alias("y_pred"))


_ROLL = (f"RECURSIVE {_TWO}, anchor AS (SELECT l.series_id, l.val_end, l.d0, l.d1, w0, w1, w2 FROM lagged l JOIN weights USING (series_id) WHERE t = val_end - 1), "
         "roll AS (SELECT series_id, val_end, w0, w1, w2, 0 AS step, w0*d0 + w1*d1 + w2 AS p, d0 AS prev FROM anchor UNION ALL "
         "SELECT series_id, val_end, w0, w1, w2, step + 1, w0*p + w1*prev + w2, p FROM roll WHERE step < 299)")


@query("M15 M16", q.select(_ROLL, "SELECT series_id, step, round(p, 6) AS y_pred FROM roll"))
def linear_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred steps of a two-tap linear model fed with its own forecasts."""
    got, _ = rolled(spark, sf_dir)
    return got.select("series_id", "step", r("y_pred").alias("y_pred"))


def rolled(spark, sf_dir, steps: int = 300) -> tuple[DataFrame, DataFrame]:
    """(series_id, val_end, step, y_pred) and the scaled series."""
    rows = labelled_types(spark, sf_dir)
    lagged = win.delays(scale(rows, fit_scaler(rows, "minmax")), 2, 1, 1, column="u")
    fit = ridge_fit(win.train_and_test(lagged, 2, 1, 1).where("part = 'train'"), win.taps_of(2), F.col("y"), 1e-6)
    anchor = lagged.where(F.col("t") == F.col("val_end") - 1).select("series_id", "val_end", F.array("d0", "d1").alias("window"))
    return roll_out(fit.join(anchor, "series_id"), steps, 2, ["series_id", "val_end"]), lagged


# truth and forecast of the first steps side by side, then sums of cosines and sines
_SPECTRA = (f"{_ROLL}, ran AS (SELECT r.series_id, step, s.u AS a, p AS b, count(*) OVER (PARTITION BY r.series_id) AS n FROM roll r JOIN scaled s ON s.series_id = r.series_id AND s.t = r.val_end + step), "
            "mid AS (SELECT series_id, step, n, a - avg(a) OVER k AS a, b - avg(b) OVER k AS b FROM ran WINDOW k AS (PARTITION BY series_id)), "
            "waves AS (SELECT series_id, a, b, k, cos(2 * pi() * ((k * step) % n) / n) AS c, sin(2 * pi() * ((k * step) % n) / n) AS s FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM mid)), "
            "bins AS (SELECT series_id, k, log10(pow(sum(a * c), 2) + pow(sum(a * s), 2) + 1e-12) AS pa, log10(pow(sum(b * c), 2) + pow(sum(b * s), 2) + 1e-12) AS pb FROM waves GROUP BY 1, 2)")


@query("A15", q.select(_SPECTRA, "SELECT series_id, round(avg(pow(pa - pb, 2)), 3) AS spectral_mse FROM bins GROUP BY 1"))
def linear_spectrum_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log spectra of the free-running linear model and of what came."""
    runs, lagged = rolled(spark, sf_dir)
    both = runs.withColumn("t", F.col("val_end") + F.col("step")).join(lagged.select("series_id", "t", F.col("u").alias("y_true")), ["series_id", "t"])
    got = spectral_mse(both, ["series_id"])
    return got.select("series_id", r("spectral_mse", 3).alias("spectral_mse"))
