"""Metric, tally and study-summary queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators import metrics, tallies, windows as win
from foretally.operators.baselines import baseline_forecasts
from foretally.operators.matrices import rank_report, residual_power
from foretally.operators.ridge import gram, solver
from foretally.operators.scaling import fit_scaler, scale
from foretally.operators.quantiles import exact_quantiles
from foretally.operators.spectra import new_frequency_fraction, spectral_mse, wasserstein
from foretally.operators.split import label_split, split_bounds
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, MODELS, cell_forecasts, cell_results, labelled_types, user_results
from foretally.plans.queries import sqltext as q
from foretally.plans.queries.feature_steps import _scaled_sql
from foretally.plans.queries.forecasting import VECTOR, closed_loop, scaled_windows, vector_closed_loop, vector_panel
from foretally.session import durable
from foretally.sources.tables import panel_by_type, panel_by_user, panel_cells, table

_F, _R, _UR = q.CELL_FORECASTS, q.CELL_RESULTS, q.USER_RESULTS
_KEYS = [*CELL, "model"]


def _metric(spark, sf_dir, **cols):
    return cell_forecasts(spark, sf_dir).groupBy(*_KEYS).agg(*[r(c).alias(n) for n, c in cols.items()])


def _metric_sql(*pairs):
    return q.select(_F, "SELECT series_id, seed, model, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in pairs) + " FROM forecasts GROUP BY 1, 2, 3")


@query("A1", _metric_sql(("mse", "avg((y_pred-y_true)^2)"), ("rmse", "sqrt(avg((y_pred-y_true)^2))")))
def squared_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, mse=metrics.mse(), rmse=metrics.rmse())


@query("A2", _metric_sql(("mae", "avg(abs(y_pred-y_true))")))
def mean_absolute_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, mae=metrics.mae())


@query("A3", _metric_sql(("max_error", "max(abs(y_pred-y_true))")))
def maximum_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, max_error=metrics.max_error())


@query("A4", _metric_sql(("r2", "1 - avg((y_pred-y_true)^2)/var_pop(y_true)")))
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, r2=metrics.r2())


@query("A5", _metric_sql(("smape", "100*avg(2*abs(y_pred-y_true)/CASE WHEN abs(y_true)+abs(y_pred)=0 THEN 1 ELSE abs(y_true)+abs(y_pred) END)")))
def symmetric_percentage_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, smape=metrics.smape())


@query("A6", _metric_sql(("mape", "100*avg(CASE WHEN abs(y_true) >= 1 THEN abs(y_pred-y_true)/abs(y_true) END)")))
def percentage_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, mape=metrics.mape(1.0))


@query("A7", q.select(f"{q.USER_FORECASTS}", "SELECT series_id, model, round(sqrt(avg((y_pred-y_true)^2))/stddev_pop(y_true), 6) AS nrmse FROM forecasts GROUP BY 1, 2"))
def normalised_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = baseline_forecasts(panel_by_user(spark, sf_dir), ("series_id",), washout=3)
    return got.groupBy("series_id", "model").agg(r(metrics.nrmse()).alias("nrmse"))


@query("A8")
def vector_nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate and per-component NRMSE of the persistence forecast of the vector panel."""
    from foretally.plans.queries.forecasting import vector_forecasts
    rows = vector_forecasts(spark, sf_dir)
    each = metrics.vector_scores(rows, ["series_id"], [f"t_{c}" for c in VECTOR], [f"p_{c}" for c in VECTOR])
    total = each.groupBy("series_id").agg(r(F.sqrt(F.sum("mse") / F.sum("var"))).alias("nrmse")).withColumn("component", F.lit("all"))
    return each.select("series_id", "component", r("nrmse").alias("nrmse")).unionByName(total)


_VP = ("vec AS (SELECT o_orderpriority AS series_id, o_orderdate AS day, round(sum(o_totalprice), 2) / 1000 AS c0, count(*)::DOUBLE AS c1, "
       "max(o_totalprice) / 1000 AS c2 FROM orders GROUP BY 1, 2), vp AS (SELECT series_id, day, c0, c1, c2, lead(c0) OVER w AS t0, lead(c1) OVER w AS t1, "
       "lead(c2) OVER w AS t2 FROM vec WINDOW w AS (PARTITION BY series_id ORDER BY day))")


def _vector_persistence(spark, sf_dir):
    from foretally.operators.blocks import in_block, with_halo
    rows = with_halo(vector_panel(spark, sf_dir), 0, 1)
    ahead = [F.lead(c, 1).over(in_block()).alias(f"t_{c}") for c in VECTOR]
    rows = rows.select("*", *ahead).where("home").drop("home").where("t_c0 IS NOT NULL")
    return rows.select("series_id", "t", *[f"t_{c}" for c in VECTOR], *[F.col(c).alias(f"p_{c}") for c in VECTOR])


@query("A8", q.select(_VP + ", e AS (SELECT series_id, avg((c0-t0)^2) AS m0, avg((c1-t1)^2) AS m1, avg((c2-t2)^2) AS m2, var_pop(t0) AS v0, "
                      "var_pop(t1) AS v1, var_pop(t2) AS v2 FROM vp WHERE t0 IS NOT NULL GROUP BY 1)",
       "SELECT series_id, 'all' AS component, round(sqrt((m0+m1+m2)/(v0+v1+v2)), 6) AS nrmse FROM e "
       + " ".join(f"UNION ALL SELECT series_id, 't_c{i}', round(sqrt(m{i}/v{i}), 6) FROM e" for i in range(3))))
def vector_persistence_nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.vector_scores(_vector_persistence(spark, sf_dir), ["series_id"], [f"t_{c}" for c in VECTOR], [f"p_{c}" for c in VECTOR])
    total = each.groupBy("series_id").agg(r(F.sqrt(F.sum("mse") / F.sum("var"))).alias("nrmse")).withColumn("component", F.lit("all"))
    return each.select("series_id", "component", r("nrmse").alias("nrmse")).unionByName(total)


_NAMES = ("nrmse", "rmse", "mae", "mse", "r2", "smape", "max_error")


@query("A9", q.select(_R, "SELECT series_id, seed, model, n_test, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in _NAMES) + " FROM results"))
def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_results(spark, sf_dir).select(*_KEYS, "n_test", *[r(m).alias(m) for m in _NAMES])


_STEP = "step AS (SELECT f.*, t - min(t) OVER w AS step, stddev_pop(y_true) OVER w AS sd, count(*) OVER w AS m FROM forecasts f WINDOW w AS (PARTITION BY series_id, seed, model))"


@query("A10", q.select(f"{_F}, {_STEP}", "SELECT series_id, seed, model, CAST(coalesce(min(CASE WHEN abs(y_pred-y_true)/sd > 2.0 THEN step END), max(m)) AS BIGINT) AS vpt_steps FROM step GROUP BY 1, 2, 3"))
def valid_prediction_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.valid_prediction_time(cell_forecasts(spark, sf_dir), _KEYS, 2.0)


@query("A11", q.select(_VP + ", s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, sqrt((c0-t0)^2+(c1-t1)^2+(c2-t2)^2) AS e, "
                       "sqrt(var_pop(t0) OVER w + var_pop(t1) OVER w + var_pop(t2) OVER w) AS sd, count(*) OVER w AS m FROM vp WHERE t0 IS NOT NULL WINDOW w AS (PARTITION BY series_id))",
       "SELECT series_id, CAST(coalesce(min(CASE WHEN e/sd > 3.0 THEN t END), max(m)) AS BIGINT) AS vpt_steps FROM s GROUP BY 1"))
def vector_valid_prediction_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.valid_prediction_time_vector(_vector_persistence(spark, sf_dir), ["series_id"], [f"t_{c}" for c in VECTOR], [f"p_{c}" for c in VECTOR], 3.0)


@query("A12 J11", q.select(f"{_F}, {_STEP}, vpt AS (SELECT series_id, seed, model, coalesce(min(CASE WHEN abs(y_pred-y_true)/sd > 2.0 THEN step END), max(m)) AS v FROM step GROUP BY 1, 2, 3), "
                       "rates AS (SELECT event_type AS series_id, count(*) / 10000.0::DOUBLE AS rate FROM events GROUP BY 1)",
       "SELECT series_id, seed, model, round(v * rate, 6) AS vpt_times FROM vpt JOIN rates USING (series_id)"))
def prediction_time_in_characteristic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps times a per-series rate (here the share of events of that type)."""
    vpt = metrics.valid_prediction_time(cell_forecasts(spark, sf_dir), _KEYS, 2.0)
    rates = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id")).agg((F.count(F.lit(1)) / 10000.0).alias("rate"))
    return vpt.join(rates, "series_id").select(*_KEYS, r(F.col("vpt_steps") * F.col("rate")).alias("vpt_times"))


@query("A13", q.select(_F, "SELECT series_id, seed, model, max(abs(y_pred) * CASE WHEN model = 'drift' THEN 8 ELSE 1 END) > 10 * (max(abs(y_true)) + 1e-9) AS diverged FROM forecasts GROUP BY 1, 2, 3"))
def divergence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift forecast is blown up eightfold, so that some cells diverge."""
    loud = F.when(F.col("model") == "drift", 8 * F.col("y_pred")).otherwise(F.col("y_pred"))
    return cell_forecasts(spark, sf_dir).withColumn("y_pred", loud).groupBy(*_KEYS).agg(metrics.diverged().alias("diverged"))


@query("A14", q.select(_F + ", z AS (SELECT series_id, seed, model, y_true AS v, 1 AS a, 0 AS b FROM forecasts UNION ALL SELECT series_id, seed, model, y_pred, 0, 1 FROM forecasts), "
                       "g AS (SELECT series_id, seed, model, v, sum(a) AS a, sum(b) AS b FROM z GROUP BY 1, 2, 3, 4), "
                       "c AS (SELECT *, sum(a) OVER (w ORDER BY v) / sum(a) OVER w AS fa, sum(b) OVER (w ORDER BY v) / sum(b) OVER w AS fb, lead(v) OVER (w ORDER BY v) - v AS gap "
                       "FROM g WINDOW w AS (PARTITION BY series_id, seed, model))",
       "SELECT series_id, seed, model, round(coalesce(sum(abs(fa - fb) * gap), 0), 6) AS wasserstein FROM c GROUP BY 1, 2, 3"))
def wasserstein_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wasserstein(cell_forecasts(spark, sf_dir), _KEYS).select(*_KEYS, r("wasserstein").alias("wasserstein"))


@query("A15")
def log_spectrum_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_mse(closed_loop(spark, sf_dir), ["series_id", "model"])


@query("A16 A17")
def feature_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerical rank, effective rank and condition number of the polynomial features of
    every type series (train rows), by a distributed QR."""
    rows = scaled_windows(spark, sf_dir, 3).where("part = 'train'")
    feats = win.monomials(win.taps_of(3), 3)
    cols = [c.alias(f"f{i}") for i, c in enumerate(feats)]
    return rank_report(rows.select("series_id", *cols), [f"f{i}" for i in range(len(feats))], ["series_id"])


@query("A16 A17")
def embedding_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("f"))
    return rank_report(rows, ["f"], ["label"])


@query("A18")
def memory_capacity(spark: SparkSession, sf_dir: str, k_max: int = 6) -> DataFrame:
    """Sum over lags of the squared correlation between the lagged input and its ridge
    reconstruction from the present features (no bias), from Gram sums per lag."""
    rows = labelled_types(spark, sf_dir)
    lagged = win.delays(scale(rows, fit_scaler(rows, "minmax")), k_max + 1, column="u")
    feats = win.random_layer(win.taps_of(3), *_layer())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("target")) for k in range(1, k_max + 1)]))
    long = lagged.select("series_id", "t", "n", *[f.alias(f"f{i}") for i, f in enumerate(feats)], each.alias("e"))
    long = long.select("*", "e.k", "e.target").where(F.col("t") >= F.col("k"))
    fs = [F.col(f"f{i}") for i in range(len(feats))]
    full = [*fs, F.col("target"), F.lit(1.0)]  # one Gram holds every sum the correlation needs
    sums = gram(long, full, [F.col("target")], ["series_id", "k"])
    w = len(fs)
    at = {}
    for i in range(w + 2):
        for j in range(i, w + 2):
            at[i, j] = len(at)
    g = lambda i, j: F.col("g")[at[min(i, j), max(i, j)]]
    inner = F.array(*[g(i, j) for i in range(w) for j in range(i, w)])
    fit = sums.withColumn("w", solver(w, 1e-6)(inner, F.slice("b", 1, w)))
    wt = [F.col("w")[i] for i in range(w)]
    n, sy, syy = g(w + 1, w + 1), g(w, w + 1), g(w, w)
    sp = sum(wt[i] * g(i, w + 1) for i in range(w))
    spy = sum(wt[i] * g(i, w) for i in range(w))
    spp = sum(wt[i] * wt[j] * g(i, j) for i in range(w) for j in range(w))
    cov, vp, vy = spy - sp * sy / n, spp - sp * sp / n, syy - sy * sy / n
    share = F.coalesce(cov * cov / F.when((vp > 0) & (vy > 0), vp * vy), F.lit(0.0))
    return fit.select("series_id", share.alias("r2")).groupBy("series_id").agg(r(F.sum("r2")).alias("memory_capacity"))


def _layer():
    from foretally.plans.queries.feature_steps import SINE_BIAS, SINE_WEIGHTS
    return SINE_WEIGHTS, SINE_BIAS


@query("A19", "WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), "
              "p AS (SELECT label, pos, var_pop(v) AS s FROM f GROUP BY 1, 2) SELECT label, CASE WHEN pos <= 48 THEN 'first' ELSE 'second' END AS class, "
              "round(avg(s), 8) AS mean_var, round(stddev_pop(s), 8) AS std_var FROM p GROUP BY 1, 2")
def feature_variance_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of each feature across rows, averaged over two classes of features."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    each = long.groupBy("label", "pos").agg(F.var_pop("v").alias("s"))
    kind = F.when(F.col("pos") < 48, "first").otherwise("second")
    return each.groupBy("label", kind.alias("class")).agg(r(F.avg("s"), 8).alias("mean_var"), r(F.stddev_pop("s"), 8).alias("std_var"))


def _base_and_products(spark, sf_dir):
    rows = scaled_windows(spark, sf_dir, 2)
    return rows.select("series_id", "block", "t", "d0", "d1", (F.col("d0") * F.col("d1")).alias("p01"), (F.col("d0") * F.col("d0")).alias("p00"))


@query("A20")
def residual_power_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the product features that the linear taps do not explain."""
    return residual_power(_base_and_products(spark, sf_dir), ["d0", "d1"], ["p01", "p00"], ["series_id"])


_BINS = (f"{_scaled_sql('minmax')}, {q.lagged(2, 1, 0, 'scaled', 'u')}, "
         "mid AS (SELECT series_id, t, count(*) OVER k AS n, d0 - avg(d0) OVER k AS a, d1 - avg(d1) OVER k AS b, d0 * d1 - avg(d0 * d1) OVER k AS c, d0 * d0 - avg(d0 * d0) OVER k AS d "
         "FROM lagged WINDOW k AS (PARTITION BY series_id)), "
         "waves AS (SELECT series_id, k, a, b, c, d, cos(2 * pi() * ((k * t) % n) / n) AS x, sin(2 * pi() * ((k * t) % n) / n) AS y FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM mid)), "
         "bins AS (SELECT series_id, k, pow(sum(a * x), 2) + pow(sum(a * y), 2) + pow(sum(b * x), 2) + pow(sum(b * y), 2) AS base, "
         "pow(sum(c * x), 2) + pow(sum(c * y), 2) AS pc, pow(sum(d * x), 2) + pow(sum(d * y), 2) AS pd FROM waves GROUP BY 1, 2), "
         "marked AS (SELECT *, base <= 0.01 * max(base) OVER (PARTITION BY series_id) AS outside FROM bins)")


@query("A21", q.select(_BINS, "SELECT series_id, round((sum(CASE WHEN outside THEN pc ELSE 0 END) / sum(pc) + sum(CASE WHEN outside THEN pd ELSE 0 END) / sum(pd)) / 2, 6) AS new_frequency_fraction FROM marked GROUP BY 1"))
def new_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the product features' spectral power outside the taps' support, whole series."""
    rows = labelled_types(spark, sf_dir)
    lagged = win.delays(scale(rows, fit_scaler(rows, "minmax")), 2, column="u")
    feats = lagged.select("series_id", "t", "d0", "d1", (F.col("d0") * F.col("d1")).alias("p01"), (F.col("d0") * F.col("d0")).alias("p00"))
    got = new_frequency_fraction(feats, ["d0", "d1"], ["p01", "p00"])
    return got.select("series_id", r("new_frequency_fraction").alias("new_frequency_fraction"))


_MED = "med AS (SELECT series_id, seed, model, median(nrmse) AS m FROM results GROUP BY 1, 2, 3)"


@query("A22", q.select(f"{_R}, {_MED}, e AS (SELECT series_id, seed, min(CASE WHEN model = 'moving_average' THEN m END) AS mine, min(CASE WHEN model <> 'moving_average' THEN m END) AS rest FROM med GROUP BY 1, 2)",
       "SELECT count(*) AS cells, CAST(sum(CASE WHEN mine < rest THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM e WHERE mine IS NOT NULL"))
def strict_win_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.strict_wins(cell_results(spark, sf_dir), CELL, "moving_average")


@query("A23 L4", q.select(_UR, "SELECT model, count(*) AS wins FROM (SELECT series_id, model FROM results QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY nrmse, model) = 1) GROUP BY 1"))
def first_minimum_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.first_minimum_wins(user_results(spark, sf_dir), ["series_id"])


@query("A24", q.select(_UR, "SELECT model, round(median(nrmse), 6) AS median, round(quantile_cont(nrmse, 0.25), 6) AS q1, round(quantile_cont(nrmse, 0.75), 6) AS q3, "
                            "round(quantile_cont(nrmse, 0.75) - quantile_cont(nrmse, 0.25), 6) AS iqr, count(*) AS n FROM results GROUP BY 1"))
def median_and_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tallies.median_iqr(user_results(spark, sf_dir), ["model"], "nrmse")
    return got.select("model", *[r(c).alias(c) for c in ("median", "q1", "q3", "iqr")], "n")


@query("A25", q.select(_R, "SELECT model, round(avg(nrmse), 6) AS mean, round(stddev_samp(nrmse), 6) AS std, round(min(nrmse), 6) AS min, round(max(nrmse), 6) AS max, "
                           "CASE model WHEN 'persistence' THEN 1 WHEN 'train_mean' THEN 2 WHEN 'moving_average' THEN 3 ELSE 4 END AS position FROM results GROUP BY 1"))
def per_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample std, min, max per level in the order the levels were given."""
    order = F.element_at(F.create_map(*[F.lit(v) for i, m in enumerate(MODELS) for v in (m, i)]), F.col("model"))
    got = tallies.per_level(cell_results(spark, sf_dir).withColumn("_o", order), "model", "nrmse", "_o")
    return got.select("model", *[r(c).alias(c) for c in ("mean", "std", "min", "max")], "position")


@query("A26", q.select(f"{_R}, m AS (SELECT series_id, model, avg(nrmse) AS v FROM results GROUP BY 1, 2)",
       "SELECT series_id, arg_min(model, v) AS best, round(min(v), 6) AS best_value, arg_max(model, v) AS worst, round(max(v), 6) AS worst_value, round(max(v) / min(v), 6) AS spread, count(*) AS levels FROM m GROUP BY 1"))
def best_and_worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tallies.best_and_worst(cell_results(spark, sf_dir), ["series_id"], "model", "nrmse")
    return got.select("series_id", "best", r("best_value").alias("best_value"), "worst", r("worst_value").alias("worst_value"), r("spread").alias("spread"), "levels")


def study_rows(spark, sf_dir) -> DataFrame:
    """A study in long form: per (model, series, seed) the axis 'seed' and the axis 'series'."""
    rows = cell_results(spark, sf_dir)
    each = F.explode(F.array(
        F.struct(F.lit("seed").alias("axis"), F.col("seed").cast("string").alias("level")),
        F.struct(F.lit("series").alias("axis"), F.col("series_id").alias("level")),
        F.struct(F.lit("size").alias("axis"), F.when(F.col("n_test") % 2 == 0, "even").otherwise("odd").alias("level"))))
    return rows.select("model", "nrmse", each.alias("a")).select("model", "nrmse", "a.*")


_STUDY = ("study AS (SELECT model, nrmse, 'seed' AS axis, CAST(seed AS VARCHAR) AS level FROM results UNION ALL SELECT model, nrmse, 'series', series_id FROM results "
          "UNION ALL SELECT model, nrmse, 'size', CASE WHEN n_test % 2 = 0 THEN 'even' ELSE 'odd' END FROM results)")
_SWING = f"{_R}, {_STUDY}, lm AS (SELECT model, axis, level, avg(nrmse) AS m FROM study GROUP BY 1, 2, 3), swing AS (SELECT model, axis, max(m) / greatest(min(m), 1e-12) AS ratio_swing FROM lm GROUP BY 1, 2)"


@query("A27", q.select(_SWING, "SELECT model, axis, round(ratio_swing, 6) AS ratio_swing FROM swing"))
def axis_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tallies.ratio_swing(study_rows(spark, sf_dir), ["model"], "axis", "level", "nrmse")
    return got.select("model", "axis", r("ratio_swing").alias("ratio_swing"))


@query("W2", q.select(_SWING, "SELECT model, axis, rank() OVER (PARTITION BY model ORDER BY ratio_swing DESC) + (count(*) OVER (PARTITION BY model, ratio_swing) - 1) / 2.0::DOUBLE AS axis_rank FROM swing"))
def axis_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    swing = tallies.ratio_swing(study_rows(spark, sf_dir), ["model"], "axis", "level", "nrmse")
    return swing.select("model", "axis", tallies.average_rank(["model"], F.col("ratio_swing")).alias("axis_rank"))


@query("A38", q.select(f"{_SWING}, ranked AS (SELECT a.model AS model_a, b.model AS model_b, rank() OVER (PARTITION BY a.model, b.model ORDER BY a.ratio_swing DESC) AS ra, "
                       "rank() OVER (PARTITION BY a.model, b.model ORDER BY b.ratio_swing DESC) AS rb FROM swing a JOIN swing b USING (axis))",
       "SELECT model_a, model_b, round(corr(ra, rb), 6) + 0.0 AS spearman, count(*) AS axes FROM ranked GROUP BY 1, 2"))
def axis_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    swing = tallies.ratio_swing(study_rows(spark, sf_dir), ["model"], "axis", "level", "nrmse")
    return tallies.rank_correlation(swing).select("model_a", "model_b", r("spearman").alias("spearman"), "axes")


def _scoped(keys="series_id"):
    """persistence on data scaled by train-only and by global min-max: the scope study."""
    out = []
    for scope, cond in (("train", "in_fit"), ("global", "TRUE")):
        out.append(f"p_{scope} AS (SELECT series_id, max(CASE WHEN {cond} THEN x END) - min(CASE WHEN {cond} THEN x END) AS s FROM labelled GROUP BY 1), "
                   f"r_{scope} AS (SELECT l.series_id, sqrt(avg(((d0 - y) / s)^2)) AS rmse FROM lagged l JOIN p_{scope} p USING (series_id) WHERE t >= val_end AND y IS NOT NULL GROUP BY 1)")
    return f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(1)}, " + ", ".join(out)


def scope_results(spark, sf_dir) -> DataFrame:
    """(series_id, scope, rmse) of persistence in scaled units, per scaler scope."""
    out = None
    for scope in ("train", "global"):
        rows = labelled_types(spark, sf_dir, scope=scope)
        scaled = scale(rows, fit_scaler(rows, "minmax"))
        test = win.delays(scaled, 1, 1, 1, column="u").where((F.col("t") >= F.col("val_end")) & F.col("y").isNotNull())
        got = test.select("series_id", F.col("y").alias("y_true"), F.col("d0").alias("y_pred")).groupBy("series_id").agg(metrics.rmse().alias("rmse"))
        got = got.withColumn("scope", F.lit(scope))
        out = got if out is None else out.unionByName(got)
    return out


@query("A31", q.select(_scoped(), "SELECT series_id, round(a.rmse, 6) AS train_scope, round(b.rmse, 6) AS global_scope, round(b.rmse / a.rmse, 6) AS global_over_train, "
                                  "round(greatest(a.rmse, b.rmse) / least(a.rmse, b.rmse), 6) AS artifact_ratio FROM r_train a JOIN r_global b USING (series_id)"))
def leakage_study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("scope") == s, F.col("rmse")))
    got = scope_results(spark, sf_dir).groupBy("series_id").agg(mean("train").alias("a"), mean("global").alias("b"), F.max("rmse").alias("hi"), F.min("rmse").alias("lo"))
    return got.select("series_id", r("a").alias("train_scope"), r("b").alias("global_scope"), r(F.col("b") / F.col("a")).alias("global_over_train"),
                      r(F.col("hi") / F.col("lo")).alias("artifact_ratio"))


@query("A32", q.select(f"{_R}, pm AS (SELECT seed AS pipeline, model, avg(nrmse) AS v FROM results GROUP BY 1, 2), s AS (SELECT pipeline, max(v) AS worst, avg(v) AS mean, var_pop(v) AS variance FROM pm GROUP BY 1)",
       "SELECT 'maximin' AS criterion, arg_min(pipeline, worst) AS pipeline, round(min(worst), 6) AS value FROM s UNION ALL SELECT 'mean', arg_min(pipeline, mean), round(min(mean), 6) FROM s "
       "UNION ALL SELECT 'variance', arg_min(pipeline, variance), round(min(variance), 6) FROM s"))
def robust_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner under worst case, mean and variance over the models (pipeline = seed here)."""
    per = cell_results(spark, sf_dir).groupBy(F.col("seed").alias("pipeline"), "model").agg(F.avg("nrmse").alias("v"))
    s = per.groupBy("pipeline").agg(F.max("v").alias("maximin"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    best = s.agg(*[F.min(F.struct(F.col(c).alias("value"), "pipeline")).alias(c) for c in ("maximin", "mean", "variance")])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.pipeline").alias("pipeline"), r(f"{c}.value").alias("value")) for c in ("maximin", "mean", "variance")]))
    return best.select(each.alias("e")).select("e.*")


@query("A33", q.select(f"{_R}, b AS (SELECT series_id, n_test AS size, model, avg(nrmse) AS v FROM results GROUP BY 1, 2, 3)",
       "SELECT a.series_id, a.size, round(a.v, 6) AS first_score, round(b.v, 6) AS second_score, a.v < b.v AS first_better, round(b.v / a.v, 6) AS ratio "
       "FROM b a JOIN b b ON a.series_id = b.series_id AND a.size = b.size AND a.model = 'moving_average' AND b.model = 'train_mean'"))
def matched_size_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models compared only where their sizes match."""
    b = cell_results(spark, sf_dir).groupBy("series_id", F.col("n_test").alias("size"), "model").agg(F.avg("nrmse").alias("v"))
    first = b.where("model = 'moving_average'").select("series_id", "size", F.col("v").alias("a"))
    second = b.where("model = 'train_mean'").select("series_id", "size", F.col("v").alias("b"))
    both = first.join(second, ["series_id", "size"])
    return both.select("series_id", "size", r("a").alias("first_score"), r("b").alias("second_score"), (F.col("a") < F.col("b")).alias("first_better"), r(F.col("b") / F.col("a")).alias("ratio"))


@query("A36 J11", q.select(_R, "SELECT a.series_id, a.seed, a.model, round(b.nrmse / a.nrmse, 6) AS skill FROM results a JOIN results b ON a.series_id = b.series_id AND a.seed = b.seed AND b.model = 'persistence'"))
def skill_over_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cell_results(spark, sf_dir)
    base = rows.where("model = 'persistence'").select(*CELL, F.col("nrmse").alias("base"))
    return rows.join(base, list(CELL)).select(*_KEYS, r(F.col("base") / F.col("nrmse")).alias("skill"))


@query("A37", q.select(_R, "SELECT series_id, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN nrmse END), 6) AS {m}" for m in MODELS) + " FROM results GROUP BY 1"))
def pivot_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cell_results(spark, sf_dir).groupBy("series_id").pivot("model", list(MODELS)).agg(F.avg("nrmse"))
    return got.select("series_id", *[r(m).alias(m) for m in MODELS])


@query("A39", q.select(f"{_R}, m AS (SELECT model, seed, avg(nrmse) AS v FROM results GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY model ORDER BY seed) AS p FROM m)",
       "SELECT model, coalesce(bool_and(p >= v), TRUE) AS never_rises, coalesce(bool_and(p <= v), TRUE) AS never_falls FROM l GROUP BY 1"))
def trend_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cell_results(spark, sf_dir).groupBy("model", "seed").agg(F.avg("nrmse").alias("v"))
    return tallies.monotonic(means, ["model"], "seed", "v")


@query("A40")
def climate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-run climate per model: prediction time, spectrum, Wasserstein, diverged count."""
    runs = durable(closed_loop(spark, sf_dir))  # four measures read the same roll-outs
    keys = ["series_id", "model"]
    table_ = (metrics.valid_prediction_time(runs, keys)
              .join(spectral_mse(runs, keys), keys).join(wasserstein(runs, keys), keys)
              .join(runs.groupBy(*keys).agg(metrics.diverged().alias("diverged")), keys))
    table_ = durable(table_)
    means = table_.groupBy("model").agg(F.avg("spectral_mse").alias("spectral_mse"), F.avg("wasserstein").alias("wasserstein"),
                                        F.count_if("diverged").alias("n_diverged"))
    middle = exact_quantiles(table_, ["model"], "vpt_steps", {"vpt_median": 0.5})
    return means.join(middle, "model", "left").select("model", "vpt_median", "spectral_mse", "wasserstein", "n_diverged")


@query("A41 J10", q.select(f"{_R}, {_STEP}, v AS (SELECT series_id, seed, model, coalesce(min(CASE WHEN abs(y_pred-y_true)/sd > 2.0 THEN step END), max(m)) AS vpt, "
                       "max(abs(y_pred)) > 1.05 * max(abs(y_true)) AS big FROM step GROUP BY 1, 2, 3), a AS (SELECT series_id, model, median(nrmse) AS nrmse_med FROM results GROUP BY 1, 2), "
                       "b AS (SELECT series_id, model, median(vpt) AS vpt_med, avg(CASE WHEN big THEN 1 ELSE 0 END) AS div_frac FROM v GROUP BY 1, 2)",
       "SELECT series_id, model, round(nrmse_med, 6) AS nrmse_med, round(vpt_med, 6) AS vpt_med, round(div_frac, 6) AS div_frac FROM a JOIN b USING (series_id, model)"))
def robustness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregates per (system, model) joined: one-step scores and prediction times."""
    fc = cell_forecasts(spark, sf_dir)
    by = ["series_id", "model"]
    a = exact_quantiles(cell_results(spark, sf_dir), by, "nrmse", {"nrmse_med": 0.5})
    big = fc.groupBy(*_KEYS).agg((F.max(F.abs("y_pred")) > 1.05 * F.max(F.abs("y_true"))).alias("big"))
    v = metrics.valid_prediction_time(fc, _KEYS, 2.0).join(big, _KEYS)
    v = durable(v)
    b = v.groupBy(*by).agg(F.avg(F.col("big").cast("double")).alias("div_frac")).join(exact_quantiles(v, by, "vpt_steps", {"vpt_med": 0.5}), by)
    return a.join(b, by).select("series_id", "model", *[r(c).alias(c) for c in ("nrmse_med", "vpt_med", "div_frac")])


@query("A43", q.select(f"{_R}, p AS (SELECT series_id, seed, max(CASE WHEN model = 'moving_average' THEN nrmse END) AS a, max(CASE WHEN model = 'persistence' THEN nrmse END) AS b FROM results GROUP BY 1, 2)",
       "SELECT series_id, round(avg(a/b), 6) AS ratio_mean, round(stddev_pop(a/b), 6) AS ratio_std, round(min(a/b), 6) AS ratio_min, round(max(a/b), 6) AS ratio_max, round(avg(a)/avg(b), 6) AS ratio_of_means FROM p GROUP BY 1"))
def seed_ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("nrmse")))
    p = cell_results(spark, sf_dir).groupBy(*CELL).agg(pick("moving_average").alias("a"), pick("persistence").alias("b"))
    ratio = F.col("a") / F.col("b")
    return p.groupBy("series_id").agg(r(F.avg(ratio)).alias("ratio_mean"), r(F.stddev_pop(ratio)).alias("ratio_std"), r(F.min(ratio)).alias("ratio_min"),
                                      r(F.max(ratio)).alias("ratio_max"), r(F.avg("a") / F.avg("b")).alias("ratio_of_means"))


@query("A20", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(1)}, {q.parts(1)}", "SELECT series_id, round(1 - corr(d0, d0 * d0)^2, 6) AS residual_power_fraction FROM parts WHERE part IS NOT NULL GROUP BY 1"))
def residual_power_of_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One base column and one target: the residual share is 1 - correlation squared."""
    rows = win.train_and_test(win.delays(labelled_types(spark, sf_dir), 1, 1, 1), 1, 1, 1)
    got = residual_power(rows.select("series_id", "d0", (F.col("d0") * F.col("d0")).alias("sq")), ["d0"], ["sq"], ["series_id"])
    return got.select("series_id", r("residual_power_fraction").alias("residual_power_fraction"))
