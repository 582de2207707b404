"""Forecast scores as plain aggregates over (y_true, y_pred) rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import spread_join

INF = float("inf")


def error() -> Column:
    return F.col("y_pred") - F.col("y_true")


def mse() -> Column:
    return F.avg(error() * error())


def rmse() -> Column:
    return F.sqrt(mse())


def mae() -> Column:
    return F.avg(F.abs(error()))


def max_error() -> Column:
    return F.max(F.abs(error()))


def r2() -> Column:
    spread = F.var_pop("y_true")
    return F.when(spread == 0, F.lit(-INF)).otherwise(1 - mse() / F.nullif(spread, F.lit(0.0)))


def smape() -> Column:
    size = F.abs("y_true") + F.abs("y_pred")
    return 100 * F.avg(2 * F.abs(error()) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def mape(eps: float = 1e-3) -> Column:
    """Over |y| >= eps only; infinite when no row qualifies."""
    usable = F.abs("y_true") >= eps
    ratio = F.when(usable, F.abs(error()) / F.abs(F.when(usable, F.col("y_true"))))
    return F.coalesce(100 * F.avg(ratio), F.lit(INF))


def nrmse() -> Column:
    spread = F.stddev_pop("y_true")
    return F.when(spread == 0, F.lit(INF)).otherwise(rmse() / F.nullif(spread, F.lit(0.0)))


def all_metrics() -> list[Column]:
    """The seven scores in one pass."""
    return [nrmse().alias("nrmse"), rmse().alias("rmse"), mae().alias("mae"), mse().alias("mse"),
            r2().alias("r2"), smape().alias("smape"), max_error().alias("max_error")]


def score(forecasts: DataFrame, keys) -> DataFrame:
    return forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), *all_metrics())


def nonfinite(column: str = "y_pred") -> Column:
    """How many forecasts are not finite; the run is kept and flagged."""
    c = F.col(column)
    return F.count_if(F.isnan(c) | (F.abs(c) == INF))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == INF), F.lit(None).cast("double")).otherwise(c)


def skip_nan(c: Column) -> Column:
    """NaN to NULL, so that averages skip it."""
    return F.nullif(c, F.lit(float("nan")))


def _spread_per_key(rows: DataFrame, keys) -> DataFrame:
    spread = F.stddev_pop("y_true")
    return rows.groupBy(*keys).agg(F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("_sd"),
                                   F.min("t").alias("_t0"), F.count(F.lit(1)).alias("_m"))


def valid_prediction_time(forecasts: DataFrame, keys, threshold: float = 0.4) -> DataFrame:
    """First step (from 0) whose error / spread passes the threshold, else the length."""
    rows = spread_join(forecasts, _spread_per_key(forecasts, keys), keys)
    size = F.abs(error()) / F.col("_sd")
    over = ~F.isnan(size) & (size > threshold)  # Spark sorts NaN above every number
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(over, F.col("t") - F.col("_t0"))), F.max("_m")).alias("vpt_steps"))


def vector_scores(rows: DataFrame, keys, truth, pred) -> DataFrame:
    """Vector NRMSE: per component and as one aggregate, from component columns."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(a).alias("component"), F.col(a).alias("y_true"), F.col(b).alias("y_pred"))
        for a, b in zip(truth, pred)]))
    long = rows.select(*keys, parts.alias("p")).select(*keys, "p.*")
    each = long.groupBy(*keys, "component").agg(mse().alias("mse"), F.var_pop("y_true").alias("var"))
    one = F.when(F.col("var") == 0, F.lit(INF)).otherwise(
        F.sqrt(F.col("mse") / F.nullif(F.col("var"), F.lit(0.0))))
    return each.withColumn("nrmse", one)


def norms(truth, pred) -> tuple[Column, Column]:
    """(norm of the residual, norm of the truth) from component columns."""
    sq = lambda cs: F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))
    return sq([F.col(b) - F.col(a) for a, b in zip(truth, pred)]), sq([F.col(a) for a in truth])


def valid_prediction_time_vector(rows: DataFrame, keys, truth, pred, threshold: float = 0.4) -> DataFrame:
    """As the scalar form on the residual norm over the RMS norm of the centred truth."""
    spread = F.sqrt(sum([F.var_pop(c) for c in truth[1:]], F.var_pop(truth[0])))
    values = rows.groupBy(*keys).agg(F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("_sd"),
                                     F.min("t").alias("_t0"), F.count(F.lit(1)).alias("_m"))
    resid, _ = norms(truth, pred)
    size = resid / F.col("_sd")
    over = ~F.isnan(size) & (size > threshold)
    return spread_join(rows, values, keys).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(over, F.col("t") - F.col("_t0"))), F.max("_m")).alias("vpt_steps"))


def diverged() -> Column:
    """max|prediction| > 10 (max|truth| + 1e-9)."""
    return F.max(F.abs("y_pred")) > 10 * (F.max(F.abs("y_true")) + F.lit(1e-9))
