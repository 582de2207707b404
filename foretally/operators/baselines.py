"""Forecasts that need no fit beyond a few per-series values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, attach
from foretally.operators.split import FRACTIONS, split_bounds
from foretally.operators.windows import delays

BASELINES = ("persistence", "train_mean", "moving_average", "drift")


def baseline_parameters(panel: DataFrame, keys=KEYS, fracs=FRACTIONS, washout: int = 0) -> DataFrame:
    """keys, n, train_end, val_end, washout, mu (train mean after washout), slope."""
    bounds = split_bounds(panel, keys, fracs, washout)
    rows = attach(panel, bounds, keys)
    t, end = F.col("t"), F.col("train_end")
    got = rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "train_end", "val_end", "washout")],
        F.avg(F.when((t >= F.col("washout")) & (t < end), F.col("x"))).alias("mu"),
        F.max(F.when(t == 0, F.col("x"))).alias("first_x"),
        F.max(F.when(t == end - 1, F.col("x"))).alias("last_x"))
    slope = (F.col("last_x") - F.col("first_x")) / F.nullif(end - 1, F.lit(0))
    return got.withColumn("slope", slope).drop("first_x", "last_x")


def baseline_forecasts(panel: DataFrame, keys=KEYS, fracs=FRACTIONS, washout: int = 0, horizon: int = 1,
                       segment: str = "test") -> DataFrame:
    """Long forecasts (keys, model, t, y_true, y_pred) of the four baselines."""
    params = baseline_parameters(panel, keys, fracs, washout)
    rows = attach(delays(panel, 3, 1, horizon, keys), params, keys).where("y IS NOT NULL")
    if segment == "test":
        rows = rows.where(F.col("t") >= F.col("val_end"))
    else:
        rows = rows.where((F.col("t") >= F.col("train_end")) & (F.col("t") < F.col("val_end") - horizon))
    preds = {
        "persistence": F.col("d0"),
        "train_mean": F.col("mu"),
        "moving_average": (F.col("d0") + F.col("d1") + F.col("d2")) / 3,
        "drift": F.col("d0") + horizon * F.col("slope"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("y_pred")) for m, p in preds.items()]))
    return rows.select(*keys, F.col("t"), F.col("y").alias("y_true"), each.alias("p")).select(
        *keys, "p.model", "t", "y_true", "p.y_pred")


def persistence(panel: DataFrame, keys=KEYS, fracs=FRACTIONS, horizon: int = 1) -> DataFrame:
    """Test forecasts ``y_pred = x_t`` of ``y_true = x_{t+horizon}``."""
    rows = attach(delays(panel, 1, 1, horizon, keys), split_bounds(panel, keys, fracs), keys)
    return rows.where((F.col("t") >= F.col("val_end")) & F.col("y").isNotNull()).select(
        *keys, "t", F.col("y").alias("y_true"), F.col("d0").alias("y_pred"))
