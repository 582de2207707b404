"""Temporal split: bounds per series, segment labels and the rows a fit may see."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, attach

FRACTIONS = (0.6, 0.2, 0.2)


def split_bounds(panel: DataFrame, keys=KEYS, fracs=FRACTIONS, washout: int = 0) -> DataFrame:
    """keys, n, train_end, val_end, washout.  The second bound uses the summed fraction."""
    counted = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *keys, "n",
        F.floor(F.lit(float(fracs[0])) * F.col("n")).cast("long").alias("train_end"),
        F.floor(F.lit(float(fracs[0] + fracs[1])) * F.col("n")).cast("long").alias("val_end"),
        F.lit(washout).cast("long").alias("washout"))


def oversized_washout(bounds: DataFrame) -> DataFrame:
    """Series whose washout leaves no training row: an error before any job starts."""
    return bounds.where(F.col("washout") >= F.col("train_end"))


def label_split(panel: DataFrame, bounds: DataFrame, keys=KEYS, scope: str = "train") -> DataFrame:
    """Add segment and in_fit (train without washout, or every row for scope 'global')."""
    rows = attach(panel, bounds, keys)
    segment = (F.when(F.col("t") < F.col("train_end"), "train")
               .when(F.col("t") < F.col("val_end"), "validation").otherwise("test"))
    if scope == "global":
        in_fit = F.lit(True)
    else:
        in_fit = (F.col("t") >= F.col("washout")) & (F.col("t") < F.col("train_end"))
    return rows.withColumn("segment", segment).withColumn("in_fit", in_fit)


def split_order_violations(splits: DataFrame) -> DataFrame:
    """Splits whose segments overlap or run backwards."""
    ordered = ((F.col("train_start") < F.col("train_end"))
               & (F.col("train_end") <= F.col("validation_start"))
               & (F.col("validation_start") <= F.col("validation_end"))
               & (F.col("validation_end") <= F.col("test_start"))
               & (F.col("test_start") < F.col("test_end")))
    return splits.where(~ordered)


def admitted(panel: DataFrame, keys=KEYS, min_spread: float = 1e-6) -> DataFrame:
    """Keep series in which every value is finite and the spread is above the floor."""
    finite = ~(F.isnan("x") | F.col("x").isNull() | (F.abs("x") == float("inf")))
    good = (panel.groupBy(*keys)
            .agg(F.bool_and(finite).alias("finite"), F.stddev_pop("x").alias("spread"))
            .where(F.col("finite") & (F.col("spread") > min_spread)).select(*keys))
    return panel.join(good, list(keys), "left_semi")


def thin(panel: DataFrame, transient: int, stride: int) -> DataFrame:
    """Drop the warm-up rows, keep every stride-th sample and renumber the time."""
    kept = panel.where((F.col("t") >= transient) & ((F.col("t") - transient) % stride == 0))
    return kept.withColumn("t", ((F.col("t") - transient) / stride).cast("long"))
