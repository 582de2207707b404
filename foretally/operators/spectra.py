"""Distribution and spectrum distances."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, sorted_blocks, spread_join
from foretally.operators.fourier import power_spectrum
from foretally.session import durable


def wasserstein(rows: DataFrame, keys, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Wasserstein-1 between the two columns' samples; non-finite predictions dropped.

    Values are counted first, then the gap between the two running shares is summed over
    the steps between neighbouring values; slices hand their last totals to the next.
    """
    keys = list(keys)
    inf = float("inf")
    side = F.explode(F.array(
        F.struct(F.col(truth).alias("v"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        F.struct(F.when(~F.isnan(pred) & (F.abs(pred) < inf), F.col(pred)).alias("v"),
                 F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))))
    values = (rows.select(*keys, side.alias("s")).select(*keys, "s.*").where("v IS NOT NULL")
              .groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    values = durable(values)  # counted, cut, totalled and summed from the same rows
    cut = sorted_blocks(values, keys, ["v"])
    totals = values.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    runs = cut.groupBy(*keys, "run").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min("v").alias("v0"))
    before = Window.partitionBy(*keys).orderBy("run")
    back = before.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "run", F.coalesce(F.sum("ra").over(back), F.lit(0)).alias("oa"),
                       F.coalesce(F.sum("rb").over(back), F.lit(0)).alias("ob"), F.lead("v0").over(before).alias("v_next"))
    rows_in = cut.join(runs.join(totals, keys), [*keys, "run"])
    inside = Window.partitionBy(*keys, "run").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce(F.lead("v").over(inside), F.col("v_next")) - F.col("v")
    share = F.abs((F.sum("a").over(upto) + F.col("oa")) / F.col("na")
                  - (F.sum("b").over(upto) + F.col("ob")) / F.nullif(F.col("nb"), F.lit(0)))
    steps = rows_in.select(*keys, "nb", (share * gap).alias("w"))
    return steps.groupBy(*keys).agg(
        F.when(F.max("nb") == 0, F.lit(inf)).otherwise(F.coalesce(F.sum("w"), F.lit(0.0))).alias("wasserstein"))


def spectral_mse(rollouts: DataFrame, keys) -> DataFrame:
    """Mean squared gap of the log power spectra of truth and prediction."""
    log = lambda i: F.log10(F.get("power", F.lit(i)) + 1e-12)
    bins = power_spectrum(rollouts, ["y_true", "y_pred"], keys)
    return bins.groupBy(*keys).agg(F.avg(F.pow(log(0) - log(1), 2)).alias("spectral_mse"))


def new_frequency_fraction(rows: DataFrame, base, targets, keys=KEYS, threshold: float = 0.01) -> DataFrame:
    """Mean over the targets of the share of their spectral power that lies outside the base
    columns' support: the frequencies where the base's summed power exceeds ``threshold`` of its
    largest.  Spectra are those of the whole series."""
    keys, base, targets = list(keys), list(base), list(targets)
    power = lambda i: F.get("power", F.lit(i))
    support = sum((power(i) for i in range(1, len(base))), power(0)).alias("support")
    bins = durable(power_spectrum(rows, [*base, *targets], keys).select(
        *keys, "bin", support, *[power(len(base) + i).alias(f"p{i}") for i in range(len(targets))]))
    marked = spread_join(bins, bins.groupBy(*keys).agg(F.max("support").alias("top")), keys, "bin")
    outside = F.col("support") <= threshold * F.col("top")
    share = [F.coalesce(F.sum(F.when(outside, F.col(f"p{i}"))) / F.nullif(F.sum(f"p{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(len(targets))]
    return marked.groupBy(*keys).agg((sum(share[1:], share[0]) / len(share)).alias("new_frequency_fraction"))
