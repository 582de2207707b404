"""Leaderboards, win tallies and study summaries over score rows.

Score rows are one per (series, model, seed): they grow with the number of runs, not with
the length of the series.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.operators.quantiles import exact_quantiles


def leaderboard(results: DataFrame, score: str = "nrmse") -> DataFrame:
    """Mean and spread per model, ranked.  One row per catalogue entry is ranked."""
    table = results.groupBy("model").agg(
        F.avg(score).alias(f"{score}_mean"), F.stddev_pop(score).alias(f"{score}_std"), F.count(F.lit(1)).alias("n_runs"))
    w = Window.orderBy(f"{score}_mean", "model")
    return table.withColumn("rank", F.row_number().over(w))


def strict_wins(results: DataFrame, cell, champion: str, score: str = "nrmse") -> DataFrame:
    """Cells in which the champion is strictly below every other model's median score."""
    med = results.groupBy(*cell, "model").agg(F.median(score).alias("m"))
    mine = F.min(F.when(F.col("model") == champion, F.col("m")))
    rest = F.min(F.when(F.col("model") != champion, F.col("m")))
    each = med.groupBy(*cell).agg(mine.alias("mine"), rest.alias("rest")).where("mine IS NOT NULL")
    return each.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("mine") < F.col("rest")).alias("wins"))


def first_minimum_wins(results: DataFrame, cell, score: str = "nrmse") -> DataFrame:
    """Wins per model, a tie going to the first model by name."""
    best = results.groupBy(*cell).agg(F.min(F.struct(score, "model")).alias("b"))
    return best.groupBy(F.col("b.model").alias("model")).agg(F.count(F.lit(1)).alias("wins"))


def median_iqr(df: DataFrame, keys, value: str) -> DataFrame:
    """Median and quartiles of any number of rows per key (counted, blocked ranks)."""
    keys = list(keys)
    got = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return got.join(sizes, keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def per_level(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Mean, sample std, min, max per level; ``position`` keeps the level order."""
    got = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                             F.max(value).alias("max"), F.min(order).alias("_first"))
    return got.withColumn("position", F.row_number().over(Window.orderBy("_first", by))).drop("_first")


def best_and_worst(df: DataFrame, keys, by: str, value: str) -> DataFrame:
    """Best and worst level by mean, and the spread between them (lower is better)."""
    means = df.groupBy(*keys, by).agg(F.avg(value).alias("m"))
    got = means.groupBy(*keys).agg(F.min(F.struct("m", by)).alias("b"), F.max(F.struct("m", by)).alias("w"),
                                   F.count(F.lit(1)).alias("levels"))
    spread = F.col("w.m") / F.when(F.col("b.m") > 0, F.col("b.m"))
    return got.select(*keys, F.col(f"b.{by}").alias("best"), F.col("b.m").alias("best_value"),
                      F.col(f"w.{by}").alias("worst"), F.col("w.m").alias("worst_value"),
                      F.coalesce(spread, F.lit(float("inf"))).alias("spread"), "levels")


def ratio_swing(df: DataFrame, keys, axis: str, level: str, value: str) -> DataFrame:
    """Largest over smallest level mean per axis, the smallest floored at 1e-12."""
    means = df.groupBy(*keys, axis, level).agg(F.avg(value).alias("m"))
    return means.groupBy(*keys, axis).agg((F.max("m") / F.greatest(F.min("m"), F.lit(1e-12))).alias("ratio_swing"))


def average_rank(keys, value: Column) -> Column:
    """Rank inside ``keys`` with ties averaged, largest first; NULL stays NULL."""
    w = Window.partitionBy(*keys).orderBy(value.desc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def rank_correlation(swings: DataFrame, model: str = "model", axis: str = "axis", value: str = "ratio_swing") -> DataFrame:
    """Spearman correlation of the axis rankings of every model pair.

    The input has one row per (model, axis) of the catalogue.  A pair is ranked again over
    the axes both models have.
    """
    a = swings.where(F.col(value).isNotNull()).select(F.col(model).alias("model_a"), F.col(axis).alias("axis"), F.col(value).alias("va"))
    b = swings.where(F.col(value).isNotNull()).select(F.col(model).alias("model_b"), F.col(axis).alias("axis"), F.col(value).alias("vb"))
    both = a.join(b, "axis")
    ranked = both.select("model_a", "model_b", average_rank(["model_a", "model_b"], F.col("va")).alias("ra"),
                         average_rank(["model_a", "model_b"], F.col("vb")).alias("rb"))
    # corr is undefined for a single shared axis or a constant ranking
    spread = (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.groupBy("model_a", "model_b").agg(
        F.when(spread, F.corr("ra", "rb")).alias("spearman"), F.count(F.lit(1)).alias("axes"))


def condition_verdicts(tests: DataFrame, condition) -> DataFrame:
    """Seeds collapsed to one verdict per condition: majority, and whether all agree."""
    up, down = F.count_if(F.col("dm_stat") > 0), F.count_if(F.col("dm_stat") < 0)
    got = tests.groupBy(*condition).agg(F.count(F.lit(1)).alias("seeds"), up.alias("first_worse"), down.alias("first_better"))
    a, b = F.col("first_worse"), F.col("first_better")
    return (got.withColumn("winner", F.when(a > b, "second").when(b > a, "first").otherwise("tied"))
            .withColumn("unanimous", (a == F.col("seeds")) | (b == F.col("seeds"))))


def family_report(p: str) -> list[Column]:
    """Wins, share, significant count and largest adjusted p of a family of tests."""
    n, worse, better = F.count(F.lit(1)), F.count_if(F.col("dm_stat") > 0), F.count_if(F.col("dm_stat") < 0)
    return [n.alias("n_tests"), worse.alias("first_worse"), better.alias("first_better"), (worse / n).alias("share_worse"),
            F.count_if(F.col(p) < 0.05).alias("significant"), F.max(p).alias("max_adjusted")]


def monotonic(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Whether the value never rises (and never falls) along ``order`` (a few levels)."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.withColumn("_prev", prev)
    return steps.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col("_prev") >= F.col(value)), F.lit(True)).alias("never_rises"),
        F.coalesce(F.bool_and(F.col("_prev") <= F.col(value)), F.lit(True)).alias("never_falls"))
