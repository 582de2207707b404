"""Forecast-comparison tests as grouped DataFrame jobs."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.functions.pvalues import student_t_p
from foretally.operators.blocks import BLOCK_ROWS, block_of, in_block, number_rows, with_halo


def loss(kind: str = "se") -> Column:
    e = F.col("y_pred") - F.col("y_true")
    if kind == "se":
        return e * e
    if kind == "ae":
        return F.abs(e)
    raise ValueError(f"unknown loss {kind!r}; use 'se' or 'ae'")


def align_suffix(forecasts: DataFrame, keys, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep the last L rows of every model, L = the shortest forecast of the cell.

    Adds ``step`` (0 = last row).  Forecast rows are numbered backwards inside blocks.
    """
    keys = list(keys)
    numbered = number_rows(forecasts, [*keys, "model"], [F.col("t").desc()], out="step",
                           block_rows=block_rows, stretch=-block_of(F.col("t"), block_rows)).drop("block")
    lengths = (forecasts.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("m"))
               .groupBy(*keys).agg(F.min("m").alias("common")))
    spread = lengths.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.col("common"), block_rows))))
    rows = numbered.withColumn("_b", block_of(F.col("step"), block_rows))
    return rows.join(spread, [*keys, "_b"]).where(F.col("step") < F.col("common")).drop("_b", "common")


def target_agreement(aligned: DataFrame, keys) -> DataFrame:
    """Largest disagreement of the targets per cell, and whether it is within 1e-8."""
    per_step = aligned.groupBy(*keys, "step").agg(
        (F.max("y_true") - F.min("y_true")).alias("gap"), F.max(F.abs("y_true")).alias("size"))
    within = F.col("gap") <= F.lit(1e-8) + F.lit(1e-5) * F.col("size")
    return per_step.groupBy(*keys).agg(F.max("gap").alias("max_gap"), F.bool_and(within).alias("targets_agree"))


def losses_wide(forecasts: DataFrame, models, keys, kind: str = "se", time: str = "t") -> DataFrame:
    """One row per (cell, time) with a loss column per model: no model pairs are emitted."""
    value = forecasts.select(*keys, time, "model", loss(kind).alias("l"))
    return value.groupBy(*keys, time).agg(*[
        F.max(F.when(F.col("model") == m, F.col("l"))).alias(f"l_{i}") for i, m in enumerate(models)])


def newey_west(d: Column, lagged: list[Column], n: Column) -> Column:
    """Variance of the mean of ``d`` with Bartlett weights, as one aggregate expression.

    ``lagged[k-1]`` is d shifted by k (NULL where it does not exist).  The centred lag
    products come from the numerically stable covariance plus the shift of the two means.
    """
    mean = F.avg(d)
    total = F.var_pop(d)
    for k, dk in enumerate(lagged, start=1):
        weight = 1.0 - k / (len(lagged) + 1)
        both = F.when(dk.isNotNull(), d)
        pairs = F.count(dk)
        shift = (F.avg(both) - mean) * (F.avg(dk) - mean)
        term = 2.0 * weight * pairs * (F.covar_pop(both, dk) + shift) / n
        total = total + F.coalesce(term, F.lit(0.0))  # a series shorter than the lag has no pair
    return total / n


def pairwise_dm(wide: DataFrame, models, keys, h: int = 1, time: str = "t", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Diebold-Mariano for every ordered model pair of every cell.

    Aggregates one differential per unordered pair in a single pass and mirrors the sign
    on the few result rows.  Positive means model_i has the larger loss.
    """
    keys = list(keys)
    lag = max(0, h - 1)
    pairs = list(combinations(range(len(models)), 2))
    rows = wide.select(*keys, F.col(time).alias("t"), *[f"l_{i}" for i in range(len(models))],
                       *[(F.col(f"l_{i}") - F.col(f"l_{j}")).alias(f"d_{i}_{j}") for i, j in pairs])
    if lag:
        rows = with_halo(rows.withColumn("block", block_of(F.col("t"), block_rows)), lag, 0, block_rows)
        w = in_block(keys)
        rows = rows.select("*", *[F.lag(f"d_{i}_{j}", k).over(w).alias(f"d_{i}_{j}_{k}")
                                  for i, j in pairs for k in range(1, lag + 1)]).where("home")
    n = F.count(F.lit(1))
    aggs = [n.alias("n")]
    for i, j in pairs:
        d = F.col(f"d_{i}_{j}")
        lagged = [F.col(f"d_{i}_{j}_{k}") for k in range(1, lag + 1)]
        aggs.append(F.struct(
            F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.avg(d).alias("mean"),
            F.max(F.abs(d)).alias("peak"), newey_west(d, lagged, n).alias("var"),
            F.greatest(F.avg(F.abs(F.col(f"l_{i}"))), F.avg(F.abs(F.col(f"l_{j}")))).alias("scale")).alias(f"p_{i}_{j}"))
    summed = rows.groupBy(*keys).agg(*aggs)
    each = summed.select(*keys, "n", F.explode(F.array(*[F.col(f"p_{i}_{j}") for i, j in pairs])).alias("p"))
    m, nn = F.col("p.mean"), F.col("n")
    hln = F.sqrt((nn + 1 - 2 * lag + lag * (lag - 1) / nn) / nn)
    nan = F.lit(float("nan"))
    same = (F.col("p.scale") == 0) | (F.col("p.peak") <= 1e-12 * F.col("p.scale"))
    positive = F.when(F.col("p.var") > 0, F.col("p.var"))
    stat = (F.when(nn < 2, nan).when(same, F.lit(0.0))
            .when(positive.isNull(), nan).otherwise(m / F.sqrt(positive) * hln))
    one = each.select(*keys, "n", "p.a", "p.b", stat.alias("dm_stat"), same.alias("same"))
    both = F.array(F.struct(F.col("a").alias("model_i"), F.col("b").alias("model_j"), F.col("dm_stat").alias("dm_stat")),
                   F.struct(F.col("b").alias("model_i"), F.col("a").alias("model_j"),
                            F.when(F.col("same"), F.lit(0.0)).otherwise(-F.col("dm_stat")).alias("dm_stat")))
    return one.select(*keys, "n", "same", F.explode(both).alias("q")).select(*keys, "n", "same", "q.*")


def with_p(dm: DataFrame) -> DataFrame:
    p = F.when(F.col("same") & (F.col("n") >= 2), F.lit(1.0)).otherwise(student_t_p(F.col("dm_stat"), F.col("n") - 1))
    return dm.withColumn("dm_pval", p)


def over_seeds(dm: DataFrame, keys) -> DataFrame:
    """Mean statistic, median p (NaN skipped) and share significant (NaN is not)."""
    stat = F.nullif(F.col("dm_stat"), F.lit(float("nan")))
    p = F.nullif(F.col("dm_pval"), F.lit(float("nan")))
    hit = F.when((F.col("dm_pval") < 0.05) & ~F.isnan("dm_pval"), 1.0).otherwise(0.0)
    return dm.groupBy(*keys, "model_i", "model_j").agg(
        F.avg(stat).alias("mean_dm"), F.median(p).alias("median_p"), F.avg(hit).alias("frac_seeds_sig"))


def verdict(p: Column) -> Column:
    return F.when(p < 0.05, "significant").when(p > 0.10, "NOT significant").otherwise("borderline")


def holm(tests: DataFrame, family, p: str = "p", order=(), cap: bool = True, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p per family: running max of (m - rank + 1) p, optionally <= 1.

    A family is a set of tests (one per condition and seed), small next to the rows behind
    the tests; ``order`` breaks ties so the result does not depend on row placement.
    """
    size = Window.partitionBy(*family)
    ranked = Window.partitionBy(*family).orderBy(F.col(p), *order)
    adj = (F.count(F.lit(1)).over(size) - F.row_number().over(ranked) + 1) * F.col(p)
    running = F.max("_adj").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = F.least(F.lit(1.0), running) if cap else running
    return tests.withColumn("_adj", adj).withColumn(out, value).drop("_adj")
