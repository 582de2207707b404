"""Exact interpolated quantiles that never gather a group in one buffer."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.operators.blocks import running_sums
from foretally.session import durable


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """keys plus one column per entry of ``probs`` (name -> probability), linear rule.

    Equal values are counted first (partial counts before the shuffle); running counts
    over the distinct values then tell which value holds a wanted rank.
    """
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    distinct = durable(distinct)
    ranked = running_sums(distinct, keys, ["_v"], {"_upto": F.col("_c")}, run="_run")
    # a key's total is repeated for each of its slices, so a hot key's values stay spread out
    whole = Window.partitionBy(*keys)
    totals = ranked.groupBy(*keys, "_run").agg(F.sum("_c").alias("_part")).select(*keys, "_run", F.sum("_part").over(whole).alias("_n"))
    ranked = ranked.join(totals, [*keys, "_run"])
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{tag}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)
