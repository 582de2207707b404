"""k-nearest-neighbour regression on windows, exact, without making all pairs.

Train windows are sorted by their first coordinate and cut into slices of bounded size.
A test window searches its own slice first; the k-th distance found there bounds how far
along the first coordinate a closer window can lie, so a second pass visits only the
slices in that range.  Distances stay inside the task; only k candidates leave it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, cogroup_blocks, running_sums
from foretally.session import durable

SLICE_ROWS = 2048


def _search(k: int, dims: list, keys: list):
    def run(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        out_cols = [*keys, "t", "dist", "nt", "ny"]
        if test.empty or train.empty:
            return pd.DataFrame({c: [] for c in out_cols})
        a, b = test[dims].to_numpy(float), train[dims].to_numpy(float)
        ts, ys = train["t"].to_numpy(), train["y"].to_numpy(float)
        take = min(k, len(train))
        frames = []
        for i in range(0, len(a), 512):
            d2 = np.zeros((len(a[i:i + 512]), len(b)))
            for c in range(len(dims)):
                d2 += (a[i:i + 512, c][:, None] - b[:, c][None, :]) ** 2
            far = np.partition(d2, take - 1, axis=1)[:, take - 1]
            who, near = np.nonzero(d2 <= far[:, None])  # k per row, more only on a tie
            part = test.iloc[i:i + 512][[*keys, "t"]].iloc[who]
            part = part.assign(dist=d2[who, near], nt=ts[near], ny=ys[near], who=who)
            part = part.sort_values(["who", "dist", "nt"])
            frames.append(part[part.groupby("who").cumcount() < take])
        return pd.concat(frames)[out_cols]

    return run


def _best(found: DataFrame, keys: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys, "t").orderBy("dist", "nt")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(train: DataFrame, test: DataFrame, dims, k: int = 5, keys=KEYS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """keys, t, dist, nt, ny, rank: the k nearest train windows of every test window."""
    keys, dims = list(keys), list(dims)
    types = {f.name: f.dataType.simpleString() for f in train.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", t long, dist double, nt long, ny double"
    search = _search(k, dims, keys)

    # equal windows answer alike except for their t, so only the first k of each are needed;
    # two rounds, as one window may hold a third of all rows
    train = train.select(*keys, "t", "y", *dims).withColumn("_cut", F.floor(F.col("t") / F.lit(slice_rows)))
    for group in ([*keys, *dims, "_cut"], [*keys, *dims]):
        train = train.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("t"))).where(F.col("_r") <= k).drop("_r")
    train = train.drop("_cut")
    train, wanted = durable(train), durable(test.select(*keys, "t", *dims))  # both are read several times
    spots = running_sums(train, keys, [dims[0], "t"], {"pos": F.lit(1).cast("long")})
    spots = durable(spots.withColumn("slice", F.floor((F.col("pos") - 1) / F.lit(slice_rows)).cast("long")))

    def place(points: DataFrame, at: str) -> DataFrame:
        """The slice that a coordinate falls in: count train rows before it in one sort."""
        cols = [*keys, "kind", F.col("_c"), "t", "edge"]
        marks = spots.select(*keys, F.lit(0).alias("kind"), F.col(dims[0]).alias("_c"), "t", F.lit(0).alias("edge"))
        asked = points.select(*keys, F.lit(1).alias("kind"), F.col(at).alias("_c"), "t", "edge")
        both = marks.select(*cols).unionByName(asked.select(*cols))
        counted = running_sums(both, keys, ["_c", "kind", "t", "edge"],
                               {"before": F.when(F.col("kind") == 0, 1).otherwise(0).cast("long")})
        last = F.greatest(F.col("before") - 1, F.lit(0).cast("long"))
        return counted.where("kind = 1").select(
            *keys, "t", "edge", F.floor(last / F.lit(slice_rows)).cast("long").alias("slice"))

    own = place(wanted.withColumn("edge", F.lit(0)), dims[0]).drop("edge")

    def visit(visits: DataFrame) -> DataFrame:
        """Search (slice, part) groups: tests of a crowded slice are split into parts."""
        part = F.pmod(F.xxhash64("t"), F.col("parts"))
        load = visits.groupBy(*keys, "slice").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("long").alias("parts"))
        copies = load.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = spots.join(copies, [*keys, "slice"])
        left = visits.join(load, [*keys, "slice"]).withColumn("part", part)
        return cogroup_blocks(left, right.select(*keys, "slice", "part", "t", "y", *dims), [*keys, "slice", "part"], search, schema)

    first = _best(visit(wanted.join(own, [*keys, "t"])), keys, k)
    reach = first.groupBy(*keys, "t").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("got"))
    # fewer than k found means the bound is unknown: reach over everything
    radius = F.when(F.col("got") < k, F.lit(float("inf"))).otherwise(F.sqrt("far") + F.lit(1e-6))
    probes = wanted.join(reach.select(*keys, "t", radius.alias("radius")), [*keys, "t"], "left")
    probes = probes.withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("edge"), (F.col(dims[0]) - F.col("radius")).alias("at")),
                             F.struct(F.lit(1).alias("edge"), (F.col(dims[0]) + F.col("radius")).alias("at"))))
    spans = place(probes.select(*keys, "t", ends.alias("e")).select(*keys, "t", "e.edge", "e.at"), "at")
    spans = spans.groupBy(*keys, "t").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi"))
    visits = wanted.join(spans, [*keys, "t"]).withColumn("slice", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    return _best(visit(visits), keys, k)


def knn_forecast(train: DataFrame, test: DataFrame, dims, k: int = 5, keys=KEYS) -> DataFrame:
    """Mean target of the k nearest train windows."""
    near = nearest(train, test, dims, k, keys)
    pred = near.groupBy(*keys, "t").agg(F.avg("ny").alias("y_pred"))
    return test.select(*keys, "t", F.col("y").alias("y_true")).join(pred, [*keys, "t"])
