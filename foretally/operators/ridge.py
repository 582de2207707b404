"""Ridge regression over a panel: Gram sums, a tiny solve per group, dot-product predict.

The penalty covers the bias column too.  Rows are never gathered: Gram entries are
partial sums, combined before the shuffle, so one hot series is still many small sums.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from foretally.operators.blocks import KEYS, attach, per_block
from foretally.operators.matrices import matrix_of


def gram(rows: DataFrame, features, targets, keys=KEYS) -> DataFrame:
    """keys, n, g (upper triangle by rows), b (one run of F sums per target)."""
    fs, ys = list(features), list(targets)
    upper = [F.sum(fs[i] * fs[j]) for i in range(len(fs)) for j in range(i, len(fs))]
    right = [F.sum(f * y) for y in ys for f in fs]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*upper).alias("g"), F.array(*right).alias("b"))


def solver(width: int, alpha: float, targets: int = 1):
    """Column function (g, b) -> weights, solved batch-wise in Arrow."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        at, out = np.triu_indices(width), []
        for flat, right in zip(g, b):  # one full matrix at a time: a batch may hold thousands
            m, r = np.zeros((width, width)), np.asarray(right, float).reshape(targets, width)
            m[at] = flat
            m.T[at] = flat
            m += alpha * np.eye(width)
            try:
                w = np.linalg.solve(m, r.T).T
            except np.linalg.LinAlgError:
                w = (np.linalg.pinv(m) @ r.T).T
            out.append(w.reshape(-1))
        return pd.Series(out)

    return solve


def ridge_fit(rows: DataFrame, features, target: Column, alpha: float = 1e-6, keys=KEYS, bias: bool = True) -> DataFrame:
    """keys, n, w: one weight per feature (bias last) from the rows given (train rows)."""
    fs = list(features) + ([F.lit(1.0)] if bias else [])
    sums = gram(rows, fs, [target], keys)
    return sums.select(*keys, "n", solver(len(fs), alpha)("g", "b").alias("w"))


def ridge_fit_many(rows: DataFrame, features, targets, alpha: float = 1e-6, keys=KEYS, bias: bool = True) -> DataFrame:
    """Several targets on one Gram matrix; ``w`` holds the weights target after target."""
    fs, ys = list(features) + ([F.lit(1.0)] if bias else []), list(targets)
    sums = gram(rows, fs, ys, keys)
    return sums.select(*keys, "n", solver(len(fs), alpha, len(ys))("g", "b").alias("w"))


def dot(features, weights: Column, start: int = 0) -> Column:
    return reduce(lambda a, b: a + b, [weights[start + i] * f for i, f in enumerate(features)])


def ridge_predict(rows: DataFrame, weights: DataFrame, features, keys=KEYS, bias: bool = True, out: str = "y_pred") -> DataFrame:
    fs = list(features) + ([F.lit(1.0)] if bias else [])
    joined = attach(rows.drop("n") if "n" in rows.columns else rows, weights, keys)
    return joined.withColumn(out, dot(fs, F.col("w"))).drop("w")


# ---- wide feature maps: expanded inside the task, never shuffled -----------------------

MERGE_WAYS = 64
same = lambda x: x


def gram_in_tasks(rows: DataFrame, inputs, expand, width: int, keys=KEYS) -> DataFrame:
    """keys, n, g, b of ``expand(inputs) + bias`` for maps too wide for column sums.

    ``expand`` maps a float matrix of the input columns to a feature matrix.  Each task
    adds up its own Gram matrices batch by batch and hands on one array per key.
    """
    keys, inputs = list(keys), list(inputs)
    full = width + 1
    iu = np.triu_indices(full)
    cut = len(iu[0])
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.hstack([expand(matrix_of(pdf, inputs)), np.ones((len(pdf), 1))])
            y, ns = pdf["y"].to_numpy(float), pdf["n"].to_numpy()
            codes, uniques = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True])
            for a, b in zip(edges[:-1], edges[1:]):
                pick = order[a:b]
                xs = x[pick]
                entry = held.setdefault(tuple(uniques[codes[pick[0]]]), [np.zeros((full, full)), np.zeros(full), 0])
                entry[0] += xs.T @ xs
                entry[1] += xs.T @ y[pick]
                entry[2] = max(entry[2], int(ns[pick[0]]))
            if len(held) >= 256:  # bounded memory: hand the sums on and start again
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held):
        out = pd.DataFrame(list(held), columns=keys)
        out["n"] = [v[2] for v in held.values()]
        out["sums"] = [np.concatenate([v[0][iu], v[1]]) for v in held.values()]
        return out

    parts = rows.select(*keys, "n", "y", *inputs).mapInPandas(partial, f"{key_fields}, n long, sums array<double>")
    return add_up(parts, keys).select(*keys, "n", F.slice("sums", 1, cut).alias("g"), F.slice("sums", cut + 1, full).alias("b"))


def add_up(parts: DataFrame, keys) -> DataFrame:
    """Element-wise sum of the tasks' partial sums per key, in two rounds: a key seen by
    every task is first added up in MERGE_WAYS groups."""
    way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("way")
    once = stream_sums(parts.select(*keys, "n", "sums", way), [*keys, "way"])
    return stream_sums(once.drop("way"), keys)


def stream_sums(parts: DataFrame, keys) -> DataFrame:
    """(keys, n, sums) added up over sorted partitions with one running sum held per task."""
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, total = None, 0, None

        def done():
            return pd.DataFrame([(*last, n, total)], columns=[*keys, "n", "sums"])

        for pdf in batches:
            for key, n_rows, sums in zip(pdf[keys].itertuples(index=False, name=None), pdf["n"], pdf["sums"]):
                if key != last:
                    if last is not None:
                        yield done()
                    last, n, total = key, 0, np.zeros(len(sums))
                n, total = max(n, int(n_rows)), total + np.asarray(sums, float)
        if last is not None:
            yield done()

    placed = parts.select(*keys, "n", "sums").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(run, f"{fields}, n long, sums array<double>")


def wide_fit(rows: DataFrame, inputs, expand, width: int, alpha: float = 1e-6, keys=KEYS) -> DataFrame:
    """Ridge weights (bias last) of ``expand(inputs)`` from the rows with part = 'train'."""
    sums = gram_in_tasks(rows.where("part = 'train'"), inputs, expand, width, keys)
    return sums.select(*keys, "n", solver(width + 1, alpha)("g", "b").alias("w"))


def behind_weights(rows: DataFrame, weights: DataFrame, keys, fn, schema: str) -> DataFrame:
    """Apply ``fn(rows of a block, weights of its series)`` in a stream.

    A block's weights travel as one row in front of the block's rows, so they are neither
    broadcast nor copied onto every row.  ``fn`` may see a block in several pieces.  The other rows
    carry an empty list: a null one takes far longer to send to Python (27 microseconds a row).
    """
    keys = list(keys)
    heads = per_block(weights).select(*keys, "block", "w", F.lit(0).alias("place"))
    none = F.array().cast(weights.schema["w"].dataType)
    both = rows.withColumn("w", none).withColumn("place", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    placed = both.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = None  # rows before the first mark of a batch belong to the weights before
        for pdf in batches:
            marks = np.flatnonzero((pdf["place"] == 0).to_numpy())
            edges = [-1, *marks, len(pdf)]
            out = []
            for i in range(len(edges) - 1):
                if i:
                    w = np.asarray(pdf["w"].iloc[edges[i]], float)
                body = pdf.iloc[edges[i] + 1:edges[i + 1]]
                if len(body) and w is not None:
                    out.append(fn(body, w))
            if out:
                yield pd.concat(out)

    return placed.mapInPandas(run, schema)


def wide_predict(rows: DataFrame, weights: DataFrame, inputs, expand, keys=KEYS) -> DataFrame:
    """Test forecasts of ``wide_fit``."""
    keys, inputs = list(keys), list(inputs)
    test = rows.where("part = 'test'").select(*keys, "block", "t", "y", *inputs)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def score(body: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
        return body[[*keys, "t"]].assign(y_true=body["y"], y_pred=expand(matrix_of(body, inputs)) @ w[:-1] + w[-1])

    return behind_weights(test, weights, keys, score, f"{key_fields}, t long, y_true double, y_pred double")
