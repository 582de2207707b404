"""Matrix diagnostics of feature rows by a distributed QR (tall-skinny QR).

Each task reduces its rows to one small triangular factor per group; factors are merged
in two rounds.  Singular values keep full precision (a Gram matrix would square them).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

MERGE_WAYS = 64


def matrix_of(pdf: pd.DataFrame, inputs) -> np.ndarray:
    """Float matrix from scalar columns or from one array column."""
    if len(inputs) == 1 and pdf[inputs[0]].dtype == object:
        return np.vstack([np.asarray(v, float) for v in pdf[inputs[0]]])
    return pdf[list(inputs)].to_numpy(float)


def triangular(rows: DataFrame, inputs, keys, bias: bool = False) -> DataFrame:
    """keys, m (rows), r: the R factor, row by row, of the group's feature matrix."""
    keys, inputs = list(keys), list(inputs)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def reduce_rows(batches):
        held = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                x = matrix_of(part, inputs)
                if bias:
                    x = np.hstack([np.ones((len(x), 1)), x])
                slot = held.setdefault(key, [np.zeros((0, x.shape[1])), 0])
                slot[0] = np.linalg.qr(np.vstack([slot[0], x]), mode="r")
                slot[1] += len(x)
            if len(held) >= 256:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held):
        out = pd.DataFrame(list(held), columns=keys)
        out["m"] = [v[1] for v in held.values()]
        out["r"] = [v[0].reshape(-1) for v in held.values()]
        out["width"] = [v[0].shape[1] for v in held.values()]
        return out

    def merge(pdf):
        width = int(pdf["width"].iloc[0])
        stack = np.vstack([np.asarray(r, float).reshape(-1, width) for r in pdf["r"]])
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "m": pdf["m"].sum(), "width": width,
                              "r": np.linalg.qr(stack, mode="r").reshape(-1)}])

    schema = f"{key_fields}, m long, r array<double>, width int"
    out = f"{key_fields}, m long, width int, r array<double>"
    parts = rows.select(*keys, *inputs).mapInPandas(reduce_rows, schema)
    spread = parts.withColumn("way", F.pmod(F.xxhash64("r"), F.lit(MERGE_WAYS)))
    once = spread.groupBy(*keys, "way").applyInPandas(merge, out)
    return once.groupBy(*keys).applyInPandas(merge, out)


@F.pandas_udf(ArrayType(DoubleType()))
def singular_values(r: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.svd(np.asarray(v, float).reshape(-1, int(w)), compute_uv=False) for v, w in zip(r, width)])


def rank_report(rows: DataFrame, inputs, keys, cutoff: float = 1e-10) -> DataFrame:
    """feature_rank (machine tolerance), effective_rank (relative cutoff), condition number."""
    s = triangular(rows, inputs, keys).withColumn("s", singular_values("r", "width"))
    top = F.element_at("s", 1)
    tol = top * F.greatest(F.col("m"), F.col("width").cast("long")) * F.lit(2.220446049250313e-16)
    nonzero = F.array_min(F.filter("s", lambda v: v > 0))
    # helper columns keep the lambdas free of outer expressions
    s = s.withColumn("_tol", tol).withColumn("_cut", top * F.lit(cutoff))
    return s.select(*keys, "m", F.col("width").alias("n_features"),
                    F.expr("size(filter(s, v -> v > _tol))").alias("feature_rank"),
                    F.expr("size(filter(s, v -> v > _cut))").alias("effective_rank"),
                    (top / nonzero).alias("condition_number"))


def right_vectors(rows: DataFrame, inputs, keys, rank: int) -> DataFrame:
    """keys, v: the first ``rank`` right singular vectors, column after column."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def leading(r: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(r, width):
            vt = np.linalg.svd(np.asarray(v, float).reshape(-1, int(w)))[2]
            out.append(vt[:rank].reshape(-1))
        return pd.Series(out)

    return triangular(rows, inputs, keys).select(*keys, "width", leading("r", "width").alias("v"))


def project(features, v, rank: int, width):
    """Rank-r reconstruction of a feature array from the leading vectors (both columns)."""
    def part(i):
        axis = F.slice(v, i * width + 1, width)
        products = F.zip_with(features, axis, lambda a, b: a * b)
        score = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
        return F.transform(axis, lambda e: e * score)

    out = part(0)
    for i in range(1, rank):
        out = F.zip_with(out, part(i), lambda a, b: a + b)
    return out


def residual_power(rows: DataFrame, base, targets, keys) -> DataFrame:
    """Mean over the target columns of 1 - R^2 on the base columns (with intercept).

    In the triangular factor of [1, base, targets] a target's squared entries below the
    base rows are its residual sum of squares, and those below row one its spread.
    """
    p = len(base) + 1

    @F.pandas_udf(DoubleType())
    def fraction(r: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(r, width):
            m = np.asarray(v, float).reshape(-1, int(w))
            left, total = (m[p:, p:] ** 2).sum(axis=0), (m[1:, p:] ** 2).sum(axis=0)
            out.append(float(np.mean(np.where(total > 0, left / np.where(total > 0, total, 1.0), 0.0))))
        return pd.Series(out)

    return triangular(rows, [*base, *targets], keys, bias=True).select(
        *keys, fraction("r", "width").alias("residual_power_fraction"))
