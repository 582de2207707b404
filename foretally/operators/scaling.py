"""Scalers fitted per series on the rows a fit may see.

Every scaler is the affine map ``offset + (x - shift) / scale * span``; a fitted scaler
is therefore one small row per series, and one inverse serves all of them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import BLOCK_ROWS, KEYS, attach
from foretally.operators.quantiles import exact_quantiles

SCALERS = ("identity", "none", "minmax", "standard", "standardize", "robust")
PARAMS = ("shift", "scale", "span", "offset")


def fit_scaler(labelled: DataFrame, kind: str = "minmax", keys=KEYS, lo: float = 0.0, hi: float = 1.0,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, n, shift, scale, span, offset from the in_fit rows of ``labelled``."""
    keys = list(keys)
    x = F.when(F.col("in_fit"), F.col("x"))
    n = F.max("n").alias("n")
    one = lambda c: F.when(c == 0, F.lit(1.0)).otherwise(c)  # zero spread counts as 1
    if kind in ("identity", "none"):
        return labelled.groupBy(*keys).agg(n).select(
            *keys, "n", F.lit(0.0).alias("shift"), F.lit(1.0).alias("scale"),
            F.lit(1.0).alias("span"), F.lit(0.0).alias("offset"))
    if kind == "minmax":
        got = labelled.groupBy(*keys).agg(n, F.min(x).alias("a"), F.max(x).alias("b"))
        return got.select(*keys, "n", F.col("a").alias("shift"), one(F.col("b") - F.col("a")).alias("scale"),
                          F.lit(float(hi - lo)).alias("span"), F.lit(float(lo)).alias("offset"))
    if kind in ("standard", "standardize"):
        got = labelled.groupBy(*keys).agg(n, F.avg(x).alias("a"), F.stddev_pop(x).alias("b"))
        return got.select(*keys, "n", F.col("a").alias("shift"), one(F.col("b")).alias("scale"),
                          F.lit(1.0).alias("span"), F.lit(0.0).alias("offset"))
    if kind == "robust":
        fit_rows = labelled.where("in_fit")
        q = exact_quantiles(fit_rows, keys, "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        sizes = labelled.groupBy(*keys).agg(n)
        return sizes.join(q, keys).select(
            *keys, "n", F.col("q2").alias("shift"), one(F.col("q3") - F.col("q1")).alias("scale"),
            F.lit(1.0).alias("span"), F.lit(0.0).alias("offset"))
    raise ValueError(f"unknown scaler {kind!r}; known: {SCALERS}")


def scale(panel: DataFrame, params: DataFrame, keys=KEYS, column: str = "x", out: str = "u") -> DataFrame:
    """Apply fitted parameters; the parameter columns are dropped again."""
    rows = attach(panel.drop("n") if "n" in panel.columns else panel, params, keys)
    z = F.col("offset") + (F.col(column) - F.col("shift")) / F.col("scale") * F.col("span")
    return rows.withColumn(out, z).drop(*PARAMS)


def unscale(panel: DataFrame, params: DataFrame, keys=KEYS, column: str = "u", out: str = "x_back") -> DataFrame:
    rows = attach(panel.drop("n") if "n" in panel.columns else panel, params, keys)
    x = (F.col(column) - F.col("offset")) / F.col("span") * F.col("scale") + F.col("shift")
    return rows.withColumn(out, x).drop(*PARAMS)


class ScalerStep:
    """Fit/transform step: parameters come from in_fit rows only; using it unfitted fails."""

    def __init__(self, kind: str = "minmax", keys=KEYS, column: str = "x"):
        self.kind, self.keys, self.column, self.params = kind, list(keys), column, None

    def fit(self, labelled: DataFrame) -> "ScalerStep":
        self.params = fit_scaler(labelled.withColumn("x", F.col(self.column)), self.kind, self.keys)
        return self

    def _ready(self):
        if self.params is None:
            raise RuntimeError(f"scaler {self.kind!r} used before fit")
        return self.params

    def transform(self, panel: DataFrame) -> DataFrame:
        return scale(panel, self._ready(), self.keys, self.column, self.column)

    def inverse(self, panel: DataFrame) -> DataFrame:
        return unscale(panel, self._ready(), self.keys, self.column, self.column)


def make_scaler(kind: str, keys=KEYS) -> ScalerStep:
    """Scaler by name; 'identity' and 'none' are the off level."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; known: {SCALERS}")
    return ScalerStep(kind, keys)


class Chain:
    """Steps applied left to right, identity steps skipped, inverse in reverse order."""

    def __init__(self, *steps):
        self.steps = [s for s in steps if getattr(s, "kind", None) not in ("identity", "none")]

    def fit(self, labelled: DataFrame) -> "Chain":
        for step in self.steps:
            labelled = step.fit(labelled).transform(labelled)
        return self

    def transform(self, panel: DataFrame) -> DataFrame:
        for step in self.steps:
            panel = step.transform(panel)
        return panel

    def inverse(self, panel: DataFrame) -> DataFrame:
        for step in reversed(self.steps):
            panel = step.inverse(panel)
        return panel
