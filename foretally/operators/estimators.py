"""Estimators over windows: a ridge estimator object and regressors by name."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS
from foretally.operators.elastic import elastic_fit
from foretally.operators.ridge import ridge_fit, ridge_predict
from foretally.operators.split import split_bounds
from foretally.operators.trees import boosted_forecasts, forest_forecasts
from foretally.operators.windows import delays, taps_of


class PanelParams(Params):
    """Parameters that the estimator and its models share."""

    taps = Param(Params._dummy(), "taps", "lags a forecast sees", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "penalty on the squared weights", TypeConverters.toFloat)
    washout = Param(Params._dummy(), "washout", "first rows of a series that no fit sees", TypeConverters.toInt)
    keys = Param(Params._dummy(), "keys", "columns that tell series apart", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(taps=2, alpha=1e-6, washout=0, keys=list(KEYS))

    def lags(self) -> list:
        return taps_of(self.getOrDefault(self.taps))


class PanelRidgeModel(Model, PanelParams, MLWritable, MLReadable):
    """Weights per series; saved as parameters and a table of weights."""

    def __init__(self, weights: DataFrame | None = None):
        super().__init__()
        self.weights = weights

    def _transform(self, panel: DataFrame) -> DataFrame:
        """Forecast of the next value at every row; features are causal, so the values at a
        row are the same whether the series ends there or goes on."""
        keys = self.getOrDefault(self.keys)
        rows = delays(panel, self.getOrDefault(self.taps), 1, 0, keys)
        sizes = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return ridge_predict(rows, self.weights.drop("n").join(sizes, keys), self.lags(), keys)

    def write(self) -> "ModelWriter":
        return ModelWriter(self)

    @classmethod
    def read(cls) -> "ModelReader":
        return ModelReader(cls)


class ModelWriter(MLWriter):
    def __init__(self, model: PanelRidgeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.weights.write.parquet(f"{path}/weights")


class ModelReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> PanelRidgeModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/weights"))
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model


class PanelRidge(Estimator, PanelParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fit on a prefix of every series, predict on the full series; washout rows are dropped."""

    @keyword_only
    def __init__(self, *, taps: int = 2, alpha: float = 1e-6, washout: int = 0, keys=KEYS):
        super().__init__()
        given = self._input_kwargs
        self._set(**{**given, **({"keys": list(given["keys"])} if "keys" in given else {})})

    def _fit(self, panel: DataFrame) -> PanelRidgeModel:
        keys, taps = self.getOrDefault(self.keys), self.getOrDefault(self.taps)
        rows = delays(panel, taps, 1, 1, keys).where(F.col("y").isNotNull() & (F.col("t") >= self.getOrDefault(self.washout)))
        sizes = split_bounds(panel, keys).select(*keys, "n")
        weights = ridge_fit(rows.withColumn("n", F.lit(0).cast("long")), self.lags(), F.col("y"), self.getOrDefault(self.alpha), keys)
        return self._copyValues(PanelRidgeModel(weights.drop("n").join(sizes, keys)))


# fitting and forecasting by name: (rows with part, features, keys) -> keys, t, y_true, y_pred
REGRESSORS = {
    "random_forest": forest_forecasts,
    "boosted_trees": boosted_forecasts,
    "elastic_net": lambda rows, inputs, keys, **how: _elastic(rows, inputs, keys, **how),
}


def _elastic(rows: DataFrame, inputs, keys, **how) -> DataFrame:
    cols = [F.col(c) for c in inputs]
    fit = elastic_fit(rows.where("part = 'train'"), cols, F.col("y"), keys=keys, **how)
    test = ridge_predict(rows.where("part = 'test'"), fit, cols, keys)
    return test.select(*keys, "t", F.col("y").alias("y_true"), "y_pred")


def window_forecasts(rows: DataFrame, kind: str, inputs, keys=KEYS, **how) -> DataFrame:
    """The named regressor, fitted per series on its train windows and applied to its test
    windows.  Standardising the windows changes no tree, and the elastic net does it itself."""
    return REGRESSORS[kind](rows, list(inputs), list(keys), **how)
