"""Frames several queries start from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators.baselines import baseline_forecasts
from foretally.operators.metrics import score
from foretally.operators.split import label_split, split_bounds
from foretally.functions.text import canonical_json, content_checksum, fingerprint
from foretally.operators.metrics import finite_or_null
from foretally.plans.models import FAMILY
from foretally.session import durable
from foretally.sources.tables import panel_by_type, panel_by_user, panel_cells, table

CELL = ("series_id", "seed")
MODELS = ("persistence", "train_mean", "moving_average", "drift")


def labelled_types(spark: SparkSession, sf_dir: str, washout: int = 20, scope: str = "train") -> DataFrame:
    panel = panel_by_type(spark, sf_dir)
    return label_split(panel, split_bounds(panel, washout=washout), scope=scope)


def labelled_users(spark: SparkSession, sf_dir: str, washout: int = 3) -> DataFrame:
    panel = panel_by_user(spark, sf_dir)
    return label_split(panel, split_bounds(panel, washout=washout))


def cell_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_forecasts(panel_cells(spark, sf_dir), CELL, washout=3)


def cell_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(cell_forecasts(spark, sf_dir), [*CELL, "model"])


def user_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(baseline_forecasts(panel_by_user(spark, sf_dir), ("series_id",), washout=3), ["series_id", "model"])


def scope_of_model():
    """The drift runs stand for the leakage-unsafe scope, so that the audits find some."""
    return F.when(F.col("model") == "drift", "global").otherwise("train")


def dataset_id(system: str = "series_id"):
    return fingerprint(canonical_json({
        "contract": (F.lit("dataset/v1"), "text"), "system": (F.col(system), "text"),
        "random_seed": (F.col("seed"), "number"), "sample_count": (F.col("n"), "number")}))


def split_id(scope):
    return fingerprint(canonical_json({
        "contract": (F.lit("split/v1"), "text"), "dataset_id": (F.col("dataset_id"), "text"),
        "split_fracs": (F.array(F.lit(0.6), F.lit(0.2), F.lit(0.2)), "floats"), "washout": (F.lit(3), "number"),
        "lookback": (F.lit(3), "number"), "horizon": (F.lit(1), "number"), "scaler_fit_range": (scope, "text")}))


def split_hash():
    text = F.format_string("[[0, %d], [%d, %d], [%d, %d]]", "train_end", "train_end", "val_end", "val_end", "n")
    return fingerprint(text)


def configuration_id(scope):
    return fingerprint(canonical_json({
        "alpha": (F.lit(1e-6), "float"), "horizon": (F.lit(1), "number"), "lookback": (F.lit(3), "number"),
        "model": (F.col("model"), "text"), "scaler_scope": (scope, "text"), "seed": (F.col("seed"), "number")}))


def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per finished run with everything the four registry tables need."""
    panel = panel_cells(spark, sf_dir)
    sizes = split_bounds(panel, CELL, washout=3)
    content = content_checksum(panel, CELL, [F.col("t").cast("string"), F.col("x").cast("string")])
    scored = cell_results(spark, sf_dir)
    scope = scope_of_model()
    runs = scored.join(sizes, list(CELL)).join(content.withColumnRenamed("checksum", "dataset_hash"), list(CELL))
    runs = runs.withColumn("dataset_id", dataset_id()).withColumn("scope", scope)
    runs = runs.withColumn("split_id", split_id(F.col("scope"))).withColumn("configuration_id", configuration_id(F.col("scope")))
    family = F.create_map(*[v for m in MODELS for v in (F.lit(m), F.lit(FAMILY[m]))])
    return (runs.withColumn("split_hash", split_hash())
            .withColumn("run_id", fingerprint(F.concat_ws("/", "dataset_id", "split_id", "configuration_id"), 32))
            .withColumn("model_family", F.element_at(family, F.col("model")))
            .withColumn("status", F.when(F.col("nrmse") > 1.5, "failed").otherwise("success")))


def registry_frames(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> dict:
    """The four registry tables of the baseline runs; ids are fingerprints, so runs of one
    dataset or split share a row."""
    w = durable(wide_runs(spark, sf_dir)) if runs is None else runs
    null = lambda t: F.lit(None).cast(t)
    datasets = w.select(
        "dataset_id", F.col("series_id").alias("system"),
        canonical_json({"source": (F.lit("events"), "text")}).alias("system_parameters"), null("string").alias("initial_condition"),
        F.col("seed").alias("random_seed"), F.lit("observed").alias("integration_method"), F.lit(1.0).alias("time_step"),
        F.col("n").alias("sample_count"), F.lit(0).cast("long").alias("transient_removed"), null("timestamp").alias("created_at"),
        null("string").alias("code_version"), "dataset_hash").dropDuplicates(["dataset_id"])
    zero = F.lit(0).cast("long")
    splits = w.select(
        "split_id", "dataset_id", zero.alias("train_start"), "train_end", F.col("train_end").alias("validation_start"),
        F.col("val_end").alias("validation_end"), F.col("val_end").alias("test_start"), F.col("n").alias("test_end"),
        F.col("scope").alias("scaler_fit_range"), F.lit(3).cast("long").alias("window_length"),
        F.lit(1).cast("long").alias("prediction_horizon"), "split_hash").dropDuplicates(["split_id"])
    run_rows = w.select(
        "run_id", "dataset_id", "split_id", "model", "model_family", "configuration_id", "seed", F.lit("one_step").alias("forecast_mode"),
        "status", F.lit("reconstructed").alias("provenance_source"), null("timestamp").alias("start_time"), null("timestamp").alias("end_time"),
        null("string").alias("git_commit"), null("string").alias("environment_id"),
        F.when(F.col("status") == "failed", "score above 1.5").alias("error_message"))
    from foretally.operators.contracts import TIMINGS
    metrics = w.select(
        "run_id", finite_or_null(F.col("nrmse")).alias("nrmse"), finite_or_null(F.col("mae")).alias("mae"),
        null("double").alias("valid_prediction_time"), null("boolean").alias("divergence"), F.lit(3.0).alias("feature_count"),
        null("double").alias("feature_rank"), *[null("double").alias(t) for t in TIMINGS])
    return {"datasets": datasets, "splits": splits, "runs": run_rows, "metrics": metrics}
