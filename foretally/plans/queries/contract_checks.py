"""Split, filter and contract queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.functions.text import is_finite
from foretally.operators import audit, contracts, metrics
from foretally.operators.baselines import persistence
from foretally.operators.blocks import attach
from foretally.operators.split import admitted, label_split, oversized_washout, split_bounds, split_order_violations
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, MODELS, cell_forecasts, cell_results, registry_frames, user_results, wide_runs
from foretally.plans.queries import sqltext as q
from foretally.sources.tables import panel_by_type, panel_by_user, panel_cells, table

_REG = q.REGISTRY


@query("P1", q.select(_REG, "SELECT run_id, nrmse IS NULL AS nrmse_missing, CAST(NULL AS DOUBLE) AS feature_rank, feature_count, (SELECT count(*) FROM (SELECT unnest(range(0, 15)))) AS n_columns FROM metrics"))
def conform_to_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows without half of their columns become full contract rows."""
    short = wide_runs(spark, sf_dir).select("run_id", "nrmse", F.lit(3.0).alias("feature_count"))
    full = contracts.conform("metrics", short)
    return full.select("run_id", F.col("nrmse").isNull().alias("nrmse_missing"), "feature_rank", "feature_count",
                       F.lit(len(full.columns)).cast("long").alias("n_columns"))


# configurations derived from every part row: most are fine, some break a rule; the same
# expressions run in both engines
CONFIG = {
    "config_id": "p_partkey",
    "n_points": "(p_size - 2) * 100",
    "seed": "p_partkey % 9 - 1",
    "system": "CASE p_size % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' WHEN 4 THEN 'purchase' ELSE 'not_a_system' END",
    "scaler": "CASE p_size % 8 WHEN 0 THEN 'identity' WHEN 1 THEN 'none' WHEN 2 THEN 'minmax' WHEN 3 THEN 'standard' WHEN 4 THEN 'standardize' WHEN 5 THEN 'robust' WHEN 6 THEN 'minmax' ELSE 'quantile' END",
    "scaler_scope": "CASE WHEN p_size % 11 = 0 THEN 'future' WHEN p_size % 2 = 0 THEN 'train' ELSE 'global' END",
    "f0": "CASE WHEN p_size % 17 = 0 THEN -0.2e0 ELSE 0.6e0 END",
    "f1": "CASE WHEN p_size % 17 = 0 THEN 1.0e0 ELSE 0.2e0 END",
    "f2": "CASE WHEN p_size % 13 = 0 THEN 0.3e0 ELSE 0.2e0 END",
    "washout": "p_size * 10 - 20",
    "horizon": "p_size % 5",
    "lookback": "p_size % 7",
    "stride": "p_size % 4 + 1",
    "windowing": "CASE p_size % 9 WHEN 0 THEN 'both' WHEN 1 THEN 'shared' ELSE 'internal' END",
    "alpha": "(p_size % 5 - 1) * 1e-6",
    "encode_scale": "(p_size % 6) * 0.5e0",
}
CONFIG_SQL = "configs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CONFIG.items()) + " FROM part)"


def configs(spark, sf_dir) -> DataFrame:
    got = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in CONFIG.items()])
    return got.withColumn("split_fracs", F.array("f0", "f1", "f2"))


_CONFIG_RULES = {
    "system": "system IN ('view', 'click', 'signup', 'error', 'purchase')", "n_points": "n_points > 0", "seed": "seed >= 0",
    "scaler": "scaler IN ('identity', 'none', 'minmax', 'standard', 'standardize', 'robust')", "scaler_scope": "scaler_scope IN ('train', 'global')",
    "split_fracs": "f0 > 0 AND f1 > 0 AND f2 > 0 AND abs(f0 + f1 + f2 - 1.0) <= 1e-9", "washout": "washout >= 0", "horizon": "horizon >= 1",
    "lookback": "lookback >= 1", "stride": "stride >= 1", "windowing": "windowing IN ('internal', 'shared')", "alpha": "alpha >= 0", "encode_scale": "encode_scale > 0",
}


@query("P2", q.select(CONFIG_SQL, " UNION ALL ".join(f"SELECT config_id, '{n}' AS rule FROM configs WHERE NOT ({c})" for n, c in _CONFIG_RULES.items())))
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(configs(spark, sf_dir), contracts.config_rules(), "config_id")


def damaged_runs(spark, sf_dir) -> DataFrame:
    """Run rows in which each weekday carries its own fault."""
    runs = registry_frames(spark, sf_dir)["runs"]
    s = F.col("seed")
    return (runs.withColumn("status", F.when(s == 1, "completed").otherwise(F.col("status")))
            .withColumn("dataset_id", F.when(s != 2, F.col("dataset_id")))
            .withColumn("git_commit", F.when(s == 3, "abc123"))
            .withColumn("provenance_source", F.when(s == 4, "captured").otherwise(F.col("provenance_source")))
            .withColumn("model_family", F.when(s == 5, "oracle").otherwise(F.col("model_family")))
            .withColumn("run_id", F.when(s == 6, F.lit("same")).otherwise(F.col("run_id")))
            .withColumn("seed", F.when(s == 0, F.lit(-1).cast("long")).otherwise(s)))


_DAMAGED = (", damaged AS (SELECT CASE WHEN seed = 6 THEN 'same' ELSE run_id END AS run_id, CASE WHEN seed <> 2 THEN dataset_id END AS dataset_id, "
            "CASE WHEN seed = 1 THEN 'completed' ELSE status END AS status, CASE WHEN seed = 3 THEN 'abc123' END AS git_commit, "
            "CASE WHEN seed = 4 THEN 'captured' ELSE provenance_source END AS provenance_source, CASE WHEN seed = 5 THEN 'oracle' ELSE model_family END AS model_family, "
            "CASE WHEN seed = 0 THEN -1 ELSE seed END AS seed FROM runs)")


@query("P3", q.select(_REG + _DAMAGED, "SELECT run_id, 'dataset_id is null' AS rule FROM damaged WHERE dataset_id IS NULL UNION ALL SELECT run_id, 'seed out of range' FROM damaged WHERE seed < 0 "
       "UNION ALL SELECT run_id, 'status not a known word' FROM damaged WHERE status NOT IN ('success', 'failed') UNION ALL SELECT run_id, 'model_family not a known word' FROM damaged WHERE model_family = 'oracle' "
       "UNION ALL SELECT run_id, 'reconstructed row claims execution facts' FROM damaged WHERE provenance_source = 'reconstructed' AND git_commit IS NOT NULL "
       "UNION ALL SELECT run_id, 'captured row lacks execution facts' FROM damaged WHERE provenance_source = 'captured' "
       "UNION ALL SELECT run_id, 'key not unique' FROM damaged GROUP BY 1 HAVING count(*) > 1"))
def registry_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.registry_violations("runs", damaged_runs(spark, sf_dir))


@query("P4", q.select(_REG + _DAMAGED, "SELECT run_id, NOT (provenance_source = 'reconstructed' AND git_commit IS NOT NULL) AS holds FROM damaged"))
def reconstructed_claims_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_runs(spark, sf_dir).select("run_id", contracts.fact_rules()["reconstructed row claims execution facts"].alias("holds"))


@query("P5 X12", q.select(_REG + _DAMAGED, "SELECT run_id, provenance_source, provenance_source <> 'captured' AS holds FROM damaged"))
def captured_carries_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_runs(spark, sf_dir).select("run_id", "provenance_source", contracts.fact_rules()["captured row lacks execution facts"].alias("holds"))


@query("P6", q.select(q.USER_RESULTS, "SELECT series_id, model, rule FROM (SELECT series_id, model, 'n_features' AS rule FROM results WHERE n_test % 3 = 0 UNION ALL SELECT series_id, model, 'seed' FROM results WHERE CAST(series_id AS BIGINT) < 5)"))
def result_row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows whose feature count or seed went wrong in some of them."""
    rows = user_results(spark, sf_dir).withColumn("n_features", F.col("n_test") % 3).withColumn("seed", F.col("series_id").cast("long") - 5)
    return contracts.violations(rows, contracts.result_rules(), ["series_id", "model"])


@query("P7", q.select(f"{q.TYPE}", "SELECT series_id, t, 'y_true' AS rule FROM series WHERE x > 150 UNION ALL SELECT series_id, t, 't' FROM series WHERE x < 0.5"))
def forecast_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth overflowed above 150, step numbers broken below 0.5, predictions left alone."""
    x = F.col("x")
    rows = panel_by_type(spark, sf_dir).select(
        "series_id", F.col("t").alias("row"), F.when(x < 0.5, -F.col("t") - 1).otherwise(F.col("t")).alias("t"),
        F.when(x > 150, F.lit(float("nan"))).otherwise(x).alias("y_true"), F.lit(float("inf")).alias("y_pred"))
    return contracts.violations(rows, contracts.forecast_rules(), ["series_id", "row"]).withColumnRenamed("row", "t")


@query("P8", q.select(_REG, "SELECT run_id, model, round(nrmse, 6) AS nrmse FROM runs JOIN metrics USING (run_id) WHERE status = 'success' AND nrmse IS NOT NULL"))
def scored_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_runs(spark, sf_dir)
    return w.where("status = 'success' AND nrmse IS NOT NULL").select("run_id", "model", r("nrmse").alias("nrmse"))


@query("P9", q.select(f"{q.USER}, {q.bounds(washout=3)}, {q.labelled()}", "SELECT series_id, t, segment, train_end, val_end, n FROM labelled"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_by_user(spark, sf_dir)
    return label_split(panel, split_bounds(panel, washout=3)).select("series_id", "t", "segment", "train_end", "val_end", "n")


@query("P10", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}", "SELECT 'train' AS scope, series_id, CAST(count_if(in_fit) AS BIGINT) AS fit_rows, round(avg(CASE WHEN in_fit THEN x END), 6) AS fit_mean FROM labelled GROUP BY 2 "
       "UNION ALL SELECT 'global', series_id, count(*), round(avg(x), 6) FROM labelled GROUP BY 2"))
def fit_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_by_type(spark, sf_dir)
    out = None
    for scope in ("train", "global"):
        got = label_split(panel, split_bounds(panel, washout=20), scope=scope).groupBy("series_id").agg(
            F.count_if("in_fit").alias("fit_rows"), r(F.avg(F.when(F.col("in_fit"), F.col("x")))).alias("fit_mean")).withColumn("scope", F.lit(scope))
        out = got if out is None else out.unionByName(got)
    return out


@query("P11", q.select(_REG, "SELECT split_id FROM splits JOIN datasets USING (dataset_id) WHERE random_seed = 6"))
def split_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of one weekday were shifted so that train runs into validation."""
    frames = registry_frames(spark, sf_dir)
    splits = frames["splits"].join(frames["datasets"].select("dataset_id", "random_seed"), "dataset_id")
    bad = splits.withColumn("train_end", F.when(F.col("random_seed") == 6, F.col("validation_start") + 1).otherwise(F.col("train_end")))
    return split_order_violations(bad).select("split_id")


@query("P9", q.select(f"{q.USER}, {q.bounds(washout=40)}", "SELECT series_id, n, train_end, washout FROM bounds WHERE washout >= train_end"))
def washout_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_washout(split_bounds(panel_by_user(spark, sf_dir), washout=40)).select("series_id", "n", "train_end", "washout")


@query("P12 C2", q.select(f"{q.TYPE}, {q.bounds()}, {q.labelled()}, {q.lagged(1)}", "SELECT series_id, count(*) AS n_test, CAST(count_if(d0 > 150 OR d0 < 0.5) AS BIGINT) AS nonfinite FROM lagged WHERE t >= val_end AND y IS NOT NULL GROUP BY 1"))
def nonfinite_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts that blew up (infinite above 150, NaN below 0.5) are counted, not dropped."""
    p = F.col("y_pred")
    wild = F.when(p > 150, F.lit(float("inf"))).when(p < 0.5, F.lit(float("nan"))).otherwise(p)
    return persistence(panel_by_type(spark, sf_dir)).withColumn("y_pred", wild).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_test"), metrics.nonfinite().alias("nonfinite"))


@query("P13 C12", "SELECT event_id, CASE WHEN value > 150 OR value < 0.5 THEN NULL ELSE round(value, 6) END AS value, TRY_CAST(CASE WHEN user_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS casted FROM events")
def nonfinite_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    wild = F.when(v > 150, F.lit(float("inf"))).when(v < 0.5, F.lit(float("nan"))).otherwise(v)
    text = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(v.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", metrics.finite_or_null(wild).alias("value"), text.try_cast("double").alias("casted"))


_HITS = f"{q.CELL_RESULTS}, cells AS (SELECT series_id, seed, model, unnest(['nrmse', 'rmse', 'mae', 'mse', 'r2', 'smape', 'max_error', 'n_test']) AS column_name, unnest([nrmse, rmse, mae, mse, r2, smape, max_error, n_test::DOUBLE]) AS value FROM results), hits AS (SELECT *, abs(value - 40.0) / 40.0 AS rel FROM cells WHERE abs(value - 40.0) / 40.0 <= 0.05)"


@query("P14", q.select(_HITS, "SELECT series_id, seed, model, column_name, round(value, 6) AS value, round(rel, 6) AS rel FROM hits"))
def value_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score within five percent of 40, in whichever column it stands."""
    hits = audit.value_search(cell_results(spark, sf_dir), [*CELL, "model"], F.lit(40.0), 0.05)
    return hits.select(*CELL, "model", "column_name", r("value").alias("value"), r("rel").alias("rel"))


@query("P15", q.select(f"{q.TYPE}", "SELECT series_id, t, CASE WHEN x % 1 = 0 THEN 'exact' WHEN abs(x - round(x, 0)) / greatest(abs(round(x, 0)), 1e-300) <= 1e-12 THEN 'exact to double precision' ELSE 'approximate' END AS quality FROM series"))
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each value matches its nearest whole number."""
    rel = audit.relative_error(F.col("x"), F.round("x", 0))
    return panel_by_type(spark, sf_dir).select("series_id", "t", audit.match_quality(rel).alias("quality"))


@query("P17", q.select(q.USER_RESULTS, "SELECT series_id, model, CASE model WHEN 'persistence' THEN 'naive' WHEN 'train_mean' THEN 'constant' WHEN 'moving_average' THEN 'smoother' ELSE 'trend' END AS kind, "
                                       "CASE WHEN model IN ('moving_average', 'train_mean') THEN 'yes' ELSE 'no' END AS averages FROM results"))
def categorical_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"persistence": "naive", "train_mean": "constant", "moving_average": "smoother", "drift": "trend"}
    lookup = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    member = F.when(F.col("model").isin("moving_average", "train_mean"), "yes").otherwise("no")
    return user_results(spark, sf_dir).select("series_id", "model", F.element_at(lookup, F.col("model")).alias("kind"), member.alias("averages"))


def comparisons(spark, sf_dir) -> DataFrame:
    """Orders as runs to compare: a comparison is a customer's set of orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("comparison_id"), F.when(k % 97 != 0, F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string"))).otherwise("other").alias("dataset_id"),
        F.when(k % 89 == 0, "s2").otherwise("s1").alias("split_id"), F.when(k % 83 == 0, "global").otherwise("train").alias("scaler_scope"),
        F.when(k % 79 != 0, F.lit(1)).otherwise(F.when(k % 2 == 0, F.lit(3))).alias("horizon"), (F.lit(10) + (k % 71 == 0).cast("int")).alias("n_features"),
        F.when(F.col("o_custkey") % 3 == 0, F.when(k % 61 != 0, "0-4")).alias("seed_set"),
        F.when(F.col("o_custkey") % 4 == 0, F.when(k % 59 != 0, F.lit(50)).otherwise(F.lit(60))).alias("tuning_budget"))


_RUNMETA = ("rm AS (SELECT o_custkey AS comparison_id, CASE WHEN o_orderkey % 97 <> 0 THEN 'd' || (o_custkey % 5) ELSE 'other' END AS dataset_id, CASE WHEN o_orderkey % 89 = 0 THEN 's2' ELSE 's1' END AS split_id, "
            "CASE WHEN o_orderkey % 83 = 0 THEN 'global' ELSE 'train' END AS scaler_scope, CASE WHEN o_orderkey % 79 <> 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 3 END AS horizon, "
            "10 + CASE WHEN o_orderkey % 71 = 0 THEN 1 ELSE 0 END AS n_features, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 61 <> 0 THEN '0-4' END AS seed_set, "
            "CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_orderkey % 59 <> 0 THEN 50 ELSE 60 END END AS tuning_budget FROM orders)")


@query("P18 U3", q.select(_RUNMETA, " UNION ALL ".join(
    f"SELECT comparison_id, '{name}' AS rule FROM rm GROUP BY 1 HAVING {cond}" for name, cond in (
        ("fewer than two runs", "count(*) < 2"), ("missing required field", "bool_or(horizon IS NULL)"), ("unequal dataset_id", "count(DISTINCT dataset_id) > 1"),
        ("unequal split_id", "count(DISTINCT split_id) > 1"), ("unequal horizon", "count(DISTINCT horizon) > 1"), ("scaler scope not train", "bool_or(scaler_scope <> 'train')"),
        ("unmatched feature counts", "max(n_features) - min(n_features) > 0"),
        ("seed_set unequal or partly declared", "count(seed_set) > 0 AND (count(seed_set) <> count(*) OR count(DISTINCT seed_set) > 1)"),
        ("tuning_budget unequal or partly declared", "count(tuning_budget) > 0 AND (count(tuning_budget) <> count(*) OR count(DISTINCT tuning_budget) > 1)")))))
def fair_comparison_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.fairness_violations(comparisons(spark, sf_dir))


@query("P19", "WITH s AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 5.0 WHEN value > 190 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events), g AS (SELECT user_id FROM s GROUP BY 1 "
              "HAVING bool_and(x < 'Infinity'::DOUBLE) AND max(x) - min(x) > 1e-6) SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n_rows FROM s JOIN g USING (user_id) GROUP BY 1")
def series_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with an overflow or without any spread are not admitted."""
    panel = panel_by_user(spark, sf_dir)
    x = F.when(F.col("series_id").cast("long") % 10 == 0, F.lit(5.0)).when(F.col("x") > 190, F.lit(float("inf"))).otherwise(F.col("x"))
    return admitted(panel.withColumn("x", x)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"))
