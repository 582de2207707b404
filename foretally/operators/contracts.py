"""Contracts as rule expressions: one pass over a table gives every violation.

A rule is a name and an expression that is true for a good row.  NULL counts as a
violation only where the rule says so.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)

# fixed values: the registry's closed word lists
SCOPES = ("train", "global")
FAMILIES = ("statistical", "ml", "dl", "reservoir", "quantum")
MODES = ("one_step", "closed_loop")
STATUSES = ("success", "failed")
SOURCES = ("captured", "reconstructed")
SCALERS = ("identity", "none", "minmax", "standard", "standardize", "robust")
WINDOWINGS = ("internal", "shared")
TIMINGS = ("data_generation_seconds", "validation_seconds", "transformation_seconds", "feature_generation_seconds",
           "training_seconds", "inference_seconds", "total_seconds", "peak_memory_mb")

S, L, D, T, B = StringType(), LongType(), DoubleType(), TimestampType(), BooleanType()


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "datasets": _schema(dataset_id=S, system=S, system_parameters=S, initial_condition=S, random_seed=L,
                        integration_method=S, time_step=D, sample_count=L, transient_removed=L, created_at=T,
                        code_version=S, dataset_hash=S),
    "splits": _schema(split_id=S, dataset_id=S, train_start=L, train_end=L, validation_start=L, validation_end=L,
                      test_start=L, test_end=L, scaler_fit_range=S, window_length=L, prediction_horizon=L,
                      split_hash=S),
    "runs": _schema(run_id=S, dataset_id=S, split_id=S, model=S, model_family=S, configuration_id=S, seed=L,
                    forecast_mode=S, status=S, provenance_source=S, start_time=T, end_time=T, git_commit=S,
                    environment_id=S, error_message=S),
    "metrics": _schema(run_id=S, nrmse=D, mae=D, valid_prediction_time=D, divergence=B, feature_count=D,
                       feature_rank=D, **{t: D for t in TIMINGS}),
}
KEYS = {"datasets": "dataset_id", "splits": "split_id", "runs": "run_id", "metrics": "run_id"}
# columns that may be NULL; every other registry column must be set
NULLABLE = {
    "datasets": {"initial_condition", "created_at", "code_version"},
    "splits": set(),
    "runs": {"start_time", "end_time", "git_commit", "environment_id", "error_message"},
    "metrics": {"nrmse", "mae", "valid_prediction_time", "divergence", "feature_rank", *TIMINGS},
}
# least values: column -> (bound, whether the bound itself is allowed)
LEAST = {
    "datasets": {"random_seed": (0, True), "time_step": (0, False), "sample_count": (0, False),
                 "transient_removed": (0, True)},
    "splits": {"train_start": (0, True), "validation_start": (0, True), "test_start": (0, True),
               "train_end": (0, False), "validation_end": (0, False), "test_end": (0, False),
               "window_length": (1, True), "prediction_horizon": (1, True)},
    "runs": {"seed": (0, True)},
    "metrics": {"nrmse": (0, True), "mae": (0, True), "valid_prediction_time": (0, True),
                "feature_count": (0, False), "feature_rank": (1, True), **{t: (0, True) for t in TIMINGS}},
}
WORDS = {
    "splits": {"scaler_fit_range": SCOPES},
    "runs": {"model_family": FAMILIES, "forecast_mode": MODES, "status": STATUSES, "provenance_source": SOURCES},
}


def one_of(name: str, words) -> Column:
    return F.col(name).isin(*words)


def at_least(name: str, bound: float, closed: bool = True) -> Column:
    c = F.col(name)
    ok = c >= bound if closed else c > bound
    return ok & ~F.isnan(c.cast("double"))


# fixed values: the execution facts that a row of each origin must leave empty or must state, and the rule's name
FACTS = (
    ("reconstructed", "empty", ("git_commit", "environment_id", "start_time", "end_time"), "reconstructed row claims execution facts"),
    ("captured", "stated", ("git_commit", "start_time", "end_time"), "captured row lacks execution facts"),
)


def fact_rules() -> dict:
    """One rule per entry of ``FACTS``; rows of another origin always pass."""
    rules = {}
    for origin, kind, columns, name in FACTS:
        passes = [F.col(c).isNull() if kind == "empty" else F.col(c).isNotNull() for c in columns]
        rules[name] = F.coalesce(F.col("provenance_source") != origin, F.lit(True)) | F.array_min(F.array(*passes))
    return rules


def registry_rules(table: str) -> dict:
    rules = {f"{f.name} is null": F.col(f.name).isNotNull()
             for f in SCHEMAS[table] if f.name not in NULLABLE[table]}
    for name, (bound, closed) in LEAST[table].items():
        rules[f"{name} out of range"] = F.coalesce(at_least(name, bound, closed), F.lit(True))
    for name, words in WORDS.get(table, {}).items():
        rules[f"{name} not a known word"] = F.coalesce(one_of(name, words), F.lit(True))
    if table == "runs":
        rules |= fact_rules()
    return rules


def config_rules() -> dict:
    fracs = F.col("split_fracs")
    total = F.aggregate(fracs, F.lit(0.0), lambda a, v: a + v)
    systems = ("view", "click", "signup", "error", "purchase")
    return {
        "system": one_of("system", systems), "n_points": F.col("n_points") > 0, "seed": F.col("seed") >= 0,
        "scaler": one_of("scaler", SCALERS), "scaler_scope": one_of("scaler_scope", SCOPES),
        "split_fracs": (F.size(fracs) == 3) & F.forall(fracs, lambda v: v > 0) & (F.abs(total - 1.0) <= 1e-9),
        "washout": F.col("washout") >= 0, "horizon": F.col("horizon") >= 1, "lookback": F.col("lookback") >= 1,
        "stride": F.col("stride") >= 1, "windowing": one_of("windowing", WINDOWINGS), "alpha": F.col("alpha") >= 0,
        "encode_scale": F.col("encode_scale") > 0,
    }


def result_rules(metrics=()) -> dict:
    return {"model": F.col("model").isNotNull(), "n_features": F.coalesce(F.col("n_features") > 0, F.lit(False)),
            "seed": F.coalesce(F.col("seed") >= 0, F.lit(False))}


def forecast_rules() -> dict:
    """Truth must be a finite number, a prediction may be anything."""
    y = F.col("y_true")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    return {"t": F.coalesce(F.col("t") >= 0, F.lit(False)), "y_true": F.coalesce(finite, F.lit(False))}


def violations(df: DataFrame, rules: dict, key) -> DataFrame:
    """(key..., rule) for every broken rule, in one scan."""
    key = [key] if isinstance(key, str) else list(key)
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, key) -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(*key, F.lit("key not unique").alias("rule")))


def registry_violations(table: str, df: DataFrame) -> DataFrame:
    key = KEYS[table]
    return violations(df, registry_rules(table), key).unionByName(duplicates(df, key))


def conform(table: str, df: DataFrame) -> DataFrame:
    """The table's columns in order: an unknown column is an error, a missing one is NULL."""
    extra = [c for c in df.columns if c not in SCHEMAS[table].names]
    if extra:
        raise ValueError(f"unknown column(s) for {table}: {extra}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCHEMAS[table]])


def fairness_violations(runs: DataFrame, f_tolerance: int = 0, group: str = "comparison_id") -> DataFrame:
    """Why a set of runs may not be compared: one row per (comparison, broken rule)."""
    n = F.count(F.lit(1))
    differs = lambda c: F.count_distinct(c) > 1
    partly = lambda c: (F.count(c) > 0) & ((F.count(c) != n) | (F.count_distinct(c) > 1))
    needed = ("dataset_id", "split_id", "scaler_scope", "horizon", "n_features")
    rules = {
        "fewer than two runs": n < 2,
        "missing required field": F.bool_or(F.array_contains(F.array(*[F.col(c).isNull() for c in needed]), True)),
        "unequal dataset_id": differs("dataset_id"),
        "unequal split_id": differs("split_id"),
        "unequal horizon": differs("horizon"),
        "scaler scope not train": F.bool_or(F.coalesce(F.col("scaler_scope") != "train", F.lit(False))),
        "unmatched feature counts": F.coalesce(F.max("n_features") - F.min("n_features") > f_tolerance, F.lit(False)),
        "seed_set unequal or partly declared": partly("seed_set"),
        "tuning_budget unequal or partly declared": partly("tuning_budget"),
    }
    judged = runs.groupBy(group).agg(*[r.alias(f"r{i}") for i, r in enumerate(rules.values())])
    broken = F.array_compact(F.array(*[F.when(F.col(f"r{i}"), F.lit(name)) for i, name in enumerate(rules)]))
    return judged.select(group, F.explode(broken).alias("rule"))
