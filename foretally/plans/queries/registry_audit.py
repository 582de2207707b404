"""Registry, identity, diff and incremental-work queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.functions import text as tx
from foretally.operators import audit, contracts, lattice, metrics
from foretally.operators.baselines import baseline_forecasts
from foretally.operators.grids import linear_grid
from foretally.operators.quantiles import exact_quantiles
from foretally.operators.reservoir import reservoir_forecasts
from foretally.operators.scaling import fit_scaler, scale
from foretally.operators.split import label_split, split_bounds, split_order_violations
from foretally.operators.tallies import per_level
from foretally.operators.windows import delays
from foretally.plans.catalogue import query, r
from foretally.plans.frames import (CELL, MODELS, cell_forecasts, cell_results, dataset_id, registry_frames, split_id, user_results,
                                     wide_runs)
from foretally.plans.models import AXIS_LEVELS, FAMILY
from foretally.plans.queries import sqltext as q
from foretally.plans.queries.contract_checks import _CONFIG_RULES, CONFIG_SQL, configs
from foretally.plans.queries.forecasting import _det
from foretally.plans.queries.lookups import _MATRIX, cell_matrix
from foretally.plans.queries.scans import scratch
from foretally.session import durable
from foretally.sources import registry
from foretally.sources.tables import panel_by_type, panel_by_user, panel_cells, table

_REG, _R, _F = q.REGISTRY, q.CELL_RESULTS, q.CELL_FORECASTS


@query("X1", q.select(_REG, "SELECT 'first' AS step, count(*) AS written, count(*) AS total FROM runs WHERE seed < 5 UNION ALL SELECT 'skip', count(*) FILTER (WHERE seed >= 5), count(*) FROM runs "
                            "UNION ALL SELECT 'replace', count(*) FILTER (WHERE seed = 2), count(*) FROM runs UNION ALL SELECT 'error', 0, count(*) FROM runs"))
def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended under each duplicate policy; 'error' refuses and writes nothing."""
    root = scratch(spark)
    runs = durable(registry_frames(spark, sf_dir)["runs"])
    steps = []

    def add(step, rows, policy):
        try:
            written = registry.append_rows(spark, root, "runs", rows, policy)
        except ValueError:
            written = 0
        steps.append((step, written, registry.read_table(spark, root, "runs").count()))

    add("first", runs.where("seed < 5"), "skip")
    add("skip", runs, "skip")
    add("replace", runs.where("seed = 2").withColumn("error_message", F.lit("again")), "replace")
    add("error", runs.where("seed = 3"), "error")
    return spark.createDataFrame(steps, "step string, written long, total long")


@query("X2", q.select(_REG, "SELECT 'datasets' AS table_name, count(*) AS n_rows, count(DISTINCT dataset_id) AS n_keys FROM datasets UNION ALL SELECT 'splits', count(*), count(DISTINCT split_id) FROM splits "
                            "UNION ALL SELECT 'runs', count(*), count(DISTINCT run_id) FROM runs UNION ALL SELECT 'metrics', count(*), count(DISTINCT run_id) FROM metrics"))
def rows_for_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = registry_frames(spark, sf_dir)
    out = None
    for name, df in frames.items():
        got = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(contracts.KEYS[name]).alias("n_keys")).withColumn("table_name", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def scoreboard(spark, sf_dir) -> DataFrame:
    """A flat scoreboard as older studies kept it: group word, status text, fractions as text."""
    rows = wide_runs(spark, sf_dir)
    group = F.when(F.col("model") == "drift", "Machine learning").otherwise("Statistical")
    return rows.select(
        F.col("series_id").alias("system"), F.col("model").alias("model_key"), group.alias("group"), "seed", "n",
        F.when(F.col("nrmse") > 1.5, "error: score above 1.5").otherwise("ok").alias("status"),
        F.when(F.col("nrmse") > 1.45, F.lit(float("inf"))).otherwise(F.col("nrmse")).alias("nrmse"), "mae",
        F.lit("(0.6, 0.2, 0.2)").alias("cfg_split_fracs"), F.col("scope").alias("cfg_scaler_scope"))


@query("X3", q.select(_REG, "SELECT model, model_family, status, count(*) AS n_runs, CAST(count_if(nrmse > 1.45) AS BIGINT) AS null_scores, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT split_id) AS n_splits, "
                            "max(CASE WHEN status = 'failed' THEN 'error: score above 1.5' END) AS error_message FROM w GROUP BY 1, 2, 3"))
def scoreboard_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard rebuilt as registry rows: ids, recoded status and family, finite scores."""
    board = scoreboard(spark, sf_dir)
    # fixed values: group words of the scoreboard and the registry's family words
    family = F.create_map(*[F.lit(v) for v in ("Statistical", "statistical", "Machine learning", "ml")])
    did, sid = dataset_id("system"), split_id(F.col("cfg_scaler_scope"))
    ok = F.col("status") == "ok"
    rows = board.withColumn("dataset_id", did).withColumn("split_id", sid).select(
        "dataset_id", "split_id", F.col("model_key").alias("model"), F.element_at(family, F.col("group")).alias("model_family"),
        F.when(ok, "success").otherwise("failed").alias("status"), F.when(~ok, F.col("status")).alias("error_message"),
        metrics.finite_or_null(F.col("nrmse")).alias("nrmse"))
    return rows.groupBy("model", "model_family", "status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("nrmse").isNull()).alias("null_scores"), F.count_distinct("dataset_id").alias("n_datasets"),
        F.count_distinct("split_id").alias("n_splits"), F.max("error_message").alias("error_message"))


@query("X4", q.select(_R, "SELECT count(*) AS n_rows, TRUE AS same_fingerprint, TRUE AS collision_refused, TRUE AS forced_restores FROM results"))
def overwrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing again is fine while the stored table is the recorded one; a table changed by
    another producer is not overwritten unless told to."""
    path = scratch(spark)
    rows = durable(cell_results(spark, sf_dir).select(*CELL, "model", "nrmse"))
    first = audit.guarded_write(rows, path)
    again = audit.guarded_write(rows, path)
    rows.withColumn("nrmse", F.col("nrmse") + 1).write.mode("overwrite").parquet(path)  # another producer
    try:
        audit.guarded_write(rows, path)
        refused = False
    except FileExistsError:
        refused = True
    forced = audit.guarded_write(rows, path, allow_overwrite=True)
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(first == again).alias("same_fingerprint"), F.lit(refused).alias("collision_refused"), F.lit(forced == first).alias("forced_restores"))


@query("X5 J13", q.select(_R, "SELECT * FROM (VALUES ('same', 'IDENTICAL'), ('ulp', 'EQUAL-TOL'), ('moved', 'DIFFERS'), ('short', 'DIFFERS')) v(version, status)"))
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table against four rebuilds of it."""
    base = cell_results(spark, sf_dir).select(*CELL, "model", *[r(c, 9).alias(c) for c in ("nrmse", "rmse", "mae")])
    versions = {"same": base, "ulp": base.withColumn("nrmse", F.col("nrmse") * (1 + 1e-12)),
                "moved": base.withColumn("mae", F.when(F.col("seed") == 3, F.col("mae") * 1.01).otherwise(F.col("mae"))),
                "short": base.where("seed <> 3")}
    out = None
    for name, v in versions.items():
        got = audit.diff_tables(v, base, [*CELL, "model"]).select(F.lit(name).alias("version"), "status")
        out = got if out is None else out.unionByName(got)
    return out


@query("X6", q.select(_R, "SELECT 'nrmse' AS column_name, round(max(nrmse * seed * 0.001), 9) AS max_abs, round(max(seed * 0.001), 9) AS max_rel, FALSE AS near_zero FROM results UNION ALL SELECT 'mae', round(max(mae * 1e-3), 9), 0.001, FALSE FROM results "
                          "UNION ALL SELECT 'noise', 0.0::DOUBLE, NULL, TRUE"))
def column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst drift per column; a column of numerical zeros is told apart."""
    base = cell_results(spark, sf_dir).select(*CELL, "model", "nrmse", "mae", F.lit(1e-13).alias("noise"))
    new = base.select(*CELL, "model", (F.col("nrmse") * (1 + F.col("seed") * 0.001)).alias("nrmse"), (F.col("mae") * 1.001).alias("mae"), F.lit(3e-13).alias("noise"))
    got = audit.column_drift(base, new, [*CELL, "model"])
    return got.select("column_name", r("max_abs", 9).alias("max_abs"), r("max_rel", 9).alias("max_rel"), "near_zero")


@query("X7 D5", q.select(f"{_R}, {_MATRIX}, j AS (SELECT c.*, r.nrmse FROM cells c JOIN results r USING (series_id, seed, model))",
       "SELECT CAST(count_if(NOT (model = 'persistence' AND seed < 3) AND NOT (seed = 5 AND model = 'drift')) AS BIGINT) AS executed, CAST(count_if(model = 'persistence' AND seed < 3) AS BIGINT) AS skipped, CAST(count_if(seed = 5 AND model = 'drift') AS BIGINT) AS failed FROM j"))
def incremental_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished cells skipped, failing cells kept as rows, the others run."""
    work = cell_matrix(spark, sf_dir).join(cell_results(spark, sf_dir).select(*CELL, "model", "nrmse"), [*CELL, "model"])
    done = work.where("model = 'persistence' AND seed < 3")

    def run_one(cell):
        if cell["model"] == "drift" and cell["seed"] == 5:
            raise RuntimeError("simulated interruption")
        return {"score": cell["nrmse"] * 2}

    results = audit.run_cells(work, done, [*CELL, "model"], run_one, "score double", retries=1)
    return audit.sweep_summary(work, results)


@query("X8", q.select(f"{q.USER}", "SELECT series_id, count(*) AS n_rows, round(sum(x * x) / 1000, 6) AS energy FROM series GROUP BY 1"))
def feature_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features stored by content key: the second request computes only what is missing."""
    store = scratch(spark)
    panel = panel_by_user(spark, sf_dir).withColumn("feature_key", F.concat(F.lit("k"), (F.xxhash64("series_id") % 4 + 4).cast("string")))
    features = lambda rows: rows.select("feature_key", "series_id", "t", (F.col("x") * F.col("x")).alias("f"))
    audit.read_through(panel.where("feature_key < 'k4'"), store, "feature_key", features)
    full = audit.read_through(panel, store, "feature_key", features)
    return full.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("f") / 1000).alias("energy"))


@query("X8", q.select(f"{q.USER}", "SELECT 'k' || right(series_id, 1) AS feature_key, count(*) AS n_rows, round(sum(x * x) / 1000, 6) AS energy, "
                                   "CASE WHEN right(series_id, 1) IN ('3', '5') THEN 2 ELSE 1 END AS times_computed FROM series GROUP BY 1, 4"))
def damaged_feature_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored entry loses rows and one gets wrong values; both are computed again, the others read."""
    store = scratch(spark)
    panel = panel_by_user(spark, sf_dir).withColumn("feature_key", F.concat(F.lit("k"), F.right("series_id", F.lit(1))))
    features = lambda rows: rows.select("feature_key", "series_id", "t", (F.col("x") * F.col("x")).alias("f"))
    audit.read_through(panel, store, "feature_key", features)
    for key, damage in (("k3", lambda rows: rows.where("t > 0")), ("k5", lambda rows: rows.withColumn("f", F.col("f") + 1))):
        entry = f"{store}/data/feature_key={key}"
        durable(damage(spark.read.parquet(entry))).write.mode("overwrite").parquet(entry)
    full = audit.read_through(panel, store, "feature_key", features)
    times = spark.read.parquet(f"{store}/digests").groupBy("feature_key").agg(F.count(F.lit(1)).alias("times_computed"))
    found = full.groupBy("feature_key").agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("f") / 1000).alias("energy"))
    return found.join(times, "feature_key").select("feature_key", "n_rows", "energy", "times_computed")


def _json_sql(pairs) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {e}""" for k, e in sorted(pairs)) + " || '}'"


_NUM = lambda c: f"""'"' || format('{{:.12g}}', {c}::DOUBLE) || '"'"""
_TXT = lambda c: f"""'"' || {c} || '"'"""
_FEATURE_KEY = [("n_points", "n_points"), ("scaler", _TXT("scaler")), ("scaler_scope", _TXT("scaler_scope")), ("system", _TXT("system")),
                ("split_fracs", "'[' || " + " || ',' || ".join(_NUM(f"f{i}") for i in range(3)) + " || ']'"), ("contract", "'\"fkey/v1\"'")]


@query("C6", q.select(CONFIG_SQL, f"SELECT config_id, {_json_sql([('alpha', _NUM('alpha')), ('encode_scale', _NUM('encode_scale')), ('system', _TXT('system')), ('horizon', 'horizon')])} AS payload FROM configs"))
def canonical_config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"alpha": (F.col("alpha").cast("double"), "float"), "encode_scale": (F.col("encode_scale").cast("double"), "float"),
              "system": (F.col("system"), "text"), "horizon": (F.col("horizon"), "number")}
    return configs(spark, sf_dir).select("config_id", tx.canonical_json(fields).alias("payload"))


@query("C7", q.select(CONFIG_SQL, f"SELECT config_id, substr(sha256({_json_sql([('alpha', _NUM('alpha')), ('scaler', _TXT('scaler')), ('washout', 'washout')])}), 1, 16) AS fingerprint FROM configs"))
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"alpha": (F.col("alpha").cast("double"), "float"), "scaler": (F.col("scaler"), "text"), "washout": (F.col("washout"), "number")}
    return configs(spark, sf_dir).select("config_id", tx.fingerprint(tx.canonical_json(fields)).alias("fingerprint"))


@query("C8", "WITH " + q.USER + " SELECT series_id, substr(sha256(count(*) || ':' || CAST(sum(('0x' || substr(sha256(t || '|' || CAST(x AS VARCHAR)), 1, 15))::BIGINT) AS VARCHAR)), 1, 16) AS checksum FROM series GROUP BY 1")
def series_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content checksum of each series from per-row digests that add up in any order."""
    return tx.content_checksum(panel_by_user(spark, sf_dir), ["series_id"], [F.col("t").cast("string"), F.col("x").cast("string")])


@query("X9", q.select(CONFIG_SQL, f"SELECT config_id, substr(sha256({_json_sql(_FEATURE_KEY)}), 1, 16) AS feature_key FROM configs"))
def feature_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what shapes the features is in the key: horizon, washout and penalty are not."""
    fields = {"contract": (F.lit("fkey/v1"), "text"), "n_points": (F.col("n_points"), "number"), "scaler": (F.col("scaler"), "text"),
              "scaler_scope": (F.col("scaler_scope"), "text"), "system": (F.col("system"), "text"), "split_fracs": (F.col("split_fracs"), "floats")}
    return configs(spark, sf_dir).select("config_id", tx.fingerprint(tx.canonical_json(fields)).alias("feature_key"))


@query("X10", q.select(_REG, "SELECT series_id, seed, model, dataset_id, split_id, split_hash, configuration_id, dataset_hash FROM w"))
def run_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_runs(spark, sf_dir).select(*CELL, "model", "dataset_id", "split_id", "split_hash", "configuration_id", "dataset_hash")


@query("X11", "WITH meta AS (SELECT * FROM (VALUES ('view', 'page', 1.0), ('click', 'page', 0.5), ('signup', 'account', 2.0), ('error', 'system', 0.1), ('purchase', 'account', 5.0)) v(system, method, step)) "
              "SELECT event_type AS system, method, round(step::DOUBLE, 6) AS time_step, count(*) AS sample_count FROM events JOIN meta ON event_type = system GROUP BY 1, 2, 3")
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known about each system, looked up from a fixed five-row list."""
    meta = spark.createDataFrame([("view", "page", 1.0), ("click", "page", 0.5), ("signup", "account", 2.0), ("error", "system", 0.1), ("purchase", "account", 5.0)],
                                 "system string, method string, time_step double")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system")).agg(F.count(F.lit(1)).alias("sample_count"))
    return rows.join(meta, "system").select("system", "method", "time_step", "sample_count")


@query("X13", q.select(_R, "SELECT series_id, count(*) AS n_runs, round(avg(nrmse), 6) AS nrmse_mean, count(DISTINCT (seed, model)) = count(*) AS ids_match, "
                           "count(nrmse) = count(*) AS hashes_match, count(nrmse) = count(*) AS scores_identical FROM results GROUP BY 1"))
def reproducibility_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study run twice, cut over different numbers of partitions: ids, content hashes
    and rounded scores must agree."""
    def run(parts: int) -> DataFrame:
        name = "spark.sql.shuffle.partitions"
        usual = spark.conf.get(name)
        spark.conf.set(name, str(parts))
        try:
            return durable(wide_runs(spark, sf_dir).select(*CELL, "model", "configuration_id", "dataset_hash", r("nrmse", 9).alias("nrmse")))
        finally:
            spark.conf.set(name, usual)

    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = run(usual), run(usual + 5).withColumnsRenamed({"configuration_id": "c2", "dataset_hash": "h2", "nrmse": "s2"})
    return a.join(b, [*CELL, "model"]).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_runs"), r(F.avg("nrmse")).alias("nrmse_mean"), F.bool_and(F.col("configuration_id") == F.col("c2")).alias("ids_match"),
        F.bool_and(F.col("dataset_hash") == F.col("h2")).alias("hashes_match"), F.bool_and(F.col("nrmse") == F.col("s2")).alias("scores_identical"))


_FAULTS = (("unknown column", "(SELECT count(*) FROM runs)"), ("NaN score", "(SELECT count(*) FROM metrics)"), ("duplicate run id", "(SELECT count(*) FROM runs)"),
           ("overlapping split", "(SELECT count(*) FROM splits)"), ("invalid configuration", "(SELECT CAST(sum(" + " + ".join(f"CASE WHEN {c} THEN 0 ELSE 1 END" for c in _CONFIG_RULES.values()) + ") AS BIGINT) FROM configs)"),
           ("interrupted run", "(SELECT count(*) FROM runs WHERE seed = 2)"), ("overwritten result", "(SELECT count(*) FROM metrics WHERE nrmse <> 0.5)"), ("non-finite truth", "(SELECT count(*) FROM forecasts)"))


@query("X14", q.select(f"{_REG}, {CONFIG_SQL}", " UNION ALL ".join(f"SELECT '{n}' AS fault, {c} AS caught, {c} > 0 AS detected" for n, c in _FAULTS)))
def fault_injection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight faults put into real rows; each must be caught before results are reached."""
    runs = durable(wide_runs(spark, sf_dir))
    frames = registry_frames(spark, sf_dir, runs)
    checks = {}
    try:
        contracts.conform("runs", frames["runs"].withColumn("bogus", F.lit(1)))
        unknown = 0
    except ValueError:
        unknown = frames["runs"].count()
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("caught")).withColumn("fault", F.lit(name))
    parts = [runs.agg(F.lit(unknown).cast("long").alias("caught")).withColumn("fault", F.lit("unknown column"))]
    bad_score = frames["metrics"].withColumn("nrmse", F.lit(float("nan")))
    parts.append(counted(contracts.violations(bad_score, contracts.registry_rules("metrics"), "run_id"), "NaN score"))
    twice = frames["runs"].unionByName(frames["runs"])
    parts.append(counted(contracts.duplicates(twice, "run_id"), "duplicate run id"))
    parts.append(counted(split_order_violations(frames["splits"].withColumn("validation_start", F.col("train_end") - 1)), "overlapping split"))
    parts.append(counted(contracts.violations(configs(spark, sf_dir), contracts.config_rules(), "config_id"), "invalid configuration"))
    work = runs.select(*CELL, "model", "nrmse")

    def run_one(cell):
        if cell["seed"] == 2:
            raise RuntimeError("simulated interruption")
        return {"score": cell["nrmse"]}

    swept = audit.run_cells(work, work.where("seed = 0"), [*CELL, "model"], run_one, "score double")
    parts.append(counted(swept.where("status = 'failed'"), "interrupted run"))
    clobbered = work.withColumn("nrmse", F.lit(0.5))
    changed = audit.diff_cells(clobbered, work, [*CELL, "model"]).where("a <> b")
    parts.append(counted(changed, "overwritten result"))
    blown = cell_forecasts(spark, sf_dir).withColumn("y_true", F.lit(float("inf")))
    parts.append(counted(contracts.violations(blown, contracts.forecast_rules(), [*CELL, "model", "t"]), "non-finite truth"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("fault", "caught", (F.col("caught") > 0).alias("detected"))


def level_sql(levels) -> str:
    """CTEs up to ``scored``: every level of at most two features fitted by Cramer's rule, test rows."""
    keys, ctes, union = "series_id, seed", [q.CELLS], []
    params = {"minmax": ("min(x)", "max(x) - min(x)"), "standard": ("avg(x)", "stddev_pop(x)"), "identity": ("0.0", "1.0"),
              "robust": ("quantile_cont(x, 0.5)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")}
    for i, x in enumerate(levels):
        shift, scale = params[x.scaler]
        seen = "TRUE" if x.scope == "global" else f"t >= {x.washout} AND t < te"
        leak, train = lattice.leak_of(x.postprocess), f"t >= {max(x.washout, x.lookback - 1)} AND t < te - {x.horizon}"
        shape = {"none": "{d}", "zscore": f"({{d}} - avg(CASE WHEN {train} THEN {{d}} END) OVER k) / stddev_pop(CASE WHEN {train} THEN {{d}} END) OVER k"}.get(
            x.postprocess, f"pow({1 - (leak or 0)}, t) * sum({leak} * {{d}} * pow({1 - (leak or 0)}, -t)) OVER (k ORDER BY t)")
        if x.encoding is not None:
            shape = f"cos({x.encoding} * pi() * {{d}})"
        f0, f1 = shape.format(d="d0"), shape.format(d="d1") if x.lookback > 1 else "0.0"
        ctes += [f"b{i} AS (SELECT {keys}, count(*) AS n, floor({x.split[0]}::DOUBLE * count(*)) AS te, floor({x.split[0] + x.split[1]!r}::DOUBLE * count(*)) AS ve FROM series GROUP BY ALL)",
                 f"p{i} AS (SELECT {keys}, n, te, ve, {shift} AS a, {scale} AS s FROM series JOIN b{i} USING ({keys}) WHERE {seen} GROUP BY ALL)",
                 f"u{i} AS (SELECT {keys}, t, n, te, ve, (x - a) / s AS d0 FROM series JOIN p{i} USING ({keys}))",
                 f"w{i} AS (SELECT *, coalesce(lag(d0) OVER k, d0) AS d1, lead(d0, {x.horizon}) OVER k AS y FROM u{i} WINDOW k AS (PARTITION BY {keys} ORDER BY t))"]
        union.append(f"SELECT '{x.axis}' AS axis, '{x.level}' AS level, '{x.scope}' AS scope, {keys}, {x.alpha!r}::DOUBLE AS alpha, {f0} AS f0, {f1} AS f1, y, "
                     f"CASE WHEN {train} THEN 'train' WHEN t >= ve AND t < n - {x.horizon} THEN 'test' END AS part FROM w{i} WINDOW k AS (PARTITION BY {keys})")
    g = [["g00", "g01", "g02"], ["g01", "g11", "g12"], ["g02", "g12", "g22"]]
    col = lambda k: [[("b" + str(i)) if j == k else g[i][j] for j in range(3)] for i in range(3)]
    by = f"axis, level, scope, {keys}"
    ctes += [f"feats AS ({' UNION ALL '.join(union)})",
             f"sums AS (SELECT {by}, sum(f0*f0) + alpha AS g00, sum(f0*f1) AS g01, sum(f0) AS g02, sum(f1*f1) + alpha AS g11, sum(f1) AS g12, count(*) + alpha AS g22, "
             f"sum(f0*y) AS b0, sum(f1*y) AS b1, sum(y) AS b2 FROM feats WHERE part = 'train' GROUP BY {by}, alpha)",
             f"weights AS (SELECT {by}, {_det(col(0))}/{_det(g)} AS w0, {_det(col(1))}/{_det(g)} AS w1, {_det(col(2))}/{_det(g)} AS w2 FROM sums)",
             f"scored AS (SELECT {by}, count(*) AS n_rows, sqrt(avg((w0*f0 + w1*f1 + w2 - y)^2)) AS rmse, sqrt(avg((w0*f0 + w1*f1 + w2 - y)^2)) / stddev_pop(y) AS nrmse "
             f"FROM feats JOIN weights USING ({by}) WHERE part = 'test' GROUP BY {by})"]
    return ", ".join(ctes)


# one level of each axis that a fit of two features can show
SHOWN = lattice.axis_levels({"scaler": ("standard", "robust", "identity"), "scope": ("global",), "split": ((0.8, 0.1, 0.1),), "washout": (50,), "lookback": (1,),
                             "horizon": (3,), "alpha": (0.01,), "postprocess": ("leaky0.3", "zscore"), "encoding": (1.5,)})


@query("X15", q.select(level_sql(SHOWN), "SELECT series_id, seed, axis, level, n_rows, round(rmse, 6) AS rmse, round(nrmse, 6) AS nrmse FROM scored"))
def axis_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level of every axis, scored per series and seed from sums of products, where both train and
    test rows are left."""
    got = lattice.sweep(panel_cells(spark, sf_dir), SHOWN, CELL).where("rmse IS NOT NULL")
    return got.select(*CELL, "axis", "level", "n_rows", r("rmse").alias("rmse"), r("nrmse").alias("nrmse"))


@query("X15")
def configuration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset level of all ten axes over all seeds: test score per level."""
    panel = durable(panel_cells(spark, sf_dir))
    moved = {axis: levels for axis, levels in AXIS_LEVELS.items() if axis != "windowing"}
    scores = lattice.sweep(panel, lattice.axis_levels(moved), CELL).select("axis", "level", "nrmse")
    scores = scores.unionByName(windowing_scores(panel))
    return scores.groupBy("axis", "level").agg(
        F.avg("nrmse").alias("mean"), F.stddev_samp("nrmse").alias("std"), F.min("nrmse").alias("min"), F.max("nrmse").alias("max"))


def windowing_scores(panel: DataFrame, taps: int = 3) -> DataFrame:
    """axis, level, nrmse of the recurrent model fed by the series alone (its memory is its state)
    or by shared delay vectors."""
    labelled = label_split(panel, split_bounds(panel, CELL, washout=20), CELL)
    scaled = scale(labelled, fit_scaler(labelled, "minmax", CELL), CELL)
    rows = durable(delays(scaled, taps, 1, 1, CELL, column="u"))
    out = None
    for level, columns in (("internal", ("u",)), ("shared", tuple(f"d{j}" for j in range(taps)))):
        got = metrics.score(reservoir_forecasts(rows, [0], keys=CELL, columns=columns), list(CELL)).select(
            F.lit("windowing").alias("axis"), F.lit(level).alias("level"), "nrmse")
        out = got if out is None else out.unionByName(got)
    return out


LEAKAGE = lattice.leakage_levels(AXIS_LEVELS["scope"], AXIS_LEVELS["split"], (1e-8, 1e-6, 1e-4, 1e-2))


@query("X16", q.select(level_sql(LEAKAGE), "SELECT series_id, seed, round(avg(CASE WHEN scope = 'train' THEN nrmse END), 6) AS train_scope, "
       "round(avg(CASE WHEN scope = 'global' THEN nrmse END), 6) AS global_scope, round(avg(CASE WHEN scope = 'global' THEN nrmse END) / avg(CASE WHEN scope = 'train' THEN nrmse END), 6) AS global_over_train, "
       "round(max(nrmse) / min(nrmse), 6) AS artifact_ratio FROM scored WHERE axis = 'leakage' GROUP BY 1, 2"))
def leakage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope x split x penalty x seed, test rows, summarised as the leakage study does."""
    test = lattice.sweep(panel_cells(spark, sf_dir), LEAKAGE, CELL).where("axis = 'leakage' AND rmse IS NOT NULL")
    mean = lambda s: F.avg(F.when(F.col("scope") == s, F.col("nrmse")))
    return test.groupBy(*CELL).agg(r(mean("train")).alias("train_scope"), r(mean("global")).alias("global_scope"),
                                   r(mean("global") / mean("train")).alias("global_over_train"), r(F.max("nrmse") / F.min("nrmse")).alias("artifact_ratio"))


_SEG = (f"{q.CELLS}, {q.bounds('series_id, seed', 3)}, {q.labelled('series_id, seed')}, {q.lagged(3, keys='series_id, seed')}, "
        "params AS (SELECT series_id, seed, avg(CASE WHEN in_fit THEN x END) AS mu, (max(CASE WHEN t = train_end - 1 THEN x END) - max(CASE WHEN t = 0 THEN x END)) / max(train_end - 1) AS slope FROM labelled GROUP BY 1, 2), "
        "base AS (SELECT l.*, mu, slope, CASE WHEN t >= val_end THEN 'test' WHEN t >= train_end AND t < val_end - 1 THEN 'validation' END AS part FROM lagged l JOIN params USING (series_id, seed) WHERE y IS NOT NULL), "
        "f AS (SELECT series_id, seed, part, 'persistence' AS model, y, d0 AS p FROM base UNION ALL SELECT series_id, seed, part, 'train_mean', y, mu FROM base UNION ALL SELECT series_id, seed, part, 'moving_average', y, (d0+d1+d2)/3 FROM base "
        "UNION ALL SELECT series_id, seed, part, 'drift', y, d0 + slope FROM base), sc AS (SELECT series_id, seed, model, part, sqrt(avg((p-y)^2))/stddev_pop(y) AS nrmse FROM f WHERE part IS NOT NULL GROUP BY 1, 2, 3, 4)")


@query("X17 L4", q.select(_SEG, "SELECT v.series_id, v.seed, v.model, round(v.nrmse, 6) AS validation_nrmse, round(t.nrmse, 6) AS test_nrmse FROM (SELECT * FROM sc WHERE part = 'validation' QUALIFY row_number() OVER (PARTITION BY series_id, seed ORDER BY nrmse, model) = 1) v "
                             "JOIN sc t ON t.part = 'test' AND v.series_id = t.series_id AND v.seed = t.seed AND v.model = t.model"))
def choice_on_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with the best validation score, reported on test."""
    panel = panel_cells(spark, sf_dir)
    scored = lambda seg: metrics.score(baseline_forecasts(panel, CELL, washout=3, segment=seg), [*CELL, "model"]).select(*CELL, "model", "nrmse")
    best = scored("validation").groupBy(*CELL).agg(F.min(F.struct("nrmse", "model")).alias("b"))
    chosen = best.select(*CELL, F.col("b.model").alias("model"), F.col("b.nrmse").alias("v"))
    return chosen.join(scored("test"), [*CELL, "model"]).select(*CELL, "model", r("v").alias("validation_nrmse"), r("nrmse").alias("test_nrmse"))


@query("X17")
def tuned_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-back and penalty chosen per series on validation, reported on test."""
    grid = durable(linear_grid(panel_by_type(spark, sf_dir), lookbacks=AXIS_LEVELS["lookback"], alphas=AXIS_LEVELS["alpha"]))
    best = grid.where("segment = 'validation'").groupBy("series_id").agg(F.min(F.struct("nrmse", "lookback", "alpha")).alias("b"))
    chosen = best.select("series_id", "b.lookback", "b.alpha", F.col("b.nrmse").alias("validation_nrmse"))
    return chosen.join(grid.where("segment = 'test'").select("series_id", "lookback", "alpha", F.col("nrmse").alias("test_nrmse")), ["series_id", "lookback", "alpha"])


@query("X18", q.select(_R, "SELECT 'smoother beats persistence' AS key, CAST(count_if(a < b) AS VARCHAR) || '/' || count(*) AS value, 'most cells' AS expected FROM (SELECT max(CASE WHEN model = 'moving_average' THEN nrmse END) AS a, max(CASE WHEN model = 'persistence' THEN nrmse END) AS b FROM results GROUP BY series_id, seed) "
       "UNION ALL SELECT 'median ratio', format('{:.1f}x', median(a / b)), 'below 1.0x' FROM (SELECT max(CASE WHEN model = 'moving_average' THEN nrmse END) AS a, max(CASE WHEN model = 'persistence' THEN nrmse END) AS b FROM results GROUP BY series_id, seed) "
       "UNION ALL SELECT 'failed runs', CAST(count_if(nrmse > 1.5) AS VARCHAR) || '/' || count(*), 'few' FROM results"))
def claim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named numbers as key, value and expected text."""
    rows = cell_results(spark, sf_dir)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("nrmse")))
    pairs = rows.groupBy(*CELL).agg(pick("moving_average").alias("a"), pick("persistence").alias("b"))
    share = lambda cond: F.concat(F.count_if(cond).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
    mid = exact_quantiles(pairs.select(F.lit(1).alias("all"), (F.col("a") / F.col("b")).alias("ratio")), ["all"], "ratio", {"m": 0.5})
    claim = lambda df, key, value, expected: df.agg(value.alias("value")).select(F.lit(key).alias("key"), "value", F.lit(expected).alias("expected"))
    return (claim(pairs, "smoother beats persistence", share(F.col("a") < F.col("b")), "most cells")
            .unionByName(claim(mid, "median ratio", F.format_string("%.1fx", F.max("m")), "below 1.0x"))
            .unionByName(claim(rows, "failed runs", share(F.col("nrmse") > 1.5), "few")))
