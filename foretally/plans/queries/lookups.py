"""Join, window, ranking, set and scalar-function queries."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretally.functions import text as tx
from foretally.operators import tallies
from foretally.operators.blocks import number_rows
from foretally.operators.quantiles import exact_quantiles
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, MODELS, cell_results, registry_frames, user_results, wide_runs
from foretally.plans.queries import sqltext as q
from foretally.session import durable
from foretally.sources.files import replace_model_rows
from foretally.sources.tables import panel_by_type, panel_by_user, table

_REG, _R, _UR = q.REGISTRY, q.CELL_RESULTS, q.USER_RESULTS


@query("J1", q.select(_REG, "SELECT d.system, r.model, r.seed, round(m.nrmse, 6) AS nrmse FROM runs r JOIN datasets d USING (dataset_id) JOIN metrics m USING (run_id)"))
def runs_with_datasets_and_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = registry_frames(spark, sf_dir)
    return f["runs"].join(f["datasets"], "dataset_id").join(f["metrics"], "run_id").select("system", "model", "seed", r("nrmse").alias("nrmse"))


_FULL = "runs r JOIN datasets d USING (dataset_id) JOIN splits s USING (split_id) JOIN metrics m USING (run_id)"


@query("J2", q.select(_REG, f"SELECT run_id, d.system, d.dataset_hash, split_id, s.scaler_fit_range, r.model, r.configuration_id, r.seed, r.git_commit, round(m.nrmse, 6) AS nrmse FROM {_FULL} "
                            "WHERE r.model = 'drift' AND r.seed = 3"))
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset, split, configuration and score of chosen runs; the filter meets one table."""
    f = registry_frames(spark, sf_dir)
    wanted = f["runs"].where("model = 'drift' AND seed = 3").drop("dataset_id")
    return (wanted.join(f["splits"], "split_id").join(f["datasets"], "dataset_id").join(f["metrics"], "run_id")
            .select("run_id", "system", "dataset_hash", "split_id", "scaler_fit_range", "model", "configuration_id", "seed", "git_commit", r("nrmse").alias("nrmse")))


@query("J3", q.select(_REG, f"SELECT run_id, r.model, r.status, split_id, s.train_end, s.test_start, s.test_end, s.split_hash, d.system, d.random_seed, d.sample_count, d.dataset_hash, round(m.nrmse, 6) AS nrmse, round(m.mae, 6) AS mae FROM {_FULL}"))
def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a run to its metric, split and dataset, with the columns of all four tables."""
    f = registry_frames(spark, sf_dir)
    got = f["runs"].drop("dataset_id").join(f["metrics"], "run_id").join(f["splits"], "split_id").join(f["datasets"], "dataset_id")
    return got.select("run_id", "model", "status", "split_id", "train_end", "test_start", "test_end", "split_hash", "system", "random_seed", "sample_count", "dataset_hash",
                      r("nrmse").alias("nrmse"), r("mae").alias("mae"))


@query("J4", q.select(_REG, "SELECT r.model, count(*) AS n_runs, CAST(count_if(s.scaler_fit_range = 'global') AS BIGINT) AS unsafe, CAST(count_if(s.split_id IS NULL) AS BIGINT) AS no_split "
                            "FROM runs r LEFT JOIN (SELECT s.* FROM splits s JOIN datasets d USING (dataset_id) WHERE d.random_seed <> 2) s ON r.split_id = s.split_id GROUP BY 1"))
def scope_audit_with_missing_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose split row is missing stay in the audit."""
    f = registry_frames(spark, sf_dir)
    known = f["splits"].join(f["datasets"].where("random_seed <> 2").select("dataset_id"), "dataset_id").select("split_id", "scaler_fit_range", F.lit(True).alias("known"))
    return f["runs"].join(known, "split_id", "left").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("scaler_fit_range") == "global").alias("unsafe"), F.count_if(F.col("known").isNull()).alias("no_split"))


def cell_matrix(spark, sf_dir) -> DataFrame:
    """series x seed x model: each series row is expanded by the fixed seed and model lists."""
    series = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id")).distinct()
    seeds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("seed")
    return series.select("series_id", seeds).select("*", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))


_MATRIX = "cells AS (SELECT DISTINCT event_type AS series_id, s.seed, m.model FROM events CROSS JOIN (SELECT unnest(range(0, 7)) AS seed) s CROSS JOIN (SELECT unnest(['" + "', '".join(MODELS) + "']) AS model) m)"


@query("J12", q.select(_MATRIX, "SELECT series_id, seed, model FROM cells"))
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_matrix(spark, sf_dir)


@query("J5", q.select(f"{_R}, {_MATRIX}", "SELECT c.* FROM cells c ANTI JOIN (SELECT * FROM results WHERE nrmse < 1.2) d ON c.series_id = d.series_id AND c.seed = d.seed AND c.model = d.model"))
def unfinished_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the matrix without a good enough result yet."""
    done = cell_results(spark, sf_dir).where("nrmse < 1.2")
    return cell_matrix(spark, sf_dir).join(done, [*CELL, "model"], "left_anti")


@query("U5", q.select(f"{_R}, {_MATRIX}", "SELECT series_id, seed FROM cells EXCEPT SELECT series_id, seed FROM results WHERE nrmse > 1.45"))
def keys_minus_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_matrix(spark, sf_dir).select(*CELL).subtract(cell_results(spark, sf_dir).where("nrmse > 1.45").select(*CELL))


@query("J6", q.select(_UR, "SELECT model, count(*) AS clashes FROM results a SEMI JOIN (SELECT CAST(user_id AS VARCHAR) AS series_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 14) b ON a.series_id = b.series_id GROUP BY 1"))
def clashing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a batch (users with many errors) that the table holds already."""
    batch = (table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("series_id"))
             .agg(F.count(F.lit(1)).alias("n")).where("n > 14"))
    return user_results(spark, sf_dir).join(batch, "series_id", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("clashes"))


@query("J7", q.select(_R, "SELECT series_id, n_test AS size, seed, round(max(CASE WHEN model = 'moving_average' THEN nrmse END), 6) AS first_score, round(max(CASE WHEN model = 'train_mean' AND nrmse < 1.01 THEN nrmse END), 6) AS second_score "
                          "FROM results GROUP BY 1, 2, 3 HAVING max(CASE WHEN model = 'train_mean' AND nrmse < 1.01 THEN nrmse END) IS NOT NULL"))
def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models side by side; keys that lack the second are dropped."""
    rows = cell_results(spark, sf_dir).where("model <> 'train_mean' OR nrmse < 1.01").withColumnRenamed("n_test", "size")
    wide = rows.groupBy("series_id", "size", "seed").pivot("model", ["moving_average", "train_mean"]).agg(F.max("nrmse"))
    return wide.dropna(subset=["train_mean"]).select("series_id", "size", "seed", r("moving_average").alias("first_score"), r("train_mean").alias("second_score"))


@query("J9", q.select(_R, "SELECT series_id, seed, model, round(nrmse, 6) AS nrmse_old, round(nrmse * (1 + seed * 0.001), 6) AS nrmse_new, round(abs(nrmse * (1 + seed * 0.001) - nrmse), 6) AS abs_diff FROM results"))
def old_against_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuilt score table (drifting with the seed) against the old one, on the key."""
    old = cell_results(spark, sf_dir).select(*CELL, "model", F.col("nrmse").alias("a"))
    new = cell_results(spark, sf_dir).select(*CELL, "model", (F.col("nrmse") * (1 + F.col("seed") * 0.001)).alias("b"))
    return old.join(new, [*CELL, "model"]).select(*CELL, "model", r("a").alias("nrmse_old"), r("b").alias("nrmse_new"), r(F.abs(F.col("b") - F.col("a"))).alias("abs_diff"))


# fixed values: path prefixes and what produces the files below them
PRODUCERS = (("ECONOMY", "bulk"), ("ECONOMY ANODIZED", "anodizer"), ("PROMO", "promotions"), ("STANDARD", "standard line"),
             ("STANDARD POLISHED", "polisher"), ("STANDARD POLISHED TIN", "tin shop"), ("LARGE", "large line"), ("MEDIUM", "medium line"), ("SMALL", "small line"))


@query("J14", "WITH pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PRODUCERS) + ") v(prefix, producer)) "
              "SELECT p_partkey, arg_max(producer, length(prefix)) AS producer FROM part LEFT JOIN pr ON starts_with(p_type, prefix) GROUP BY 1")
def longest_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part type's producer by its longest known prefix.

    The prefix list is fixed, so a row is cut at each listed length and looked up: an
    equality per candidate instead of a join on a condition.
    """
    lookup = F.create_map(*[F.lit(v) for pair in PRODUCERS for v in pair])
    lengths = sorted({len(p) for p, _ in PRODUCERS}, reverse=True)
    hit = F.coalesce(*[F.try_element_at(lookup, F.substring("p_type", 1, n)) for n in lengths])
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("producer"))


@query("W1 L2", q.select(_R, "SELECT row_number() OVER (ORDER BY avg(nrmse), model) AS rank, model, round(avg(nrmse), 6) AS nrmse_mean, round(stddev_pop(nrmse), 6) AS nrmse_std, count(*) AS n_runs FROM results GROUP BY model ORDER BY rank"))
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tallies.leaderboard(cell_results(spark, sf_dir))
    return got.select("rank", "model", r("nrmse_mean").alias("nrmse_mean"), r("nrmse_std").alias("nrmse_std"), "n_runs").orderBy("rank")


@query("W4", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last appended row of each key, as a max over structs: no sort, partial maxima."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id", r("m.value").alias("value"))


@query("W7", q.select(_R, "SELECT series_id, n_test AS size, seed, model, nrmse = min(nrmse) OVER (PARTITION BY series_id, n_test) AS best FROM results"))
def best_in_group_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cell_results(spark, sf_dir)
    best = rows.groupBy("series_id", "n_test").agg(F.min("nrmse").alias("low"))
    return rows.join(best, ["series_id", "n_test"]).select("series_id", F.col("n_test").alias("size"), "seed", "model", (F.col("nrmse") == F.col("low")).alias("best"))


@query("L1", q.select(_R, "SELECT row_number() OVER (ORDER BY CASE model WHEN 'drift' THEN 0 WHEN 'moving_average' THEN 1 WHEN 'train_mean' THEN 2 ELSE 3 END, avg(nrmse), series_id) AS position, model, series_id, round(avg(nrmse), 6) AS nrmse FROM results GROUP BY model, series_id"))
def custom_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by a category order of our own, then by score (one row per model and series)."""
    order = F.element_at(F.create_map(*[v for i, m in enumerate(("drift", "moving_average", "train_mean", "persistence")) for v in (F.lit(m), F.lit(i))]), F.col("model"))
    rows = cell_results(spark, sf_dir).groupBy("model", "series_id").agg(F.avg("nrmse").alias("v"))
    # one global order: range partitioned when there are too many rows for one task
    keyed = rows.withColumn("all", F.lit(1)).withColumn("place", order)
    placed = number_rows(keyed, ["all"], ["place", "v", "series_id"], out="position").withColumn("position", F.col("position") + 1)
    return placed.select("position", "model", "series_id", r("v").alias("nrmse")).orderBy("position")


@query("L3", "SELECT event_id, round(value, 6) AS value, round(abs(value - 50.0) / 50.0, 9) AS rel FROM events ORDER BY abs(value - 50.0), event_id LIMIT 10")
def nearest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten values nearest to 50: a top-k, so each task keeps ten rows."""
    gap = F.abs(F.col("value") - 50.0)
    return table(spark, sf_dir, "events").orderBy(gap, "event_id").limit(10).select("event_id", r("value").alias("value"), r(gap / 50.0, 9).alias("rel"))


@query("L5", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 6")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table in the order of its key, as the preview feature shows them."""
    return table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).orderBy("event_id").limit(6)


_TWO = ("WITH " + q.CELLS + ", " + q.forecasts() + ", " + q.results() + ", ua AS (SELECT * FROM (" + q.select(q.USER_RESULTS, "SELECT model, nrmse FROM results") + "))")


@query("U1", _TWO + " SELECT arm, model, count(*) AS n_rows, round(avg(nrmse), 6) AS nrmse FROM (SELECT 'weekday' AS arm, model, nrmse FROM results UNION ALL SELECT 'user', model, nrmse FROM ua) GROUP BY 1, 2")
def union_of_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cell_results(spark, sf_dir).select(F.lit("weekday").alias("arm"), "model", "nrmse")
    b = user_results(spark, sf_dir).select(F.lit("user").alias("arm"), "model", "nrmse")
    return a.unionByName(b).groupBy("arm", "model").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("nrmse")).alias("nrmse"))


@query("U2", q.select(f"{_R}, old AS (SELECT model, avg(nrmse) AS v FROM results WHERE model <> 'drift' GROUP BY 1), new AS (SELECT 'drift' AS model, avg(nrmse) AS v FROM results WHERE model = 'drift')",
       "SELECT row_number() OVER (ORDER BY v, model) AS rank, model, round(v, 6) AS nrmse_mean FROM (SELECT * FROM old UNION ALL SELECT * FROM new)"))
def leaderboard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new model's rows joined to the old board, which is then ranked again."""
    rows = cell_results(spark, sf_dir)
    old = tallies.leaderboard(rows.where("model <> 'drift'")).drop("rank")
    new = tallies.leaderboard(rows.where("model = 'drift'")).drop("rank")
    both = old.unionByName(new).withColumn("rank", F.row_number().over(Window.orderBy("nrmse_mean", "model")))
    return both.select("rank", "model", r("nrmse_mean").alias("nrmse_mean"))


@query("U4", q.select(_REG, "SELECT DISTINCT scaler_fit_range FROM splits"))
def distinct_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_frames(spark, sf_dir)["splits"].select("scaler_fit_range").distinct()


@query("A28 L2", q.select(_REG, "SELECT d.system, r.model, r.model_family, round(median(m.nrmse), 6) AS median_nrmse, count(*) AS n_runs FROM runs r JOIN datasets d USING (dataset_id) JOIN metrics m USING (run_id) "
                             "WHERE r.status = 'success' AND m.nrmse IS NOT NULL GROUP BY 1, 2, 3"))
def best_model_per_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = registry_frames(spark, sf_dir)
    rows = f["runs"].where("status = 'success'").join(f["metrics"].where("nrmse IS NOT NULL"), "run_id").join(f["datasets"], "dataset_id")
    rows, by = durable(rows), ["system", "model", "model_family"]
    middle = exact_quantiles(rows, by, "nrmse", {"m": 0.5})
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"))
    return counted.join(middle, by).select(*by, r("m").alias("median_nrmse"), "n_runs").orderBy("system", "median_nrmse")


@query("A29", q.select(_REG, "SELECT r.model_family, count(*) AS n_runs, count(DISTINCT r.dataset_id) AS n_datasets, round(median(m.nrmse), 6) AS median_nrmse, round(min(m.nrmse), 6) AS best_nrmse FROM runs r JOIN metrics m USING (run_id) WHERE m.nrmse IS NOT NULL GROUP BY 1"))
def runs_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = registry_frames(spark, sf_dir)
    rows = f["runs"].join(f["metrics"].where("nrmse IS NOT NULL"), "run_id")
    got = rows.groupBy("model_family").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("dataset_id").alias("n_datasets"), r(F.min("nrmse")).alias("best_nrmse"))
    # a family's runs grow with the panel: its median comes from counted ranks
    mid = exact_quantiles(rows, ["model_family"], "nrmse", {"m": 0.5})
    return got.join(mid, "model_family").select("model_family", "n_runs", "n_datasets", r("m").alias("median_nrmse"), "best_nrmse").orderBy("median_nrmse")


@query("A30", q.select(_REG, "SELECT s.scaler_fit_range, count(*) AS n_runs FROM runs r JOIN splits s USING (split_id) GROUP BY 1"))
def leakage_scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = registry_frames(spark, sf_dir)
    return f["runs"].join(f["splits"], "split_id").groupBy("scaler_fit_range").agg(F.count(F.lit(1)).alias("n_runs"))


@query("S11", q.select(_R, "SELECT series_id AS system, model, count(*) AS n_rows, round(avg(CASE WHEN model = 'drift' THEN 2 * nrmse ELSE nrmse END), 6) AS nrmse, CAST(count_if(model = 'drift') AS BIGINT) AS noted FROM results GROUP BY 1, 2"))
def replace_rows_of_a_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift rows are dropped and newer ones with one more column put in their place."""
    old = cell_results(spark, sf_dir).select(F.col("series_id").alias("system"), "seed", "model", "nrmse")
    new = old.where("model = 'drift'").withColumn("nrmse", 2 * F.col("nrmse")).withColumn("note", F.lit("rerun"))
    got = replace_model_rows(old, new)
    return got.groupBy("system", "model").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("nrmse")).alias("nrmse"), F.count("note").alias("noted"))


@query("C1", q.select(q.TYPE, "SELECT series_id, t, round(abs(x - 50), 6) AS a, round(sqrt(x), 6) AS b, round(log10(x + 1), 6) AS c, round(tanh(x / 100), 6) AS d, round(cos(x), 6) + 0.0 AS e, "
                              "round(acos(least(greatest(x / 100 - 1, -1), 1)), 6) AS f, CAST(floor(0.6::DOUBLE * t) AS BIGINT) AS g, round(x * x, 4) AS h FROM series"))
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    clip = F.least(F.greatest(x / 100 - 1, F.lit(-1.0)), F.lit(1.0))
    return panel_by_type(spark, sf_dir).select("series_id", "t", r(F.abs(x - 50)).alias("a"), r(F.sqrt(x)).alias("b"), r(F.log10(x + 1)).alias("c"), r(F.tanh(x / 100)).alias("d"),
                                               r(F.cos(x)).alias("e"), r(F.acos(clip)).alias("f"), F.floor(F.lit(0.6) * F.col("t")).cast("long").alias("g"), r(x * x, 4).alias("h"))


@query("C2", "SELECT event_id, abs(value - round(value, 1)) <= 1e-8 + 1e-3 * abs(round(value, 1)) AS near_tenth, value < 100 AS finite FROM events")
def closeness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    wild = F.when(v < 100, v).otherwise(F.lit(float("inf")))
    return table(spark, sf_dir, "events").select("event_id", tx.close_to(v, F.round(v, 1), 1e-8, 1e-3).alias("near_tenth"), tx.is_finite(wild).alias("finite"))


@query("C3", "SELECT p_partkey, regexp_replace(lower(p_brand), '^brand#', '') AS stripped, split_part('a_vs_' || lower(p_type), '_vs_', 2) AS rival, lower(p_type) || '|n=' || p_size || '|' || p_brand AS condition FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace(F.lower("p_brand"), "^brand#", "").alias("stripped"),
        F.split(F.concat(F.lit("a_vs_"), kind), "_vs_")[1].alias("rival"),
        F.concat_ws("|", kind, F.concat(F.lit("n="), F.col("p_size").cast("string")), "p_brand").alias("condition"))


@query("C4", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ', n=' || p_size || ')', '[()=,]', '', 'g'), '[\\s/#-]+', '_', 'g')) AS slug FROM part")
def label_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.format_string("%s (%s, n=%d)", "p_name", "p_brand", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(label).alias("slug"))


@query("C5", "SELECT event_id, format('{:.12g}', value / 7) AS twelve_digits, format('{:.12g}', value * 1e-9) AS small, format('{:.12g}', value * 1e14) AS large, format('{:.12g}', event_id::DOUBLE) AS whole FROM events")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", tx.g12(v / 7).alias("twelve_digits"), tx.g12(v * 1e-9).alias("small"), tx.g12(v * 1e14).alias("large"),
                                                 tx.g12(F.col("event_id").cast("double")).alias("whole"))


@query("C9", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"kind\":\"' || event_type || '\"}' AS packed FROM events")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("kind"))).alias("packed"))


@query("C10", "WITH t AS (SELECT p_partkey, '(' || p_size / 100.0::DOUBLE || ', ' || CASE WHEN p_size % 7 = 0 THEN 'x' ELSE '0.2' END || ', 0.25)' AS txt, p_size FROM part) "
              "SELECT p_partkey, round(p_size / 100.0::DOUBLE, 6) AS f0, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 0.2::DOUBLE END AS f1, 0.25::DOUBLE AS f2, 3 AS n FROM t")
def tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions stored as tuple text; a word among them becomes NULL."""
    middle = F.when(F.col("p_size") % 7 == 0, "x").otherwise("0.2")
    text = F.format_string("(%s, %s, 0.25)", (F.col("p_size") / 100).cast("string"), middle)
    parts = table(spark, sf_dir, "part").select("p_partkey", tx.number_list(text).alias("f"))
    return parts.select("p_partkey", r(F.col("f")[0]).alias("f0"), F.col("f")[1].alias("f1"), F.col("f")[2].alias("f2"), F.size("f").alias("n"))


@query("C11", q.select(_R, "SELECT model, count(*) AS n_runs, count(*) AS n_ids FROM results GROUP BY 1"))
def execution_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random id per finished run, stored before it fans out to the run and metric rows,
    so that both carry the same one."""
    from foretally.session import durable
    runs = durable(cell_results(spark, sf_dir).select(*CELL, "model", "nrmse").withColumn("execution_id", F.uuid()))
    run_rows, metric_rows = runs.select("execution_id", *CELL, "model"), runs.select("execution_id", "nrmse")
    both = run_rows.join(metric_rows, "execution_id")
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("execution_id").alias("n_ids"))


@query("C13", "SELECT vec_id, list_transform(embedding[3:5] || embedding[1:2], lambda v: round(v::DOUBLE, 6)) AS moved, round(list_dot_product(embedding[1:4]::DOUBLE[], embedding[5:8]::DOUBLE[]), 6) + 0.0 AS dot FROM embeddings")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    moved = F.concat(F.slice(e, 3, 3), F.slice(e, 1, 2))
    dot = F.aggregate(F.zip_with(F.slice(e, 1, 4), F.slice(e, 5, 4), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(moved, lambda v: F.round(v, 6)).alias("moved"), r(dot).alias("dot"))
