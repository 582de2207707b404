"""Source and sink queries.  What they write goes to the session's shared folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators import contracts
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, cell_forecasts, cell_results, registry_frames, wide_runs
from foretally.plans.queries import sqltext as q
from foretally.session import checkpoint_folder, durable
from foretally.sources import files, registry
from foretally.sources.tables import table


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder for one query's output."""
    return f"{checkpoint_folder(spark).rstrip('/')}/out-{uuid.uuid4().hex}"


def built_registry(spark: SparkSession, sf_dir: str, tables=("datasets", "splits", "runs", "metrics")) -> str:
    """The registry of the baseline runs on storage; returns its root folder."""
    root = scratch(spark)
    frames = registry_frames(spark, sf_dir, durable(wide_runs(spark, sf_dir)))
    for name in tables:
        registry.append_rows(spark, root, name, frames[name])
    return root


_REG = q.REGISTRY


@query("S1", q.select(_REG, "SELECT 'runs' AS table_name, count(*) AS n_rows, 15 AS n_columns FROM runs UNION ALL SELECT 'splits', 0, 12"))
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table, and one never written: empty, but with the right columns."""
    root = built_registry(spark, sf_dir, ("runs",))
    out = None
    for name in ("runs", "splits"):
        rows = registry.read_table(spark, root, name)
        got = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(rows.columns)).cast("long").alias("n_columns"))
        out = got if out is None else out.unionByName(got)
    return out


@query("S2", "SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice) / 1e6, 4) AS total, CAST(max(o_custkey) AS BIGINT) AS top_cust FROM orders GROUP BY 1")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with inferred types, queried by SQL."""
    path = scratch(spark)
    files.write_as(table(spark, sf_dir, "orders").drop("o_orderdate"), path, "csv")
    files.read_csv(spark, path).createOrReplaceTempView("csv_orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice) / 1e6, 4) AS total, CAST(max(o_custkey) AS BIGINT) AS top_cust FROM csv_orders GROUP BY o_orderpriority")


@query("S3", "SELECT event_type, CAST(count_if(user_id % 3 = 0) AS BIGINT) AS said_none, CAST(count_if(user_id % 3 = 1) AS BIGINT) AS said_nothing, round(sum(CASE WHEN user_id % 3 = 2 THEN value END), 4) AS total FROM events GROUP BY 1")
def csv_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'None' and empty cells stay text; the numbers are cast afterwards."""
    path = scratch(spark)
    k = F.col("user_id") % 3
    cell = F.when(k == 0, "None").when(k == 1, "").otherwise(F.col("value").cast("string"))
    files.write_as(table(spark, sf_dir, "events").select("event_type", cell.alias("cell")), path, "csv")
    rows = files.read_csv_as_text(spark, path, ["event_type", "cell"])
    return rows.groupBy("event_type").agg(F.count_if(F.col("cell") == "None").alias("said_none"), F.count_if(F.col("cell") == "").alias("said_nothing"),
                                          r(F.sum(F.col("cell").try_cast("double")), 4).alias("total"))


@query("S4 L3", q.select(q.CELL_RESULTS + ", cells AS (SELECT 'scores' AS artifact, 1 AS col_no, seed::DOUBLE AS found, series_id || ',' || seed || ',' || model AS line FROM results "
       "UNION ALL SELECT 'scores', 3, nrmse, series_id || ',' || seed || ',' || model FROM results UNION ALL SELECT 'deep/errors', 2, mae, model || ',' || series_id FROM results UNION ALL SELECT 'deep/errors', 3, rmse, model || ',' || series_id FROM results), "
       "hits AS (SELECT *, abs(found - 1.02::DOUBLE) / 1.02::DOUBLE AS rel FROM cells)", "SELECT artifact, col_no, round(found, 6) AS found, round(rel, 6) AS rel FROM hits WHERE rel <= 0.05 ORDER BY rel, artifact, col_no, line LIMIT 12"))
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number looked up in every CSV below a folder, with file and column, nearest first."""
    root = scratch(spark)
    rows = cell_results(spark, sf_dir)
    files.write_as(rows.select("series_id", "seed", "model", "nrmse"), f"{root}/scores", "csv")
    files.write_as(rows.select("model", "series_id", "mae", "rmse"), f"{root}/deep/errors", "csv")
    hits = files.search_files(spark, root, 1.02, 0.05, limit=12)
    return hits.select(F.regexp_extract("path", r"/(scores|deep/errors)/", 1).alias("artifact"), "col_no", r("found").alias("found"), r("rel").alias("rel"))


@query("S5", q.select(_REG, "SELECT model_family, count(*) AS n_runs FROM runs GROUP BY 1"))
def registry_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tables that exist become views."""
    names = registry.register_views(spark, built_registry(spark, sf_dir, ("runs",)), "seen_")
    if names != ["seen_runs"]:
        raise AssertionError(names)
    return registry.query(spark, "SELECT model_family, count(*) AS n_runs FROM seen_runs GROUP BY model_family")


@query("S6 J2", q.select(_REG, "SELECT d.system, r.model, round(m.nrmse, 6) AS nrmse FROM runs r JOIN datasets d USING (dataset_id) JOIN metrics m USING (run_id) WHERE r.model = 'persistence' AND r.seed = 4"))
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the views with bound values."""
    registry.register_views(spark, built_registry(spark, sf_dir), "reg_")
    return registry.query(spark, """
        SELECT d.system, r.model, round(m.nrmse, 6) AS nrmse FROM reg_runs r
        JOIN reg_datasets d ON r.dataset_id = d.dataset_id JOIN reg_metrics m ON r.run_id = m.run_id
        WHERE r.model = :model AND r.seed = :seed""", model="persistence", seed=4)


@query("S7", q.select(_REG, "SELECT status, count(*) AS n_runs, 2 AS version FROM runs WHERE seed <> 0 GROUP BY 1"))
def atomic_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced while it is being read: the new version appears whole."""
    root = built_registry(spark, sf_dir, ("runs",))
    kept = registry.read_table(spark, root, "runs").where("seed <> 0")
    version = registry.replace_table(kept, root, "runs")
    return registry.read_table(spark, root, "runs").groupBy("status").agg(
        F.count(F.lit(1)).alias("n_runs")).withColumn("version", F.lit(version).cast("long"))


@query("S8", q.select(q.CELL_RESULTS, "SELECT model, count(*) AS n_rows, round(avg(nrmse), 6) AS nrmse FROM results GROUP BY 1"))
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished cells appended batch by batch (a batch per half of the week)."""
    path = scratch(spark)
    rows = cell_results(spark, sf_dir).select(*CELL, "model", "nrmse")
    for batch in ("seed < 3", "seed >= 3"):
        files.append_log(rows.where(batch), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("nrmse")).alias("nrmse"))


@query("S9", q.select(q.CELL_FORECASTS, "SELECT series_id, model, seed, count(*) AS n_rows, round(sum(y_pred - y_true), 6) + 0.0 AS bias FROM forecasts GROUP BY 1, 2, 3"))
def forecast_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts in one folder per (series, model, seed), read back from the folder names."""
    path = scratch(spark)
    files.write_forecasts(cell_forecasts(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("series_id", "model", F.col("seed").cast("long").alias("seed")).agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.sum(F.col("y_pred") - F.col("y_true"))).alias("bias"))


@query("S10", "SELECT codec, count(*) AS n_rows, round(avg(l_extendedprice), 4) AS price FROM lineitem CROSS JOIN (SELECT unnest(['csv', 'snappy', 'zstd']) AS codec) GROUP BY 1")
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items under three codecs, then one column read from each."""
    root = scratch(spark)
    rows = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    out = None
    for codec, fmt, comp in (("csv", "csv", None), ("snappy", "parquet", "snappy"), ("zstd", "parquet", "zstd")):
        files.write_as(rows, f"{root}/{codec}", fmt, comp)
        back = files.read_csv(spark, f"{root}/{codec}") if fmt == "csv" else spark.read.parquet(f"{root}/{codec}")
        got = back.select("l_extendedprice").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("l_extendedprice"), 4).alias("price")).withColumn("codec", F.lit(codec))
        out = got if out is None else out.unionByName(got)
    return out
