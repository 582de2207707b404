"""Table diffs, value search and incremental work."""

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from foretally.functions.text import content_checksum
from foretally.session import durable

# fixed values: columns that differ from run to run and are left out of a diff
VOLATILE = ("data_generation_seconds", "validation_seconds", "transformation_seconds", "feature_generation_seconds",
            "training_seconds", "inference_seconds", "total_seconds", "peak_memory_mb", "wall_seconds",
            "rows_per_sec", "write_ms", "read_full_ms", "read_1col_ms", "speedup", "efficiency", "seconds",
            "start_time", "end_time", "created_at", "onestep_sec_per_step", "closedloop_sec_per_step")


def numeric_columns(df: DataFrame, leave_out=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in leave_out]


def long_numbers(df: DataFrame, key) -> DataFrame:
    """(key..., column_name, value) for every numeric column that is not a key."""
    key = list(key)
    cols = numeric_columns(df, key)
    return df.select(*key, *[F.col(c).cast("double") for c in cols]).unpivot(key, cols, "column_name", "value")


def relative_error(v: Column, target: Column) -> Column:
    return F.abs(v - target) / F.greatest(F.abs(target), F.lit(1e-300))


def value_search(df: DataFrame, key, value: Column, tol: float) -> DataFrame:
    """Cells of numeric columns within a relative error of ``value``, nearest first."""
    cells = long_numbers(df, key).where("value IS NOT NULL").withColumn("rel", relative_error(F.col("value"), value))
    return cells.where(F.col("rel") <= tol)


def match_quality(rel: Column) -> Column:
    return (F.when(rel == 0, "exact").when(rel <= 1e-12, "exact to double precision").otherwise("approximate"))


def diff_cells(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """(key..., column_name, a, b) of both tables' cells, full outer, volatile columns left out."""
    key = list(key)

    def cells(df, name):
        cols = [c for c in df.columns if c not in key and c not in VOLATILE]
        return df.select(*key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(key, cols, "column_name", name)

    on = [*key, "column_name"]
    left = cells(a, "a").withColumn("in_a", F.lit(True))
    right = cells(b, "b").withColumn("in_b", F.lit(True))
    return left.join(right, on, "full_outer")


def diff_tables(a: DataFrame, b: DataFrame, key, rtol: float = 1e-9) -> DataFrame:
    """One row: IDENTICAL, EQUAL (up to number text), EQUAL-TOL or DIFFERS, with the worst gap."""
    cells = diff_cells(a, b, key)
    x, y = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    rel = F.when(both & (x != y), F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-300)))
    text = ~both & ~F.col("a").eqNullSafe(F.col("b"))
    alone = F.col("in_a").isNull() | F.col("in_b").isNull()
    got = cells.agg(
        F.count_if(alone).alias("cells_one_side"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("cells_changed"),
        F.coalesce(F.max(rel), F.lit(0.0)).alias("max_rel"), F.count_if(text & ~alone).alias("text_changed"))
    status = (F.when((F.col("cells_one_side") > 0) | (F.col("text_changed") > 0) | (F.col("max_rel") > rtol), "DIFFERS")
              .when(F.col("max_rel") > 0, "EQUAL-TOL").when(F.col("cells_changed") > 0, "EQUAL").otherwise("IDENTICAL"))
    return got.withColumn("status", status)


def column_drift(a: DataFrame, b: DataFrame, key, floor: float = 1e-12) -> DataFrame:
    """Per numeric column: worst absolute gap, worst relative gap where the value is not
    about zero, and whether the column is about zero throughout."""
    key = list(key)
    left = long_numbers(a, key).withColumnRenamed("value", "a")
    right = long_numbers(b, key).withColumnRenamed("value", "b")
    both = left.join(right, [*key, "column_name"]).where("a IS NOT NULL AND b IS NOT NULL")
    gap, big = F.abs(F.col("a") - F.col("b")), F.abs("a") > floor
    return both.groupBy("column_name").agg(
        F.max(gap).alias("max_abs"),
        F.max(F.when(big, gap / F.abs(F.when(big, F.col("a"))))).alias("max_rel"),
        (~F.bool_or(big) & (F.max(gap) > 0)).alias("near_zero"))


def table_fingerprint(df: DataFrame) -> str:
    """Order-free checksum of a whole table."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)]
    row = content_checksum(df.withColumn("_all", F.lit(1)), ["_all"], parts).first()
    return row["checksum"] if row else "empty"


def exists(spark, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def guarded_write(df: DataFrame, path: str, allow_overwrite: bool = False) -> str:
    """Write unless the stored table no longer matches the fingerprint recorded beside it."""
    spark = df.sparkSession
    if exists(spark, path):
        mark = f"{path}.fingerprint"
        recorded = spark.read.text(mark).first()["value"] if exists(spark, mark) else "nothing"
        actual = table_fingerprint(spark.read.parquet(path))
        if recorded != actual and not allow_overwrite:
            raise FileExistsError(f"refusing to overwrite {path}: content {actual} is not the recorded {recorded}")
    df.write.mode("overwrite").parquet(path)
    mark = table_fingerprint(spark.read.parquet(path))
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.fingerprint")
    return mark


def pending(work: DataFrame, done: DataFrame, key) -> DataFrame:
    """Cells not finished yet."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def run_cells(work: DataFrame, done: DataFrame, key, run_one, schema: str, retries: int = 0) -> DataFrame:
    """Run every pending cell; a failing cell becomes a row with its error, not a failed job.

    ``run_one`` takes one cell as a dict and returns a dict of the fields in ``schema``.
    Cells are spread by key, and each is tried ``retries`` more times.
    """
    key = list(key)
    todo = pending(work, done, key)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema if f.name in key)
    names = [part.split()[0] for part in schema.split(",")]

    def attempt(batches):
        for pdf in batches:
            rows = []
            for cell in pdf.to_dict("records"):
                out, error = {}, None
                for _ in range(retries + 1):
                    try:
                        out, error = run_one(cell), None
                        break
                    except Exception as e:  # kept as a row
                        error = repr(e)
                rows.append({**{k: cell[k] for k in key}, **{n: out.get(n) for n in names},
                             "status": "failed" if error else "success", "error_message": error})
            yield pd.DataFrame(rows, columns=[*key, *names, "status", "error_message"])

    return todo.repartition(*key).mapInPandas(attempt, f"{key_fields}, {schema}, status string, error_message string")


def sweep_summary(work: DataFrame, results: DataFrame) -> DataFrame:
    """executed / skipped / failed counts of one sweep."""
    total = work.agg(F.count(F.lit(1)).alias("cells"))
    ran = results.agg(F.count_if(F.col("status") == "success").alias("executed"),
                      F.count_if(F.col("status") == "failed").alias("failed"))
    both = total.withColumn("_one", F.lit(1)).join(ran.withColumn("_one", F.lit(1)), "_one")
    return both.select("executed", (F.col("cells") - F.col("executed") - F.col("failed")).alias("skipped"), "failed")


def digests(rows: DataFrame, key: str) -> DataFrame:
    """key, _batch, rows, digest: an order-free sum of row hashes of each key's entry."""
    columns = sorted(c for c in rows.columns if c not in (key, "_batch"))
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(key, "_batch").agg(F.count(F.lit(1)).alias("rows"), total.alias("digest"))


def read_through(wanted: DataFrame, store: str, key: str, compute) -> DataFrame:
    """Rows of the wanted keys: stored entries are read, the others computed and stored.

    ``compute`` maps the missing keys' rows to feature rows that carry ``key``.  An entry
    counts only if its digest, recorded after its rows, is that of the rows found now: what a
    broken job left behind, and what was cut, changed or cannot be read any more, is a miss
    and is computed again under a new batch.  The key's values may not be null.
    """
    spark, data, book = wanted.sparkSession, f"{store}/data", f"{store}/digests"
    shape = compute(wanted.limit(0)).schema
    kept = StructType([*[f for f in shape if f.name != key], StructField("_batch", StringType()), shape[key]])

    def stored() -> DataFrame | None:
        if not exists(spark, book):
            return None
        tolerant = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return tolerant.schema(kept).parquet(data).join(wanted.select(key).distinct(), key, "left_semi")

    rows, good, missing = stored(), None, wanted
    if rows is not None:
        sound = digests(rows, key).join(spark.read.parquet(book), [key, "_batch", "rows", "digest"], "left_semi")
        good = durable(sound.groupBy(key).agg(F.max("_batch").alias("_batch")))
        missing = wanted.join(good, key, "left_anti")
    fresh = durable(compute(missing).withColumn("_batch", F.lit(uuid.uuid4().hex)))
    fresh.write.mode("append").partitionBy(key).parquet(data)
    digests(fresh, key).write.mode("append").parquet(book)
    out = fresh.select(*shape.names)
    return out if good is None else stored().join(good, [key, "_batch"], "left_semi").select(*shape.names).unionByName(out)
