"""CSV scans, artifact search and result sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_csv_as_text(spark: SparkSession, path: str, columns) -> DataFrame:
    """CSV in which 'None' and empty cells stay text; cast the columns you need yourself."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    # an unquoted empty cell reads as the null marker, so it is put back as empty text
    return spark.read.csv(path, header=True, schema=schema).fillna("")


def search_files(spark: SparkSession, root: str, value: float, tol: float, limit: int = 6) -> DataFrame:
    """Numbers near ``value`` anywhere in the CSV files below ``root``, nearest first.

    Lines are read as text, so files with different headers are searched in one job; the
    header of a file is the line its number cells are named by.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))
    cells = lines.select("path", "line", F.posexplode(F.split("line", ",")).alias("col_no", "cell"))
    numbers = cells.select("path", "line", "col_no", F.col("cell").try_cast("double").alias("found"))
    rel = F.abs(F.col("found") - value) / max(abs(value), 1e-300)
    hits = numbers.where(F.col("found").isNotNull() & ~F.isnan("found")).withColumn("rel", rel).where(F.col("rel") <= tol)
    return hits.orderBy("rel", "path", "col_no", "line").limit(limit)


def append_log(df: DataFrame, path: str) -> None:
    """One batch of finished cells onto the log."""
    df.write.mode("append").parquet(path)


def write_forecasts(df: DataFrame, path: str) -> None:
    """One folder per (series, model, seed); a hot series is many files, never one task."""
    df.write.mode("overwrite").partitionBy("series_id", "model", "seed").parquet(path)


def write_as(df: DataFrame, path: str, fmt: str, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def replace_model_rows(table: DataFrame, rows: DataFrame, key=("system", "model")) -> DataFrame:
    """Drop the rows of the keys in ``rows`` and put ``rows`` in their place."""
    kept = table.join(rows.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)
