"""The four registry tables on storage: versioned, all-or-nothing replaces.

A replace writes a whole new version folder and then records it in a commit log; readers
only look at recorded versions, so a half-written one is never seen and the version being
read is never overwritten.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators import contracts
from foretally.session import durable

LOG = "table_name string, version long"


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{root}/_commits")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def current_version(spark: SparkSession, root: str, table: str) -> int:
    return _log(spark, root).where(F.col("table_name") == table).agg(F.max("version")).first()[0] or 0


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current version; an empty frame of the right columns when there is none."""
    if table not in contracts.SCHEMAS:
        raise ValueError(f"unknown table {table!r}; known: {sorted(contracts.SCHEMAS)}")
    version = current_version(spark, root, table)
    if not version:
        return spark.createDataFrame([], contracts.SCHEMAS[table])
    return spark.read.schema(contracts.SCHEMAS[table]).parquet(f"{root}/{table}/v{version}")


def replace_table(df: DataFrame, root: str, table: str) -> int:
    """Write ``df`` as the next version, then publish it."""
    spark = df.sparkSession
    version = current_version(spark, root, table) + 1
    df.write.mode("overwrite").parquet(f"{root}/{table}/v{version}")
    spark.createDataFrame([(table, version)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    return version


def append_rows(spark: SparkSession, root: str, table: str, rows: DataFrame, on_duplicate: str = "skip") -> int:
    """Append checked rows; an existing key is skipped, an error, or replaced.

    The whole batch is checked before anything is written.  Returns the rows written.
    """
    if on_duplicate not in ("skip", "error", "replace"):
        raise ValueError(f"unknown duplicate policy {on_duplicate!r}")
    key = contracts.KEYS[table]
    new = durable(contracts.conform(table, rows))  # checked, counted and written: computed once
    broken = contracts.registry_violations(table, new).limit(3).collect()
    if broken:
        raise ValueError(f"contract broken for {table}: {[tuple(r) for r in broken]}")
    existing = read_table(spark, root, table)
    if on_duplicate == "error":
        clash = new.join(existing, key, "left_semi").select(key).limit(3).collect()
        if clash:
            raise ValueError(f"duplicate {key} in {table}: {[r[0] for r in clash]}")
    if on_duplicate == "replace":
        existing = existing.join(new.select(key), key, "left_anti")
    else:
        new = new.join(existing.select(key), key, "left_anti")
    written = new.count()
    if written:
        replace_table(existing.unionByName(new), root, table)
    return written


def register_views(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """A temp view per table that has been written."""
    made = []
    for table in contracts.SCHEMAS:
        if current_version(spark, root, table):
            read_table(spark, root, table).createOrReplaceTempView(prefix + table)
            made.append(prefix + table)
    return made


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """SQL over the registered views; values are bound, never pasted into the text."""
    return spark.sql(text, args=args or None)
