"""Session set-up and the durable checkpoint folder."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "foretally", partitions: int = 8) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster sets its own master."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")  # one BLAS thread per Python worker
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local master may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    A lost executor then re-reads stored rows and never recomputes the lineage, which
    matters wherever a recomputation could number or place rows differently, and saves
    work wherever several steps read the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []  # the tables written by this process, oldest first


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """Fills the list with the paths of the tables that ``durable`` writes in the block."""
    before, paths = len(_made), []
    try:
        yield paths
    finally:
        paths += _made[before:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Give back the space of tables that nothing will read again.  A frame that still refers
    to one fails with a missing file, it does not lose rows."""
    for path in paths:
        spark.createDataFrame([], "released int").coalesce(1).write.mode("overwrite").parquet(path)
