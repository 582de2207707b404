"""Ordering work cut into blocks of bounded size.

Windows over a whole series (or a whole score column) put one key into one task.  These
helpers give the same answers with at most ``BLOCK_ROWS`` rows (plus a short halo) per
window partition:

* ``number_rows`` gives every row its position inside its key.
* ``with_halo`` copies the few edge rows a lag or lead needs into the next block.
* ``running_sums`` gives running totals by adding per-block totals.
* ``per_block`` repeats one row of per-series values for each block, so that joining it
  back never sends a whole series to one task.
"""

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.session import durable

# rows per block; a smaller value suits small executors (and the tests, which cut finely)
BLOCK_ROWS = int(os.environ.get("FORETALLY_BLOCK_ROWS", 1 << 17))

KEYS = ("series_id",)


def sorted_blocks(df: DataFrame, keys, order) -> DataFrame:
    """Add ``run``: an ordered slice number inside each key.

    Rows are range partitioned on (keys, order) into as many slices as the session has
    shuffle partitions.  The placement is stored, because the range bounds come from a
    sample and must not move when a task is run again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return durable(ranged.withColumn("run", F.spark_partition_id().cast("long")))


def running_sums(df: DataFrame, keys, order, sums: dict, run: str | None = None) -> DataFrame:
    """Running totals (this row included) of each expression in ``sums`` per key; the name
    ``run`` keeps the slice numbers under that name."""
    return sums_over(sorted_blocks(df, keys, order), keys, order, sums, "run", run)


def sums_over(cut: DataFrame, keys, order, sums: dict, slice_: str, keep: str | None = None) -> DataFrame:
    """Running totals over rows already cut into ordered slices: totals of the slices before
    plus a window inside the slice."""
    inside = (Window.partitionBy(*keys, slice_).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = cut.groupBy(*keys, slice_).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, slice_, *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    joined = cut.join(offsets, [*keys, slice_])
    out = joined.select("*", *[(F.sum(e).over(inside) + F.col(f"_o_{n}")).alias(n) for n, e in sums.items()])
    out = out.withColumnRenamed(slice_, keep) if keep else out.drop(slice_)
    return out.drop(*[f"_o_{n}" for n in sums])


def number_rows(df: DataFrame, keys, order, out: str = "t", block_rows: int = BLOCK_ROWS, stretch: Column | None = None) -> DataFrame:
    """Position of each row inside its key, from 0, and the block it falls in.

    ``stretch`` is a coarser form of the first order column (the hour of a time, say): rows
    are counted per stretch and numbered inside it, with no sampling and nothing stored.
    Without it they are cut by ranges of the order.
    """
    one = {out: F.lit(1).cast("long")}
    if stretch is None:
        numbered = running_sums(df, keys, order, one)
    else:
        numbered = sums_over(df.withColumn("_stretch", stretch), keys, order, one, "_stretch")
    numbered = numbered.withColumn(out, F.col(out) - 1)
    return numbered.withColumn("block", block_of(F.col(out), block_rows))


def block_of(t: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(t / F.lit(block_rows)).cast("long")


def with_halo(panel: DataFrame, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy edge rows so each block also holds ``before`` earlier and ``after`` later rows.

    ``home`` is true on a row's own copy; drop the others once the lag or lead is taken.
    """
    if before == 0 and after == 0:
        return panel.withColumn("home", F.lit(True))
    first = F.greatest(block_of(F.col("t") - after, block_rows), F.lit(0).cast("long"))
    last = block_of(F.col("t") + before, block_rows)
    copied = panel.withColumn("block", F.explode(F.sequence(first, last)))
    return copied.withColumn("home", F.col("block") == block_of(F.col("t"), block_rows))


def in_block(keys=KEYS) -> Window:
    return Window.partitionBy(*keys, "block").orderBy("t")


def per_block(params: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One copy of each series' row per block of that series; needs the length ``n``."""
    last = block_of(F.col("n") - 1, block_rows)
    return params.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def attach(panel: DataFrame, params: DataFrame, keys=KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bring per-series values to the rows, joined on (series, block) so that a series
    holding a third of all rows is still spread over many tasks."""
    return panel.join(per_block(params, block_rows), [*keys, "block"])


SALTS = 64


def spread_join(rows: DataFrame, values: DataFrame, keys, on: str = "t") -> DataFrame:
    """Join one value row per key back to the key's rows over SALTS sub-keys, so that a key
    with a third of all rows is not joined in one task.  ``on`` is a counting column."""
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.col(on), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def cogroup_blocks(rows: DataFrame, other: DataFrame, by, fn, schema: str) -> DataFrame:
    """Meet two frames group by group of ``by``; ``fn`` gets two pandas frames.

    The second frame's columns are renamed on the way in, as both often share a lineage.
    The number of partitions is stated: groups are few and small in bytes, the work on them
    is not, so they must not be put together by size.
    """
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *by)
    right = other.select(*[F.col(c).alias(f"r_{c}") for c in other.columns]).repartition(tasks, *[f"r_{c}" for c in by])
    plain = lambda a, b: fn(a, b.rename(columns=lambda c: c.removeprefix("r_")))
    return (rows.groupBy(*by).cogroup(right.groupBy(*[f"r_{c}" for c in by]))
            .applyInPandas(lambda a, b: plain(a, b), schema))
