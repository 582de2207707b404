"""Helpers shared by the corpus operators."""

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.session import durable

# lower-case ASCII letters only, as word rules say; other letters keep their case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# at most so many characters of text are worked on at once inside a task
CHUNK_CHARS = 1 << 19


def short_batches(spark, rows: int = 2000) -> None:
    """Send texts to Python in batches of at most so many rows (the session's default of
    10,000 is meant for rows of numbers)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(df: DataFrame, name: str) -> Column:
    """A column by its literal name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(texts: Iterable[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Cut a batch of texts (null: empty) into runs of bounded size; a longer text is a run of its own."""
    part, held = [], 0
    for text in texts:
        text = text or ""
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def worker_state(key: tuple, make: Callable):
    """An object that a Python worker keeps for its next tasks; one at a time, so bounded by
    the largest.  Functions sent to executors bring fresh globals with every task."""
    home = sys.modules.setdefault("foretally_worker_state", types.ModuleType("foretally_worker_state"))
    if getattr(home, "key", None) != key:
        home.key, home.value = None, None
        home.value = make()
        home.key = key
    return home.value


def drop_worker_state() -> None:
    """Let go of what an earlier job left in this Python worker."""
    home = sys.modules.get("foretally_worker_state")
    if home is not None:
        home.key, home.value = None, None


def trim(cache: dict, most: int) -> None:
    """Bound a cache: beyond ``most`` entries the half that came last goes.  Frequent units
    are met early, so the half that stays is the useful one."""
    if len(cache) > most:
        for unit in list(cache)[most // 2:]:
            del cache[unit]


def stamped(df: DataFrame) -> DataFrame:
    """Store ``df`` with ``_part`` (the task that wrote a row) and ``_seq`` (its place in it).

    Both are fixed once stored, so a task that runs again after a lost executor sees the
    same numbers.  No group of rows with one ``_part`` is larger than one task's input.
    """
    return durable(df.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))


def earlier_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each (keys, ``_part``): rows of the same keys in earlier parts, as ``_before``.

    The window holds one row per part, not per row.
    """
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Gapless position from 0 inside each key, for rows that carry ``_part`` and ``_seq``.

    Parts count in ascending order and rows inside a part by ``order``, so a key with any
    share of the rows is numbered by as many tasks as it has parts.  Keys may be null.
    """
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = rows.withColumn("_local", F.row_number().over(inside) - 1)
    offsets = earlier_parts(rows, keys)
    same = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["_part"] == offsets["_part"]]
    joined = local.join(offsets, same)
    kept = [local[c] for c in local.columns if c not in ("_local", "_part", "_seq")]
    return joined.select(*kept, (local["_local"] + offsets["_before"]).cast("long").alias(out))


def numbered_in_order(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Position from 0 inside each key in the order of ``order``; ties fall as they were stored.

    Rows are stored once, dealt out by ranges of (keys, order, place) and stored again with
    the range they fell in, so neither a hot key nor a value held by many rows is one task.
    """
    first = stamped(df).drop("_part")
    ranged = first.repartitionByRange(partitions(df.sparkSession), *keys, *order, "_seq")
    cut = durable(ranged.withColumn("_part", F.spark_partition_id()))
    return numbered(cut, keys, [*order, "_seq"], out)


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
               schema: str) -> DataFrame:
    """Run ``fn`` on each group of ``keys``, rows in ``order``; groups must be of bounded size.

    Like a grouped map, but one pass over sorted partitions, so that many tiny groups cost
    little: ``fn`` gets a frame of whole groups and returns one frame.
    """
    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held[keys].iloc[-1]
            same = pd.Series(True, index=held.index)
            for k in keys:
                same &= held[k].isna() if pd.isna(last[k]) else held[k] == last[k]
            if not same.all():
                yield fn(held[~same].reset_index(drop=True))
                held = held[same].reset_index(drop=True)
        if held is not None and len(held):
            yield fn(held)

    dealt = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)
