"""Sharding by jump consistent hashing.

A stable key walks through pseudo-random jumps to its shard; the key and the number of
shards alone decide, there is no ring table, and when a shard is appended a row either
stays or moves into the new shard.  (Lamping and Veach, 2014.)

Null keys count as key 0.  Repeated rows share their key's shard.  Texts are never looked at, however long.  Integer keys are used
as they are, others by their 64-bit hash.  An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import column, numbered_in_order, unused

# fixed values of the published algorithm: the generator's multiplier, and 2^31
MULTIPLIER = 2862933555777941757
SPAN = 2147483648.0


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys of a batch jump at once until each passes the end."""
    state = keys.astype(np.uint64)
    at = np.full(state.size, -1, np.int64)
    ahead = np.zeros(state.size, np.int64)
    live = np.arange(state.size)
    while live.size:
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (SPAN / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a long column without nulls."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def walk(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return walk(key)


def key_number(df: DataFrame, key: str) -> Column:
    kind = dict(df.dtypes)[key]
    value = column(df, key)
    number = value.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(value)
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(number)


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(out, shard_of(key_number(df, key), shards))


def place_rows(df: DataFrame, key: str, shards: int, order: list[str]) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one more shard) and ``slot``: the place
    inside the shard in the order of ``order``, gapless from 0.

    A shard is numbered by many tasks (ranges of the order), so a shard of any size works.
    Columns of ``df`` with one of these names (in any letter case) stay, and the new one gets
    underscores behind its name.
    """
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.select(*[column(df, c).alias(n) for c, n in own.items()])
    placed = assign_shards(assign_shards(plain, own[key], shards), own[key], shards + 1, "grown_shard")
    done = numbered_in_order(placed, ["shard"], [own[c] for c in order], "slot")
    return done.select(*[F.col(n).alias(c) for c, n in own.items()], *[F.col(n).alias(unused(df, n)) for n in ("shard", "grown_shard", "slot")])


def write_shards(df: DataFrame, key: str, shards: int, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` as Parquet, one folder per shard; a shard is split over several writers."""
    name = unused(df, "shard")
    placed = assign_shards(df, key, shards, name)
    spread = placed.repartition(name, F.pmod(F.xxhash64(*[column(df, c) for c in df.columns]), F.lit(64)))
    spread.write.option("maxRecordsPerFile", rows_per_file).partitionBy(name).parquet(path)
