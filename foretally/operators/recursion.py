"""Recursions over time, cut into blocks.

A linear recursion ``s_t = A s_{t-1} + c x_t`` started from any state is the zero-start
result plus ``A^k`` times that state.  So each block runs on its own from zero, the block
end states are chained over the few block rows of a series, and each block is finished
from its true start.  No series has to fit into one task.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.operators.blocks import BLOCK_ROWS, KEYS, block_of
from foretally.session import durable

CHUNK = 64


def scan_line(m: np.ndarray, keep: float, start: float = 0.0) -> np.ndarray:
    """r_t = keep r_{t-1} + m_t, vectorised over chunks of fixed length."""
    n = len(m)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK)
    padded[:n] = m
    lag = np.subtract.outer(np.arange(CHUNK), np.arange(CHUNK))
    kernel = np.where(lag >= 0, float(keep) ** np.maximum(lag, 0), 0.0)
    local = padded.reshape(chunks, CHUNK) @ kernel.T
    decay = float(keep) ** np.arange(1, CHUNK + 1)
    carry, out = float(start), np.empty_like(local)
    for i in range(chunks):
        out[i] = local[i] + decay * carry
        carry = out[i, -1]
    return out.reshape(-1)[:n]


def block_starts(ends: DataFrame, keys, decay: list, state: list, carry_along=()) -> DataFrame:
    """Chain per-block end states: the state every block starts from (``carry_along``: further columns to keep).

    ``ends`` has one row per (series, block) with the zero-start end state and the block
    length; the fold below runs over those rows in block order, streamed batch by batch.
    """
    width = len(state)
    matrix = np.array(decay, dtype=float).reshape(width, width)
    names = list(state)
    typed = lambda kept: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.schema if f.name in kept)
    carry_along = list(carry_along)
    schema = f"{typed(keys)}, block long, " + "".join(f"{typed([c])}, " for c in carry_along) + ", ".join(f"start_{n} double" for n in names)

    def fold(batches):
        carry, last = None, None
        for pdf in batches:
            out = np.empty((len(pdf), width))
            key_rows = list(pdf[list(keys)].itertuples(index=False, name=None))
            values = pdf[names].to_numpy(float)
            sizes = pdf["m"].to_numpy()
            for i, key in enumerate(key_rows):
                if key != last:
                    carry, last = np.zeros(width), key
                out[i] = carry
                carry = np.linalg.matrix_power(matrix, int(sizes[i])) @ carry + values[i]
            res = pdf[[*keys, "block", *carry_along]].copy()
            for j, n in enumerate(names):
                res[f"start_{n}"] = out[:, j]
            yield res

    placed = ends.repartition(*keys).sortWithinPartitions(*keys, "block")
    return placed.mapInPandas(fold, schema)


def leaky(panel: DataFrame, eps: float, keys=KEYS, column: str = "x", out: str = "r") -> DataFrame:
    """Leaky integrator r_t = (1-eps) r_{t-1} + eps m_t with r before the start = 0."""
    keys = list(keys)
    keep = 1.0 - eps
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.assign(**{out: scan_line(eps * pdf[column].to_numpy(float), keep)})

    zero = durable(panel.groupBy(*keys, "block").applyInPandas(local, f"{fields}, {out} double"))  # read twice
    # powers of a contraction vanish, so a block's end state needs no second pass over rows
    ends = zero.groupBy(*keys, "block").agg(F.max_by(out, "t").alias("s"), F.count(F.lit(1)).alias("m"), F.min("t").alias("_t0"))
    starts = block_starts(ends, keys, [keep], ["s"], ["_t0"])
    rows = zero.join(starts, [*keys, "block"])
    power = F.pow(F.lit(keep), F.col("t") - F.col("_t0") + 1)
    return rows.withColumn(out, F.col(out) + power * F.col("start_s")).drop("start_s", "_t0")
