"""Free-running forecasts: the prediction is fed back for a fixed number of steps.

One row per (series, model, seed) enters with its last taps and weights, so history is
bounded, and a batch of rows rolls forward together.  The work does not grow with the
length of the series.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_out(starts: DataFrame, steps: int, taps: int, keys, expand=None, dims: int = 1) -> DataFrame:
    """keys, step, y_pred (array of ``dims`` values for vector series).

    ``starts`` has ``window`` (newest first; for vectors tap after tap) and ``w`` (per
    output: feature weights, bias last).  A non-finite step repeats the previous value.
    """
    keys = list(keys)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in starts.schema if f.name in keys)
    value = "double" if dims == 1 else "array<double>"

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            hist = np.vstack([np.asarray(v, float) for v in pdf["window"]])
            w = np.vstack([np.asarray(v, float) for v in pdf["w"]]).reshape(len(pdf), dims, -1)
            for step in range(steps):
                with np.errstate(all="ignore"):
                    feats = expand(hist) if expand else hist
                    nxt = np.einsum("rof,rf->ro", w[:, :, :-1], feats) + w[:, :, -1]
                bad = ~np.isfinite(nxt).all(axis=1)
                nxt[bad] = hist[bad, :dims]
                hist = np.hstack([nxt, hist[:, :-dims]]) if taps > 1 else nxt.copy()
                yield pdf[keys].assign(step=step, y_pred=nxt[:, 0] if dims == 1 else list(nxt))

    return starts.select(*keys, "window", "w").mapInPandas(run, f"{key_fields}, step long, y_pred {value}")
