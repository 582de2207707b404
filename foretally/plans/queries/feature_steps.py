"""Series preparation and feature queries."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretally.operators import windows as win
from foretally.operators.blocks import KEYS, attach
from foretally.operators.matrices import project, right_vectors
from foretally.operators.recursion import leaky
from foretally.operators.reservoir import ReservoirConfig, reservoir_map, reservoir_summary, reservoir_weights
from foretally.operators.scaling import Chain, fit_scaler, make_scaler, scale, unscale
from foretally.operators.split import label_split, split_bounds, thin
from foretally.plans.catalogue import query, r, r_signed
from foretally.plans.frames import labelled_types
from foretally.plans.queries import sqltext as q
from foretally.sources.tables import panel_by_type, panel_by_user, panel_daily, table

_LABELLED = f"{q.TYPE}, {q.bounds()}, {q.labelled()}"

_PARAMS = {
    "minmax": "min(CASE WHEN in_fit THEN x END) AS shift, max(CASE WHEN in_fit THEN x END) - min(CASE WHEN in_fit THEN x END) AS scale",
    "standard": "avg(CASE WHEN in_fit THEN x END) AS shift, stddev_pop(CASE WHEN in_fit THEN x END) AS scale",
    "robust": "quantile_cont(CASE WHEN in_fit THEN x END, 0.5) AS shift, quantile_cont(CASE WHEN in_fit THEN x END, 0.75) - "
              "quantile_cont(CASE WHEN in_fit THEN x END, 0.25) AS scale",
}


def _scaled_sql(kind: str) -> str:
    return (f"{_LABELLED}, params AS (SELECT series_id, {_PARAMS[kind]} FROM labelled GROUP BY 1), "
            f"scaled AS (SELECT l.*, (x - shift) / CASE WHEN scale = 0 THEN 1 ELSE scale END AS u "
            f"FROM labelled l JOIN params USING (series_id))")


def _scaler_query(spark, sf_dir, kind):
    rows = labelled_types(spark, sf_dir)
    return scale(rows, fit_scaler(rows, kind)).select("series_id", "t", r("u").alias("u"))


@query("F1", q.select(_scaled_sql("minmax"), "SELECT series_id, t, round(u, 6) + 0.0 AS u FROM scaled"))
def minmax_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaler_query(spark, sf_dir, "minmax")


@query("F2 W6", q.select(_scaled_sql("standard"), "SELECT series_id, t, round(u, 6) + 0.0 AS u FROM scaled"))
def standard_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaler_query(spark, sf_dir, "standard")


@query("F3", q.select(_scaled_sql("robust"), "SELECT series_id, t, round(u, 6) + 0.0 AS u FROM scaled"))
def robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaler_query(spark, sf_dir, "robust")


@query("F4", q.select(q.TYPE, "SELECT series_id, t, round(x, 6) + 0.0 AS minmax_back, round(x, 6) + 0.0 AS standard_back, "
                              "round(x, 6) + 0.0 AS robust_back FROM series"))
def scaling_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scaler undone again gives the series back."""
    rows = labelled_types(spark, sf_dir)
    out = rows
    for kind in ("minmax", "standard", "robust"):
        params = fit_scaler(rows, kind)
        out = unscale(scale(out, params), params, out=f"{kind}_back").drop("u")
    return out.select("series_id", "t", *[r(f"{k}_back").alias(f"{k}_back") for k in ("minmax", "standard", "robust")])


@query("F5", q.select(f"{_LABELLED}, " + ", ".join(
    f"p_{k} AS (SELECT series_id, {_PARAMS[k]} FROM labelled GROUP BY 1)" for k in ("minmax", "standard", "robust")),
    "SELECT 'identity' AS scaler, series_id, round(avg(x), 6) AS mean_u, round(max(x), 6) AS max_u FROM labelled GROUP BY 2 UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{k}', series_id, round(avg((x - shift) / scale), 6), round(max((x - shift) / scale), 6) "
        f"FROM labelled JOIN p_{k} USING (series_id) GROUP BY 2" for k in ("minmax", "standard", "robust"))))
def scaler_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaler choice as a table of steps, identity being the off level."""
    rows = labelled_types(spark, sf_dir)
    out = None
    for kind in ("identity", "minmax", "standard", "robust"):
        step = make_scaler(kind).fit(rows)
        part = step.transform(rows).groupBy("series_id").agg(
            r(F.avg("x")).alias("mean_u"), r(F.max("x")).alias("max_u")).withColumn("scaler", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("F6 D3", q.select(_scaled_sql("standard"),
       "SELECT series_id, segment, round(avg(u), 6) + 0.0 AS mean_u, round(stddev_pop(u), 6) AS std_u, count(*) AS n_rows "
       "FROM scaled GROUP BY 1, 2"))
def fit_on_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted step applied to all segments; only train rows shaped its parameters."""
    rows = labelled_types(spark, sf_dir)
    step = make_scaler("standard").fit(rows)
    return step.transform(rows).groupBy("series_id", "segment").agg(
        r(F.avg("x")).alias("mean_u"), r(F.stddev_pop("x")).alias("std_u"), F.count(F.lit(1)).alias("n_rows"))


@query("F7", q.select(
    _scaled_sql("robust") + ", p2 AS (SELECT series_id, min(CASE WHEN in_fit THEN u END) AS a, max(CASE WHEN in_fit THEN u END) AS b "
    "FROM scaled GROUP BY 1)", "SELECT series_id, t, round((u - a) / (b - a), 6) + 0.0 AS u, round(x, 6) AS back "
    "FROM scaled JOIN p2 USING (series_id)"))
def composed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust then min-max, identity skipped, and the inverse in reverse order."""
    rows = labelled_types(spark, sf_dir)
    chain = Chain(make_scaler("identity"), make_scaler("robust"), make_scaler("minmax")).fit(rows)
    there = chain.transform(rows).select("series_id", "block", "t", "x", F.col("x").alias("u"))
    return chain.inverse(there).select("series_id", "t", r("u").alias("u"), r("x").alias("back"))


@query("F8 W5", q.select(f"{q.TYPE}, {q.lagged(3, 2, 0, 'series')}",
       "SELECT series_id, t, round(d2, 6) AS tap0, round(d1, 6) AS tap1, round(d0, 6) AS tap2 FROM lagged"))
def delay_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three taps two steps apart, oldest first, left edge padded with the first value."""
    rows = win.delays(panel_by_type(spark, sf_dir), 3, 2)
    taps = win.taps_of(3, oldest_first=True)
    return rows.select("series_id", "t", *[r(c).alias(f"tap{i}") for i, c in enumerate(taps)])


@query("F9", q.select(f"{q.TYPE}, {q.lagged(1, 1, 3, 'series')}",
       "SELECT series_id, t, round(d0, 6) AS x, round(y, 6) AS y FROM lagged WHERE y IS NOT NULL"))
def supervised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.delays(panel_by_type(spark, sf_dir), 1, 1, horizon=3).where("y IS NOT NULL")
    return rows.select("series_id", "t", r("d0").alias("x"), r("y").alias("y"))


@query("F10", q.select(f"{_LABELLED}, {q.lagged(3, 2, 2)}, {q.parts(3, 2, 2)}",
       "SELECT series_id, t, part, round(d2, 6) AS d2, round(d1, 6) AS d1, round(d0, 6) AS d0, round(y, 6) AS y FROM parts WHERE part IS NOT NULL"))
def windowed_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.train_and_test(win.delays(labelled_types(spark, sf_dir), 3, 2, horizon=2), 3, 2, 2)
    return rows.select("series_id", "t", "part", *[r(c).alias(c) for c in ("d2", "d1", "d0", "y")])


@query("F11", q.select(f"{q.USER}, {q.lagged(3, 1, 0, 'series')}",
       "SELECT series_id, t, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM lagged "
       "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) = 1"))
def last_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delay vector of each series (a max over structs, not a sort)."""
    rows = win.delays(panel_by_user(spark, sf_dir), 3)
    last = rows.groupBy("series_id").agg(F.max(F.struct("t", "d0", "d1", "d2")).alias("w"))
    return last.select("series_id", "w.t", *[r(f"w.{c}").alias(c) for c in ("d0", "d1", "d2")])


_POLY = ["d0", "d1", "d2", "d0 * d0", "d1 * d1", "d2 * d2", "d0 * d1", "d0 * d2", "d1 * d2"]


@query("F12", q.select(f"{q.DAILY}, {q.lagged(3, 1, 0, 'series')}",
       "SELECT series_id, t, " + ", ".join(f"round({e}, 6) AS f{i}" for i, e in enumerate(_POLY)) + " FROM lagged"))
def polynomial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.delays(panel_daily(spark, sf_dir), 3)
    feats = win.squares(win.taps_of(3), interactions=True)
    return rows.select("series_id", "t", *[r(c).alias(f"f{i}") for i, c in enumerate(feats)])


@query("F13", "WITH f AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos, label < 6 AS in_fit "
              "FROM embeddings), p AS (SELECT pos, avg(CASE WHEN in_fit THEN v::DOUBLE END) AS m, stddev_pop(CASE WHEN in_fit THEN v::DOUBLE END) AS s FROM f GROUP BY 1) "
              "SELECT vec_id, pos, round((v::DOUBLE - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + 0.0 AS z FROM f JOIN p USING (pos)")
def feature_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-feature z-score of the embedding matrix; the first six classes are the fit scope."""
    long = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") < 6).alias("in_fit"), F.posexplode("embedding").alias("pos", "v"))
    long = long.select("vec_id", "in_fit", (F.col("pos") + 1).alias("pos"), F.col("v").cast("double").alias("v"))
    fit = F.when(F.col("in_fit"), F.col("v"))
    stats = long.groupBy("pos").agg(F.avg(fit).alias("m"), F.stddev_pop(fit).alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return long.join(stats, "pos").select("vec_id", "pos", r(z, 5).alias("z"))


@query("F14", "WITH RECURSIVE " + q.TYPE + ", runs AS (SELECT series_id, t, 0.3::DOUBLE * x AS r FROM series WHERE t = 0 UNION ALL "
              "SELECT s.series_id, s.t, 0.7::DOUBLE * runs.r + 0.3::DOUBLE * s.x FROM runs JOIN series s ON s.series_id = runs.series_id AND s.t = runs.t + 1) "
              "SELECT series_id, t, round(r, 6) AS r FROM runs")
def leaky_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaky(panel_by_type(spark, sf_dir), 0.3).select("series_id", "t", r("r").alias("r"))


@query("F15 C13", q.select(f"{q.DAILY}, rows AS (SELECT series_id, t, x AS a, x * x AS b FROM series), {q.lagged(1, 1, 0, 'rows', 'a')}",
       "SELECT series_id, t, " + ", ".join(
           f"round(coalesce(lag({c}, {j}) OVER w, first_value({c}) OVER w), 6) AS {c}{j}" for j in range(3) for c in ("a", "b"))
       + " FROM lagged WINDOW w AS (PARTITION BY series_id ORDER BY t)"))
def delay_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature row of the last three steps side by side."""
    rows = panel_daily(spark, sf_dir).withColumn("feats", F.array("x", F.col("x") * F.col("x")))
    stacked = win.delay_row(rows, ["feats"], 3).withColumn("flat", F.flatten("feats_lags"))
    names = [f"{c}{j}" for j in range(3) for c in ("a", "b")]
    return stacked.select("series_id", "t", *[r(F.col("flat")[i]).alias(n) for i, n in enumerate(names)])


def _mono_names(k: int, degree: int) -> list:
    from itertools import combinations_with_replacement
    out = ["1.0"] + [f"d{j}" for j in range(k)]
    for d in range(2, degree + 1):
        out += [" * ".join(f"d{j}" for j in c) for c in combinations_with_replacement(range(k), d)]
    return out


_UNIT = _scaled_sql("minmax")


def _unit_rows(spark, sf_dir, taps, horizon=0, stride=1):
    rows = labelled_types(spark, sf_dir)
    return win.delays(scale(rows, fit_scaler(rows, "minmax")), taps, stride, horizon, column="u")


@query("F16", q.select(f"{_UNIT}, {q.lagged(2, 1, 0, 'scaled', 'u')}",
       "SELECT series_id, t, " + ", ".join(f"round({e}, 6) + 0.0 AS f{i}" for i, e in enumerate(_mono_names(2, 3))) + " FROM lagged"))
def polynomial_delay_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit_rows(spark, sf_dir, 2)
    feats = win.monomials(win.taps_of(2), 3)
    return rows.select("series_id", "t", *[r(c).alias(f"f{i}") for i, c in enumerate(feats)])


@query("F17", q.select(f"{_UNIT}, {q.lagged(2, 1, 0, 'scaled', 'u')}, normed AS (SELECT series_id, t, sqrt(d0*d0 + d1*d1) + 1e-12 AS nm, "
                       "d0 / (sqrt(d0*d0 + d1*d1) + 1e-12) AS a, d1 / (sqrt(d0*d0 + d1*d1) + 1e-12) AS b FROM lagged)",
       "SELECT series_id, t, 1.0::DOUBLE AS f0, round(nm, 6) + 0.0 AS f1, round(a, 6) + 0.0 AS f2, round(b, 6) + 0.0 AS f3, "
       "round(a * a, 6) + 0.0 AS f4, round(a * b, 6) + 0.0 AS f5, round(b * b, 6) + 0.0 AS f6 FROM normed"))
def normed_delay_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit_rows(spark, sf_dir, 2)
    feats = win.normed_monomials(win.taps_of(2), 2)
    return rows.select("series_id", "t", *[r(c).alias(f"f{i}") for i, c in enumerate(feats)])


# fixed values: a closed-form weight table both engines can write down
SINE_WEIGHTS = [[round(math.sin(1.0 + 3 * i + j), 6) for j in range(3)] for i in range(4)]
SINE_BIAS = [round(math.cos(1.0 + i), 6) for i in range(4)]


@query("F18", q.select(f"{_UNIT}, {q.lagged(3, 1, 0, 'scaled', 'u')}",
       "SELECT series_id, t, " + ", ".join(
           "round(tanh(" + " + ".join(f"({w}::DOUBLE) * d{j}" for j, w in enumerate(ws)) + f" + ({b}::DOUBLE)), 6) + 0.0 AS h{i}"
           for i, (ws, b) in enumerate(zip(SINE_WEIGHTS, SINE_BIAS))) + " FROM lagged"))
def random_projection_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit_rows(spark, sf_dir, 3)
    feats = win.random_layer(win.taps_of(3), SINE_WEIGHTS, SINE_BIAS)
    return rows.select("series_id", "t", *[r(c).alias(f"h{i}") for i, c in enumerate(feats)])


@query("F19")
def recurrent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrent states of every type series for two seeds, summarised per series."""
    rows = labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax"))
    return reservoir_summary(scaled.select("series_id", "block", "t", "u"), (0, 1), ReservoirConfig(), column="u")


SMALL_STATE = ReservoirConfig(units=2, density=1.0, leak_rate=0.2)


def _state_sql() -> str:
    """Two units driven in order by a recursive query."""
    w_in, w, _ = reservoir_weights(SMALL_STATE, 0)
    step = [f"({1 - SMALL_STATE.leak_rate!r}::DOUBLE) * s{i} + ({SMALL_STATE.leak_rate!r}::DOUBLE) * tanh(({float(w_in[i, 0])!r}::DOUBLE) * u + ({float(w[i, 0])!r}::DOUBLE) * s0 + ({float(w[i, 1])!r}::DOUBLE) * s1)" for i in range(2)]
    return (f"states AS (SELECT series_id, -1::BIGINT AS t, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1 FROM scaled WHERE t = 0 UNION ALL "
            f"SELECT x.series_id, x.t, {step[0]}, {step[1]} FROM states s JOIN scaled x ON x.series_id = s.series_id AND x.t = s.t + 1)")


@query("F19", f"WITH RECURSIVE {_UNIT}, {_state_sql()} SELECT series_id, t, round(s0, 6) + 0.0 AS s0, round(s1, 6) + 0.0 AS s1 FROM states WHERE t >= 0")
def recurrent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states themselves, of a small reservoir."""
    rows = _unit_rows(spark, sf_dir, 1).select("series_id", "block", "t", "d0")  # a block is whole in its task
    out = lambda pdf, states, _: pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "t": pdf["t"].to_numpy(), "s0": states[:, 0], "s1": states[:, 1]})
    got = reservoir_map(rows, [0], out, "series_id string, t long, s0 double, s1 double", SMALL_STATE, columns=["d0"])
    return got.select("series_id", "t", r("s0").alias("s0"), r("s1").alias("s1"))


def _cheb_sql() -> list:
    z = lambda c: f"least(greatest(2 * {c} - 1, -0.999999::DOUBLE), 0.999999::DOUBLE)"
    base = [f"cos({j}::DOUBLE * acos({z(c)}))" for c in ("d0", "d1") for j in (1, 2)]
    out = ["1.0::DOUBLE", *base]
    out += [f"{base[a]} * {base[b]}" for a in range(4) for b in range(a, 4)]
    return out


@query("F20", q.select(f"{_UNIT}, {q.lagged(2, 1, 0, 'scaled', 'u')}",
       "SELECT series_id, t, " + ", ".join(f"round({e}, 6) + 0.0 AS f{i}" for i, e in enumerate(_cheb_sql())) + " FROM lagged"))
def chebyshev_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit_rows(spark, sf_dir, 2)
    feats = win.chebyshev(win.taps_of(2), 2)
    return rows.select("series_id", "t", *[r(c).alias(f"f{i}") for i, c in enumerate(feats)])


_VECTOR = ("vec AS (SELECT o_orderpriority AS series_id, o_orderdate AS day, round(sum(o_totalprice), 2) / 1000 AS c0, "
           "count(*)::DOUBLE AS c1, max(o_totalprice) / 1000 AS c2 FROM orders GROUP BY 1, 2), "
           "vpanel AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, c0, c1, c2 FROM vec)")


def vector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components per day and priority: order value, order count, largest order."""
    from foretally.operators.blocks import number_rows
    days = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("day")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1000).alias("c0"), F.count(F.lit(1)).cast("double").alias("c1"),
        (F.max("o_totalprice") / 1000).alias("c2"))
    return number_rows(days, ["series_id"], ["day"]).select("series_id", "block", "t", "c0", "c1", "c2")


@query("F21", q.select(_VECTOR, "SELECT series_id, t, " + ", ".join(
    f"round(coalesce(lag({c}, {j}) OVER w, first_value({c}) OVER w), 6) AS {c}_{j}" for j in range(2) for c in ("c0", "c1", "c2"))
    + " FROM vpanel WINDOW w AS (PARTITION BY series_id ORDER BY t)"))
def vector_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["c0", "c1", "c2"]
    rows = win.delay_row(vector_panel(spark, sf_dir), cols, 2)
    return rows.select("series_id", "t", *[r(F.col(f"{c}_lags")[j]).alias(f"{c}_{j}") for j in range(2) for c in cols])


@query("F22", q.select(_UNIT, "SELECT series_id, t, round(1.5::DOUBLE * 3.141592653589793::DOUBLE * u, 6) + 0.0 AS angle FROM scaled"))
def input_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_types(spark, sf_dir)
    scaled = scale(rows, fit_scaler(rows, "minmax"))
    return scaled.select("series_id", "t", r(win.angle(F.col("u"), 1.5)).alias("angle"))


@query("F23")
def low_rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-8 reconstruction of the embedding rows; the basis comes from the fit rows (first six classes)."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(1).alias("one"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))
    basis = right_vectors(rows.where("label < 6"), ["f"], ["one"], 8)
    width = F.size("f")
    # one row of 8 x width numbers: its size is fixed by the feature width, not by the data
    both = rows.join(F.broadcast(basis.select("one", "v")), "one")
    back = project(F.col("f"), F.col("v"), 8, width)
    err = F.aggregate(F.zip_with(F.col("f"), back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    size = F.aggregate("f", F.lit(0.0), lambda a, v: a + v * v)
    return both.select("label", err.alias("err"), size.alias("size")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), (1 - F.sum("err") / F.sum("size")).alias("kept_share"))


@query("F24", q.select(q.TYPE, "SELECT series_id, CAST((t - 50) / 3 AS BIGINT) AS t, round(x, 6) AS x FROM series WHERE t >= 50 AND (t - 50) % 3 = 0"))
def warmup_and_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up rows dropped and every third sample kept: the operator's own sampling step."""
    return thin(panel_by_type(spark, sf_dir), 50, 3).select("series_id", "t", r("x").alias("x"))


@query("P16", "SELECT vec_id, list_transform(embedding[1:3] || embedding[17:19] || embedding[33:35] || embedding[49:51], lambda v: round(v::DOUBLE, 6)) AS picked FROM embeddings")
def column_block_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 of each 16-wide block of the embedding row."""
    picked = win.column_block(F.col("embedding"), 16, 3, 4)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(picked, lambda v: r_signed(v.cast("double"))).alias("picked"))


@query("D2", q.select(f"{q.TYPE}, {q.lagged(2, 1, 0, 'series')}",
       "SELECT series_id, t, round(d0 - d1, 6) + 0.0 AS step, round(d0 * d1, 6) AS cross_term FROM lagged"))
def feature_map_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's feature map is a function of the delay columns; the engine does the rest."""
    feature_map = lambda taps: {"step": taps[0] - taps[1], "cross_term": taps[0] * taps[1]}
    rows = win.delays(panel_by_type(spark, sf_dir), 2)
    return rows.select("series_id", "t", *[r(c).alias(n) for n, c in feature_map(win.taps_of(2)).items()])
