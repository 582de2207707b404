"""Forecast-comparison test queries."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretally.functions.pvalues import fisher_p, mann_whitney_p
from foretally.operators import bootstrap as boot
from foretally.operators import significance as sig
from foretally.operators.blocks import running_sums, spread_join
from foretally.operators.metrics import norms
from foretally.operators.quantiles import exact_quantiles
from foretally.plans.catalogue import query, r
from foretally.plans.frames import CELL, MODELS, cell_forecasts, cell_results, user_results
from foretally.plans.queries import sqltext as q
from foretally.plans.queries.forecasting import VECTOR, vector_forecasts
from foretally.plans.queries.scores import _vector_persistence
from foretally.session import durable
from foretally.sources.tables import table

_F, _R = q.CELL_FORECASTS, q.CELL_RESULTS
_L = f"{_F}, losses AS (SELECT *, (y_pred-y_true)^2 AS l FROM forecasts)"


def cell_losses(spark, sf_dir, kind="se") -> DataFrame:
    return sig.losses_wide(cell_forecasts(spark, sf_dir), MODELS, CELL, kind)


def cell_dm(spark, sf_dir, h: int = 1) -> DataFrame:
    return sig.pairwise_dm(cell_losses(spark, sf_dir), MODELS, CELL, h)


@query("T1", q.select(_F, "SELECT series_id, seed, model, t, round((y_pred-y_true)^2, 4) AS se, round(abs(y_pred-y_true), 6) AS ae FROM forecasts"))
def loss_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_forecasts(spark, sf_dir).select(*CELL, "model", "t", r(sig.loss("se"), 4).alias("se"), r(sig.loss("ae")).alias("ae"))


def _diff(m1: str, m2: str) -> str:
    return (f"d AS (SELECT a.series_id, a.seed, a.t, a.l - b.l AS d, a.l AS la, b.l AS lb FROM losses a JOIN losses b ON a.series_id = b.series_id AND a.seed = b.seed "
            f"AND a.t = b.t AND a.model = '{m1}' AND b.model = '{m2}')")


def _nw(lag: int, source: str = "d", keys: str = "series_id, seed") -> str:
    """Newey-West variance of the mean of column d of ``source``."""
    terms = " + ".join(["sum(c * c)"] + [f"2 * {1 - k / (lag + 1)}::DOUBLE * sum(c * coalesce(c{k}, 0))" for k in range(1, lag + 1)])
    lags = "".join(f", lag(c, {k}) OVER (PARTITION BY {keys} ORDER BY t) AS c{k}" for k in range(1, lag + 1))
    return (f"cen AS (SELECT *, d - avg(d) OVER (PARTITION BY {keys}) AS c FROM {source}), lg AS (SELECT *{lags} FROM cen), "
            f"nw AS (SELECT {keys}, count(*) AS n, avg(d) AS m, max(abs(d)) AS peak, greatest(avg(abs(la)), avg(abs(lb))) AS scale, "
            f"({terms}) / count(*) / count(*) AS v FROM lg GROUP BY {keys})")


@query("T2", q.select(f"{_L}, {_diff('persistence', 'moving_average')}, {_nw(2)}", "SELECT series_id, seed, n, round(v, 6) AS var_of_mean FROM nw"))
def newey_west_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the mean loss gap of two models with two Bartlett-weighted lags."""
    from foretally.operators.blocks import block_of, in_block, with_halo
    wide = cell_losses(spark, sf_dir).select(*CELL, "t", (F.col("l_0") - F.col("l_2")).alias("d"))
    rows = with_halo(wide.withColumn("block", block_of(F.col("t"))), 2, 0)
    w = in_block(CELL)
    rows = rows.select("*", F.lag("d", 1).over(w).alias("d1"), F.lag("d", 2).over(w).alias("d2")).where("home")
    n = F.count(F.lit(1))
    return rows.groupBy(*CELL).agg(n.alias("n"), r(sig.newey_west(F.col("d"), [F.col("d1"), F.col("d2")], n)).alias("var_of_mean"))


def _dm_sql(lag: int) -> str:
    hln = f"sqrt((n + 1 - {2 * lag} + {lag * (lag - 1)}::DOUBLE / n) / n)"
    return f"CASE WHEN scale = 0 OR peak <= 1e-12 * scale THEN 0 WHEN v <= 0 THEN NULL ELSE m / sqrt(v) * {hln} END"


@query("T3", q.select(f"{_L}, {_diff('persistence', 'moving_average')}, {_nw(2)}", f"SELECT series_id, seed, n, round({_dm_sql(2)}, 6) + 0.0 AS dm_stat FROM nw"))
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    dm = cell_dm(spark, sf_dir, h=3).where("model_i = 'persistence' AND model_j = 'moving_average'")
    return dm.select(*CELL, "n", r("dm_stat").alias("dm_stat"))


_PAIRS = ("d AS (SELECT a.series_id, a.seed, a.model AS model_i, b.model AS model_j, a.t, a.l - b.l AS d, a.l AS la, b.l AS lb FROM losses a JOIN losses b "
          "ON a.series_id = b.series_id AND a.seed = b.seed AND a.t = b.t AND a.model <> b.model)")
_ALL = f"{_L}, {_PAIRS}, {_nw(0, keys='series_id, seed, model_i, model_j')}, dm AS (SELECT series_id, seed, model_i, model_j, n, {_dm_sql(0)} AS dm_stat FROM nw)"


# two-sided p of Student's t with whole degrees of freedom as finite trigonometric sums
_TRIG = ("tr AS (SELECT *, n - 1 AS nu, atan(abs(dm_stat) / sqrt(n - 1)) AS th FROM dm), "
         "tp AS (SELECT * EXCLUDE (nu, th), 1 - CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2) * pow(cos(th), 2 * k) FOR k IN range(nu // 2)]) "
         "ELSE 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2)) * pow(cos(th), 2 * k) FOR k IN range((nu - 1) // 2)]), 0)) END AS dm_pval FROM tr)")
_SEEDS = ("os AS (SELECT series_id, model_i, model_j, avg(dm_stat) AS mean_dm, median(dm_pval) AS median_p, avg(CASE WHEN dm_pval < 0.05 THEN 1.0 ELSE 0.0 END) AS frac_seeds_sig "
          "FROM tp GROUP BY 1, 2, 3)")
_VERDICT = "CASE WHEN median_p < 0.05 THEN 'significant' WHEN median_p > 0.10 THEN 'NOT significant' ELSE 'borderline' END AS verdict"
_ALL_P = f"{_ALL}, {_TRIG}"


@query("T4", q.select(_ALL_P, "SELECT series_id, seed, model_i, model_j, round(dm_stat, 6) + 0.0 AS dm_stat, round(dm_pval, 9) AS dm_pval FROM tp"))
def diebold_mariano_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.with_p(cell_dm(spark, sf_dir)).select(*CELL, "model_i", "model_j", r("dm_stat").alias("dm_stat"), r("dm_pval", 9).alias("dm_pval"))


@query("T5 J8", q.select(_ALL, "SELECT series_id, seed, model_i, model_j, n, round(dm_stat, 6) + 0.0 AS dm_stat FROM dm "
                               "UNION ALL SELECT DISTINCT series_id, seed, model, model, n_test, 0.0::DOUBLE FROM (SELECT series_id, seed, model, count(*) AS n_test FROM forecasts GROUP BY 1, 2, 3)"))
def all_pairs_dm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordered model pair of every cell; the diagonal is 0."""
    dm = cell_dm(spark, sf_dir).select(*CELL, "model_i", "model_j", "n", r("dm_stat").alias("dm_stat"))
    sizes = dm.groupBy(*CELL, F.col("model_i")).agg(F.max("n").alias("n"))
    diagonal = sizes.select(*CELL, "model_i", F.col("model_i").alias("model_j"), "n", F.lit(0.0).alias("dm_stat"))
    return dm.unionByName(diagonal)


@query("T6", q.select(f"{_ALL_P}, {_SEEDS}", "SELECT series_id, model_i, model_j, round(mean_dm, 6) + 0.0 AS mean_dm, round(median_p, 6) AS median_p, round(frac_seeds_sig, 6) AS frac_seeds_sig FROM os"))
def dm_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sig.over_seeds(sig.with_p(cell_dm(spark, sf_dir)), ["series_id"])
    return got.select("series_id", "model_i", "model_j", *[r(c).alias(c) for c in ("mean_dm", "median_p", "frac_seeds_sig")])


@query("T6", q.select(_ALL, "SELECT series_id, model_i, model_j, round(avg(dm_stat), 6) + 0.0 AS mean_dm, count(*) AS n_seeds FROM dm GROUP BY 1, 2, 3"))
def dm_mean_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stat = F.nullif(F.col("dm_stat"), F.lit(float("nan")))
    return cell_dm(spark, sf_dir).groupBy("series_id", "model_i", "model_j").agg(r(F.avg(stat)).alias("mean_dm"), F.count(F.lit(1)).alias("n_seeds"))


@query("T7", q.select(_ALL, "SELECT series_id, model_i, " + ", ".join(
    f"coalesce(round(avg(CASE WHEN model_j = '{m}' THEN dm_stat END), 6), 0) + 0.0 AS {m}" for m in MODELS) + " FROM dm GROUP BY 1, 2"))
def dm_statistic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cell_dm(spark, sf_dir).groupBy("series_id", "model_i").pivot("model_j", list(MODELS)).agg(F.avg("dm_stat"))
    return got.select("series_id", "model_i", *[F.coalesce(r(m), F.lit(0.0)).alias(m) for m in MODELS])


@query("T7", q.select(f"{_ALL_P}, {_SEEDS}, sided AS (SELECT *, list_position({list(MODELS)}, model_i) > list_position({list(MODELS)}, model_j) AS lower_ FROM os)",
       "SELECT series_id, model_i, " + ", ".join(f"coalesce(round(max(CASE WHEN model_j = '{m}' THEN CASE WHEN lower_ THEN mean_dm ELSE median_p END END), 6), 0) + 0.0 AS {m}" for m in MODELS)
       + " FROM sided GROUP BY 1, 2"))
def dm_square_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangle the mean statistic, upper triangle the median p, zero diagonal."""
    got = sig.over_seeds(sig.with_p(cell_dm(spark, sf_dir)), ["series_id"])
    place = F.create_map(*[v for i, m in enumerate(MODELS) for v in (F.lit(m), F.lit(i))])
    lower = F.element_at(place, F.col("model_i")) > F.element_at(place, F.col("model_j"))
    cell = F.when(lower, F.col("mean_dm")).otherwise(F.col("median_p"))
    square = got.withColumn("v", cell).groupBy("series_id", "model_i").pivot("model_j", list(MODELS)).agg(F.max("v"))
    return square.select("series_id", "model_i", *[F.coalesce(r(m), F.lit(0.0)).alias(m) for m in MODELS])


@query("T8", q.select(_ALL, "SELECT model_i, model_j, round(min(dm_stat), 6) + 0.0 AS dm_min, round(median(dm_stat), 6) + 0.0 AS dm_median, round(max(dm_stat), 6) + 0.0 AS dm_max, count(*) AS n_tests "
                            "FROM dm WHERE (model_i, model_j) IN (('persistence', 'moving_average'), ('train_mean', 'moving_average')) GROUP BY 1, 2"))
def headline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.struct("model_i", "model_j").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in (("persistence", "moving_average"), ("train_mean", "moving_average"))])
    rows = durable(cell_dm(spark, sf_dir).where(pairs))
    ends = rows.groupBy("model_i", "model_j").agg(r(F.min("dm_stat")).alias("dm_min"), r(F.max("dm_stat")).alias("dm_max"), F.count(F.lit(1)).alias("n_tests"))
    # the number of cells grows with the panel, so the median comes from counted ranks
    mid = exact_quantiles(rows, ["model_i", "model_j"], "dm_stat", {"m": 0.5})
    return ends.join(mid, ["model_i", "model_j"]).select("model_i", "model_j", "dm_min", r("m").alias("dm_median"), "dm_max", "n_tests")


@query("T8", q.select(_ALL_P, "SELECT model_i, model_j, round(avg(CASE WHEN dm_pval < 0.10 THEN 1.0 ELSE 0.0 END), 6) AS frac_sig_10, round(avg(CASE WHEN dm_pval < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS frac_sig_05, "
                             "round(median(dm_stat), 6) + 0.0 AS median_dm, round(median(dm_pval), 6) AS median_p FROM tp WHERE model_j = 'moving_average' GROUP BY 1, 2"))
def headline_pair_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    dm = durable(sig.with_p(cell_dm(spark, sf_dir)).where("model_j = 'moving_average'"))
    by = ["model_i", "model_j"]
    share = lambda a: F.avg(F.when((F.col("dm_pval") < a) & ~F.isnan("dm_pval"), 1.0).otherwise(0.0))
    got = dm.groupBy(*by).agg(r(share(0.10)).alias("frac_sig_10"), r(share(0.05)).alias("frac_sig_05"))
    for value, name in (("dm_stat", "median_dm"), ("dm_pval", "median_p")):
        clean = dm.where(~F.isnan(value))
        got = got.join(exact_quantiles(clean, by, value, {name: 0.5}), by, "left")
    return got.select(*by, "frac_sig_10", "frac_sig_05", r("median_dm").alias("median_dm"), r("median_p").alias("median_p"))


@query("T9", q.select(_ALL_P, "SELECT series_id, seed, model_i, model_j, CASE WHEN dm_pval < 0.05 THEN 'significant' WHEN dm_pval > 0.10 THEN 'NOT significant' ELSE 'borderline' END AS verdict FROM tp"))
def verdict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.with_p(cell_dm(spark, sf_dir)).select(*CELL, "model_i", "model_j", sig.verdict(F.col("dm_pval")).alias("verdict"))


@query("T9", q.select(f"{_ALL_P}, {_SEEDS}", f"SELECT series_id, model_i, model_j, round(median_p, 6) AS median_p, {_VERDICT} FROM os"))
def headline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sig.over_seeds(sig.with_p(cell_dm(spark, sf_dir)), ["series_id"])
    return got.select("series_id", "model_i", "model_j", r("median_p").alias("median_p"), sig.verdict(F.col("median_p")).alias("verdict"))


@query("T10", q.select(_F + ", f2 AS (SELECT *, min(t) OVER (PARTITION BY series_id, seed) AS t0 FROM forecasts), ragged AS (SELECT * FROM f2 WHERE model <> 'moving_average' OR t >= t0 + 3), "
                       "num AS (SELECT *, row_number() OVER (PARTITION BY series_id, seed, model ORDER BY t DESC) - 1 AS step FROM ragged), "
                       "len AS (SELECT series_id, seed, min(m) AS common FROM (SELECT series_id, seed, model, count(*) AS m FROM ragged GROUP BY 1, 2, 3) GROUP BY 1, 2)",
       "SELECT series_id, seed, count(*) AS n_rows, max(common) AS common, round(max(gap), 9) AS max_gap FROM (SELECT series_id, seed, step, max(y_true) - min(y_true) AS gap, max(common) AS common FROM num JOIN len USING (series_id, seed) WHERE step < common GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def suffix_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model starts three steps late; the common last rows are kept and must agree."""
    fc = cell_forecasts(spark, sf_dir)
    starts = fc.groupBy(*CELL).agg(F.min("t").alias("t0"))
    ragged = spread_join(fc, starts, CELL).where("model <> 'moving_average' OR t >= t0 + 3").drop("t0")
    aligned = sig.align_suffix(ragged, CELL)
    gaps = sig.target_agreement(aligned, CELL)
    sizes = aligned.groupBy(*CELL).agg(F.count_distinct("step").alias("n_rows"))
    return sizes.join(gaps, list(CELL)).select(*CELL, "n_rows", F.col("n_rows").alias("common"), r("max_gap", 9).alias("max_gap"))


N_BOOT, BLOCK, N_RESAMPLES = 1000, 7, 10_000
_DRAW = "((((b * 7919 + j * 104729 + 12345 + {seed}) % 1000003) * 48271 % 2147483647) * 16807 % 2147483647) % n"
_STARTS = (f"sizes AS (SELECT series_id, seed, count(*) AS n FROM forecasts WHERE model = 'persistence' GROUP BY 1, 2), boots AS (SELECT unnest(range(0, {N_BOOT})) AS b), "
           f"starts0 AS (SELECT series_id, seed, n, b, unnest(range(0, CAST(ceil(n / {BLOCK}::DOUBLE) AS BIGINT))) AS j FROM sizes CROSS JOIN boots), "
           f"starts AS (SELECT *, {_DRAW.format(seed=0)} AS start, least({BLOCK}, n - j * {BLOCK}) AS width FROM starts0)")


@query("T11", q.select(f"{_F}, {_STARTS}", "SELECT series_id, seed, b, j, start, width FROM starts"))
def block_bootstrap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cell_losses(spark, sf_dir).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    got = boot.block_starts(cells, CELL, N_BOOT, BLOCK, boot.congruential_draw)
    return got.select(*CELL, "b", "j", "start", "width")


def _numbered_losses(spark, sf_dir) -> DataFrame:
    """Losses with t counted from 0 on the test segment."""
    wide = cell_losses(spark, sf_dir)
    start = wide.groupBy(*CELL).agg(F.min("t").alias("t0"))
    # stored: prefix sums, cell sizes and full means all read it
    return durable(spread_join(wide, start, CELL).withColumn("t", F.col("t") - F.col("t0")).drop("t0"))


@query("T12", q.select(f"{_L}, {_STARTS}, idx AS (SELECT series_id, seed, n, b, (start + unnest(range(0, width))) % n AS t FROM starts), "
                       "z AS (SELECT series_id, seed, model, t - min(t) OVER (PARTITION BY series_id, seed, model) AS t, l FROM losses), fm AS (SELECT series_id, seed, model, avg(l) AS m FROM losses GROUP BY 1, 2, 3)",
       "SELECT i.series_id, i.seed, z.model, i.b, round(avg(l) / max(f.m), 6) AS boot_over_full FROM idx i JOIN z ON i.series_id = z.series_id AND i.seed = z.seed AND i.t = z.t JOIN fm f ON f.series_id = z.series_id AND f.seed = z.seed AND f.model = z.model GROUP BY 1, 2, 3, 4"))
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap means relative to the full mean of each model."""
    cols = [f"l_{i}" for i in range(len(MODELS))]
    wide = _numbered_losses(spark, sf_dir)
    means = boot.block_means(wide, cols, CELL, N_BOOT, BLOCK, boot.congruential_draw)
    full = wide.groupBy(*CELL).agg(*[F.avg(c).alias(f"f_{c}") for c in cols])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), r(F.col(c) / F.col(f"f_{c}")).alias("boot_over_full")) for m, c in zip(MODELS, cols)]))
    return means.join(full, list(CELL)).select(*CELL, "b", each.alias("e")).select(*CELL, "e.model", "b", "e.boot_over_full")


def cell_mcs(spark, sf_dir, n_boot: int = 1000, block_length: int = 10, draw=boot.hash_draw) -> DataFrame:
    wide = _numbered_losses(spark, sf_dir)
    cols = [f"l_{i}" for i in range(len(MODELS))]
    means = boot.block_means(wide, cols, CELL, n_boot, block_length, draw)
    full = wide.groupBy(*CELL).agg(*[F.avg(c).alias(c) for c in cols])
    return boot.confidence_set(means, full, MODELS, CELL)


@query("T13")
def model_confidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_mcs(spark, sf_dir)


def _mcs_sql() -> str:
    """Rounds of elimination written out; each takes statistics of the models still in."""
    k = "series_id, seed"
    ctes = [
        "idx AS (SELECT series_id, seed, n, b, (start + unnest(range(0, width))) % n AS t FROM starts)",
        "z AS (SELECT series_id, seed, model, t - min(t) OVER (PARTITION BY series_id, seed, model) AS t, l FROM losses)",
        "fm AS (SELECT series_id, seed, model, avg(l) AS f FROM losses GROUP BY 1, 2, 3)",
        "bm AS (SELECT series_id, seed, model, b, avg(l) AS m FROM idx JOIN z USING (series_id, seed, t) GROUP BY ALL)",
        f"mv AS (SELECT {k}, model, b, m - f AS d, f FROM bm JOIN fm USING ({k}, model))",
        f"pr AS (SELECT {k}, x.model AS mi, y.model AS mj, b, x.d - y.d AS g, x.f - y.f AS h FROM mv x JOIN mv y USING ({k}, b) WHERE x.model <> y.model)",
        f"se AS (SELECT {k}, mi, mj, sqrt(var_samp(g)) AS s FROM pr GROUP BY ALL)",
        f"st AS (SELECT {k}, mi, mj, b, abs(g) / s AS drawn, abs(h) / s AS seen FROM pr JOIN se USING ({k}, mi, mj))",
        f"in1 AS (SELECT {k}, model FROM fm)"]
    for i in range(1, len(MODELS)):
        ctes += [f"g{i} AS (SELECT {k}, model, b, f - avg(f) OVER w AS h, d - avg(d) OVER w AS g FROM mv JOIN in{i} USING ({k}, model) WINDOW w AS (PARTITION BY {k}, b))",
                 f"o{i} AS (SELECT {k}, model FROM (SELECT {k}, model, max(h) / sqrt(var_samp(g)) AS t FROM g{i} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY t DESC) = 1)",
                 f"s{i} AS (SELECT {k}, b, max(drawn) AS drawn, max(seen) AS seen FROM st WHERE ({k}, mi) IN (FROM in{i}) AND ({k}, mj) IN (FROM in{i}) GROUP BY ALL)",
                 f"p{i} AS (SELECT {k}, avg((drawn >= seen)::INT) AS p FROM s{i} GROUP BY ALL)",
                 f"in{i + 1} AS (SELECT {k}, model FROM in{i} WHERE ({k}, model) NOT IN (FROM o{i}))"]
    rounds = " UNION ALL ".join([f"SELECT {k}, model, {i - 1} AS eliminated, p FROM o{i} JOIN p{i} USING ({k})" for i in range(1, len(MODELS))]
                                + [f"SELECT {k}, model, {len(MODELS) - 1}, 1.0 FROM in{len(MODELS)}"])
    return q.select(f"{_L}, {_STARTS}, " + ", ".join(ctes) + f", rounds AS ({rounds})",
                    f"SELECT {k}, model, eliminated, round(max(p) OVER (PARTITION BY {k} ORDER BY eliminated), 6) AS mcs_pvalue FROM rounds")


@query("T13", _mcs_sql())
def confidence_set_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of elimination and p-values, on draws that SQL can repeat."""
    got = cell_mcs(spark, sf_dir, N_BOOT, BLOCK, boot.congruential_draw)
    return got.select(*CELL, "model", "eliminated", r("mcs_pvalue").alias("mcs_pvalue"))


@query("T14")
def confidence_set_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_mcs(spark, sf_dir).groupBy("series_id", "model").agg(
        F.avg("mcs_pvalue").alias("mean_mcs_pvalue"), F.avg(F.col("in_set_10").cast("double")).alias("frac_in_set"))


@query("T15")
def vector_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM and confidence set on residual norms of two vector forecasts."""
    truth, pred = [f"t_{c}" for c in VECTOR], [f"p_{c}" for c in VECTOR]
    resid, _ = norms(truth, pred)
    ridge = vector_forecasts(spark, sf_dir).select("series_id", "t", resid.alias("e_ridge"))
    hold = _vector_persistence(spark, sf_dir).select("series_id", "t", resid.alias("e_hold"))
    wide = ridge.join(hold, ["series_id", "t"]).select("series_id", "t", (F.col("e_ridge") * F.col("e_ridge")).alias("l_0"), (F.col("e_hold") * F.col("e_hold")).alias("l_1"))
    names = ["ridge", "persistence"]
    dm = sig.with_p(sig.pairwise_dm(wide, names, ["series_id"])).where("model_i = 'ridge'").select("series_id", "dm_stat", "dm_pval")
    start = wide.groupBy("series_id").agg(F.min("t").alias("t0"))
    zero = durable(spread_join(wide, start, ["series_id"]).withColumn("t", F.col("t") - F.col("t0")).drop("t0"))
    means = boot.block_means(zero, ["l_0", "l_1"], ["series_id"], 1000, 10)
    full = wide.groupBy("series_id").agg(F.avg("l_0").alias("l_0"), F.avg("l_1").alias("l_1"))
    mcs = boot.confidence_set(means, full, names, ["series_id"]).where("model = 'ridge'").select("series_id", "mcs_pvalue", "in_set_10")
    return dm.join(mcs, "series_id")


_SCORE_PAIRS = (f"{_R}, sp AS (SELECT series_id, seed AS j, max(CASE WHEN model = 'moving_average' THEN nrmse END) AS a, max(CASE WHEN model = 'persistence' THEN nrmse END) AS b FROM results GROUP BY 1, 2), "
                f"boots AS (SELECT unnest(range(0, {N_RESAMPLES})) AS b), ")


def _resample_sql(value: str, stat: str, seed: int = 0, name: str = "") -> str:
    return (f"v{name} AS (SELECT series_id, j, {value} AS d FROM sp), sz{name} AS (SELECT series_id, count(*) AS n FROM v{name} GROUP BY 1), "
            f"dr{name} AS (SELECT series_id, b, j AS slot, {_DRAW.format(seed=seed)} AS pick FROM (SELECT series_id, n, b, unnest(range(0, n)) AS j FROM sz{name} CROSS JOIN boots)), "
            f"bs{name} AS (SELECT r.series_id, r.b, {stat}(v.d) AS s FROM dr{name} r JOIN v{name} v ON r.series_id = v.series_id AND r.pick = v.j GROUP BY 1, 2), "
            f"ci{name} AS (SELECT series_id, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM bs{name} GROUP BY 1)")


def score_pairs(spark, sf_dir) -> DataFrame:
    """Paired per-seed scores of two models; ``j`` numbers the seeds of a series."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("nrmse")))
    return cell_results(spark, sf_dir).groupBy("series_id", F.col("seed").alias("j")).agg(pick("moving_average").alias("a"), pick("persistence").alias("b"))


def _ci_rows(pairs, value, stat):
    got = boot.bootstrap_ci(pairs.withColumn("d", value), ["series_id"], "d", stat, N_RESAMPLES, draw=boot.congruential_draw)
    return got.select("series_id", "n_pairs", r("estimate").alias("estimate"), r("ci_lo").alias("ci_lo"), r("ci_hi").alias("ci_hi"), "excludes_zero")


def _ci_sql(value, stat):
    return q.select(_SCORE_PAIRS + _resample_sql(value, stat), f"SELECT series_id, count(*) AS n_pairs, round({stat}(d), 6) AS estimate, round(max(lo), 6) AS ci_lo, round(max(hi), 6) AS ci_hi, "
                    "max(lo) > 0 OR max(hi) < 0 AS excludes_zero FROM v JOIN ci USING (series_id) GROUP BY 1")


@query("T16", _ci_sql("a - b", "median"))
def paired_median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_rows(score_pairs(spark, sf_dir), F.col("a") - F.col("b"), "median")


@query("T16", _ci_sql("a - b", "avg"))
def paired_mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_rows(score_pairs(spark, sf_dir), F.col("a") - F.col("b"), "mean")


@query("T17", q.select(_SCORE_PAIRS + _resample_sql("a", "avg", 1, "a") + ", " + _resample_sql("b", "avg", 2, "b"),
       "SELECT series_id, round(quantile_cont(x.s - y.s, 0.025), 6) AS ci_lo, round(quantile_cont(x.s - y.s, 0.975), 6) AS ci_hi FROM bsa x JOIN bsb y USING (series_id, b) GROUP BY 1"))
def unpaired_mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is resampled on its own (two different draws)."""
    pairs = score_pairs(spark, sf_dir).select("series_id", "j", F.col("a").alias("score_a"), F.col("b").alias("score_b"))
    side = lambda c, seed: boot.resample_stats(pairs, ["series_id"], f"score_{c}", N_RESAMPLES, boot.congruential_draw, seed).select(
        "series_id", "b", F.col("mean").alias(f"m_{c}"))
    both = side("a", 1).join(side("b", 2), ["series_id", "b"])
    got = boot.interval(both.withColumn("stat", F.col("m_a") - F.col("m_b")), ["series_id"])
    return got.select("series_id", r("ci_lo").alias("ci_lo"), r("ci_hi").alias("ci_hi"))


@query("T18", _ci_sql("a / b", "median"))
def median_ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_rows(score_pairs(spark, sf_dir), F.col("a") / F.col("b"), "median")


@query("T23", _ci_sql("log10(a) - log10(b)", "median"))
def log_gap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_rows(score_pairs(spark, sf_dir), F.log10("a") - F.log10("b"), "median")


_TESTS = "pl AS (SELECT series_id, seed, model_i, model_j, dm_stat, dm_pval AS p FROM tp WHERE model_i < model_j)"


def tested_pairs(spark, sf_dir) -> DataFrame:
    return sig.with_p(cell_dm(spark, sf_dir)).where("model_i < model_j").select(*CELL, "model_i", "model_j", "dm_stat", F.col("dm_pval").alias("p"))


def _holm_sql(cap: bool) -> str:
    run = "max(adj)"
    body = "OVER (PARTITION BY series_id ORDER BY p, seed, model_i, model_j ROWS UNBOUNDED PRECEDING)"
    ranked = ("rk AS (SELECT *, (count(*) OVER (PARTITION BY series_id) - row_number() OVER (PARTITION BY series_id ORDER BY p, seed, model_i, model_j) + 1) * p AS adj FROM pl)")
    value = f"least(1.0::DOUBLE, {run} {body})" if cap else f"{run} {body}"
    return f"{ranked}, holm AS (SELECT *, {value} AS p_holm FROM rk)"


@query("T19 W3", q.select(f"{_ALL_P}, {_TESTS}, {_holm_sql(True)}", "SELECT series_id, seed, model_i, model_j, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM holm"))
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sig.holm(tested_pairs(spark, sf_dir), ["series_id"], "p", ["seed", "model_i", "model_j"])
    return got.select(*CELL, "model_i", "model_j", r("p").alias("p"), r("p_holm").alias("p_holm"))


@query("T20", q.select(f"{_ALL_P}, {_TESTS}, {_holm_sql(False)}", "SELECT series_id, count(*) AS family_size, round(max(p), 6) AS max_raw_p, round(max(p_holm), 6) AS max_adjusted_p, bool_and(p_holm < 0.05) AS all_significant FROM holm GROUP BY 1"))
def uncapped_holm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sig.holm(tested_pairs(spark, sf_dir), ["series_id"], "p", ["seed", "model_i", "model_j"], cap=False)
    return got.groupBy("series_id").agg(F.count(F.lit(1)).alias("family_size"), r(F.max("p")).alias("max_raw_p"), r(F.max("p_holm")).alias("max_adjusted_p"),
                                        F.bool_and(F.col("p_holm") < 0.05).alias("all_significant"))


def rank_sums(rows: DataFrame, keys, value: str, first) -> DataFrame:
    """Average-rank sums: keys, u (first sample), n1, n2, ties.  Equal values are counted
    before the running count, so ranks never need a group in one task."""
    keys = list(keys)
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(first).alias("c1"), F.count(F.lit(1)).alias("c"))
    ranked = running_sums(counts, keys, ["_v"], {"upto": F.col("c")})
    mid = F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    got = ranked.groupBy(*keys).agg(F.sum(F.col("c1") * mid).alias("r1"), F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n2"),
                                    F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    return got.select(*keys, (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n2", "ties")


_U = (f"{q.USER_RESULTS}, two AS (SELECT model, nrmse, model = 'moving_average' AS first FROM results WHERE model IN ('moving_average', 'persistence')), "
      "rk AS (SELECT *, rank() OVER (ORDER BY nrmse) + (count(*) OVER (PARTITION BY nrmse) - 1) / 2.0 AS rk FROM two)")


@query("T21", q.select(_U, "SELECT 'moving_average < persistence' AS test, round(sum(CASE WHEN first THEN rk END) - count_if(first) * (count_if(first) + 1) / 2.0, 3) AS u, CAST(count_if(first) AS BIGINT) AS n1, CAST(count_if(NOT first) AS BIGINT) AS n2 FROM rk"))
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_results(spark, sf_dir).where(F.col("model").isin("moving_average", "persistence")).withColumn("test", F.lit("moving_average < persistence"))
    return rank_sums(rows, ["test"], "nrmse", F.col("model") == "moving_average").select("test", r("u", 3).alias("u"), "n1", "n2")


@query("T21")
def mann_whitney_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided: are the cell scores of persistence the larger ones?"""
    rows = cell_results(spark, sf_dir).where(F.col("model").isin("moving_average", "persistence"))
    got = rank_sums(rows, ["series_id"], "nrmse", F.col("model") == "persistence")
    return got.withColumn("p", mann_whitney_p("u", "n1", "n2", "ties"))


_LOGP = "lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)"


@query("T22", "WITH n AS (SELECT lang, count_if(quality=1 AND toxic=1)::BIGINT AS a, count_if(quality=1 AND toxic=0)::BIGINT AS b, count_if(quality=0 AND toxic=1)::BIGINT AS c, "
              "count_if(quality=0 AND toxic=0)::BIGINT AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1), "
              "k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM n), "
              f"w AS (SELECT *, {_LOGP} - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp, "
              f"{_LOGP} - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS seen FROM k) "
              "SELECT lang, a, b, c, d, round(least(1, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)), 9) AS p FROM w GROUP BY 1, 2, 3, 4, 5")
def fisher_exact_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against toxicity, per language of the labelled documents."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    cell = lambda a, b: F.count_if((F.col("quality") == a) & (F.col("toxic") == b))
    counts = docs.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return counts.withColumn("p", r(fisher_p("a", "b", "c", "d"), 9))


@query("T22", "SELECT lang, CAST(count_if(quality=1 AND toxic=1) AS BIGINT) AS a, CAST(count_if(quality=1 AND toxic=0) AS BIGINT) AS b, CAST(count_if(quality=0 AND toxic=1) AS BIGINT) AS c, "
              "CAST(count_if(quality=0 AND toxic=0) AS BIGINT) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def two_by_two_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    cell = lambda a, b: F.count_if((F.col("quality") == a) & (F.col("toxic") == b))
    return docs.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))


@query("A34", q.select(f"{_ALL}, c AS (SELECT series_id, model_i, model_j, count(*) AS seeds, CAST(count_if(dm_stat > 0) AS BIGINT) AS first_worse, CAST(count_if(dm_stat < 0) AS BIGINT) AS first_better FROM dm WHERE model_i < model_j GROUP BY 1, 2, 3)",
       "SELECT *, CASE WHEN first_worse > first_better THEN 'second' WHEN first_better > first_worse THEN 'first' ELSE 'tied' END AS winner, first_worse = seeds OR first_better = seeds AS unanimous FROM c"))
def condition_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foretally.operators.tallies import condition_verdicts as verdicts
    return verdicts(tested_pairs(spark, sf_dir), ["series_id", "model_i", "model_j"])


@query("A35", q.select(f"{_ALL_P}, {_TESTS}, {_holm_sql(True)}",
       "SELECT series_id, count(*) AS n_tests, CAST(count_if(dm_stat > 0) AS BIGINT) AS first_worse, CAST(count_if(dm_stat < 0) AS BIGINT) AS first_better, round(count_if(dm_stat > 0) / count(*)::DOUBLE, 6) AS share_worse, "
       "CAST(count_if(p_holm < 0.05) AS BIGINT) AS significant, round(max(p_holm), 6) AS max_adjusted FROM holm GROUP BY 1"))
def family_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foretally.operators.tallies import family_report as report
    got = sig.holm(tested_pairs(spark, sf_dir), ["series_id"], "p", ["seed", "model_i", "model_j"]).groupBy("series_id").agg(*report("p_holm"))
    return got.select("series_id", "n_tests", "first_worse", "first_better", r("share_worse").alias("share_worse"), "significant", r("max_adjusted").alias("max_adjusted"))


@query("A42", q.select(f"{_R}, losses AS (SELECT *, (y_pred-y_true)^2 AS l FROM forecasts), {_PAIRS}, {_nw(0, keys='series_id, seed, model_i, model_j')}, "
                       f"dm AS (SELECT series_id, seed, model_i, model_j, n, {_dm_sql(0)} AS dm_stat FROM nw), {_TRIG}, {_SEEDS}, "
                       "b AS (SELECT series_id, avg(CASE WHEN model = 'moving_average' THEN nrmse END) AS first_nrmse, avg(CASE WHEN model = 'train_mean' THEN nrmse END) AS second_nrmse FROM results GROUP BY 1)",
                       "SELECT series_id, round(first_nrmse, 6) AS first_nrmse, round(second_nrmse, 6) AS second_nrmse, CASE WHEN first_nrmse < second_nrmse THEN 'moving_average' ELSE 'train_mean' END AS winner, "
                       f"round(median_p, 6) AS median_p, round(frac_seeds_sig, 6) AS frac_seeds_sig, {_VERDICT} FROM b JOIN os USING (series_id) WHERE model_i = 'moving_average' AND model_j = 'train_mean'"))
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, winner, median p, share significant and verdict of two models per series."""
    a, b = "moving_average", "train_mean"
    board = cell_results(spark, sf_dir).groupBy("series_id").agg(
        F.avg(F.when(F.col("model") == a, F.col("nrmse"))).alias("first_nrmse"), F.avg(F.when(F.col("model") == b, F.col("nrmse"))).alias("second_nrmse"))
    dm = sig.over_seeds(sig.with_p(cell_dm(spark, sf_dir)), ["series_id"]).where((F.col("model_i") == a) & (F.col("model_j") == b))
    winner = F.when(F.col("first_nrmse") < F.col("second_nrmse"), a).otherwise(b)
    return board.join(dm, "series_id").select("series_id", *[r(c).alias(c) for c in ("first_nrmse", "second_nrmse")], winner.alias("winner"),
                                              *[r(c).alias(c) for c in ("median_p", "frac_seeds_sig")], sig.verdict(F.col("median_p")).alias("verdict"))


@query("A42", q.select(f"{_R}, losses AS (SELECT *, (y_pred-y_true)^2 AS l FROM forecasts), {_PAIRS}, {_nw(0, keys='series_id, seed, model_i, model_j')}, dm AS (SELECT series_id, model_i, model_j, {_dm_sql(0)} AS dm_stat FROM nw), "
                "b AS (SELECT series_id, avg(CASE WHEN model = 'moving_average' THEN nrmse END) AS x, avg(CASE WHEN model = 'train_mean' THEN nrmse END) AS y FROM results GROUP BY 1)",
                "SELECT series_id, round(max(x), 6) AS first_nrmse, round(max(y), 6) AS second_nrmse, CASE WHEN max(x) < max(y) THEN 'moving_average' ELSE 'train_mean' END AS winner, round(avg(dm_stat), 6) + 0.0 AS mean_dm "
                "FROM b JOIN dm USING (series_id) WHERE model_i = 'moving_average' AND model_j = 'train_mean' GROUP BY 1"))
def head_to_head_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head-to-head without the p columns: scores, winner and mean statistic."""
    a, b = "moving_average", "train_mean"
    board = cell_results(spark, sf_dir).groupBy("series_id").agg(
        F.avg(F.when(F.col("model") == a, F.col("nrmse"))).alias("x"), F.avg(F.when(F.col("model") == b, F.col("nrmse"))).alias("y"))
    stat = F.nullif(F.col("dm_stat"), F.lit(float("nan")))
    dm = cell_dm(spark, sf_dir).where((F.col("model_i") == a) & (F.col("model_j") == b)).groupBy("series_id").agg(r(F.avg(stat)).alias("mean_dm"))
    return board.join(dm, "series_id").select("series_id", r("x").alias("first_nrmse"), r("y").alias("second_nrmse"), F.when(F.col("x") < F.col("y"), a).otherwise(b).alias("winner"), "mean_dm")
