"""Shared pieces of the cross-check SQL (common table expressions)."""

TYPE = ("series AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, "
        "value AS x FROM events)")
USER = ("series AS (SELECT CAST(user_id AS VARCHAR) AS series_id, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events)")
CELLS = ("series AS (SELECT event_type AS series_id, CAST(dayofweek(ts) AS BIGINT) AS seed, "
         "row_number() OVER (PARTITION BY event_type, dayofweek(ts) ORDER BY ts, event_id) - 1 AS t, value AS x FROM events)")
SUPPLIER = ("series AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY l_suppkey "
            "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t, "
            "l_extendedprice / 100000 AS x FROM lineitem)")
DAILY = ("days AS (SELECT o_orderpriority AS series_id, o_orderdate AS day, round(sum(o_totalprice), 2) / 1000 AS x "
         "FROM orders GROUP BY 1, 2), series AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, "
         "x FROM days)")


def bounds(keys: str = "series_id", washout: int = 20, fracs=(0.6, 0.2)) -> str:
    a, b = fracs
    return (f"bounds AS (SELECT {keys}, count(*) AS n, CAST(floor({a}::DOUBLE * count(*)) AS BIGINT) AS train_end, "
            f"CAST(floor(({a}::DOUBLE + {b}::DOUBLE) * count(*)) AS BIGINT) AS val_end, {washout} AS washout "
            f"FROM series GROUP BY {keys})")


def labelled(keys: str = "series_id") -> str:
    return (f"labelled AS (SELECT s.*, n, train_end, val_end, washout, CASE WHEN t < train_end THEN 'train' "
            f"WHEN t < val_end THEN 'validation' ELSE 'test' END AS segment, t >= washout AND t < train_end AS in_fit "
            f"FROM series s JOIN bounds b USING ({keys}))")


def lagged(taps: int, stride: int = 1, horizon: int = 1, source: str = "labelled", column: str = "x", keys: str = "series_id") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY t)"
    cols = [f"coalesce(lag({column}, {j * stride}) {w}, first_value({column}) {w}) AS d{j}" if j else f"{column} AS d0"
            for j in range(taps)]
    if horizon:
        cols.append(f"lead({column}, {horizon}) {w} AS y")
    return f"lagged AS (SELECT *, {', '.join(cols)} FROM {source})"


def parts(taps: int, stride: int = 1, horizon: int = 1) -> str:
    """Train and test rows of a windowed fit."""
    return (f"parts AS (SELECT *, CASE WHEN t >= greatest(washout, {(taps - 1) * stride}) AND t < train_end - {horizon} THEN 'train' "
            f"WHEN t >= val_end AND t < n - {horizon} THEN 'test' END AS part FROM lagged)")


def forecasts(keys: str = "series_id, seed", washout: int = 3) -> str:
    """Baseline forecasts of the test segment, long."""
    return ", ".join([
        bounds(keys, washout), labelled(keys), lagged(3, keys=keys),
        f"params AS (SELECT {keys}, avg(CASE WHEN in_fit THEN x END) AS mu, (max(CASE WHEN t = train_end - 1 THEN x END) - "
        f"max(CASE WHEN t = 0 THEN x END)) / max(train_end - 1) AS slope FROM labelled GROUP BY {keys})",
        f"base AS (SELECT l.*, mu, slope FROM lagged l JOIN params USING ({keys}) WHERE t >= val_end AND y IS NOT NULL)",
        f"forecasts AS (SELECT {keys}, 'persistence' AS model, t, y AS y_true, d0 AS y_pred FROM base UNION ALL "
        f"SELECT {keys}, 'train_mean', t, y, mu FROM base UNION ALL "
        f"SELECT {keys}, 'moving_average', t, y, (d0 + d1 + d2) / 3 FROM base UNION ALL "
        f"SELECT {keys}, 'drift', t, y, d0 + slope FROM base)"])


METRICS = ("sqrt(avg((y_pred - y_true)^2)) / stddev_pop(y_true) AS nrmse, sqrt(avg((y_pred - y_true)^2)) AS rmse, "
           "avg(abs(y_pred - y_true)) AS mae, avg((y_pred - y_true)^2) AS mse, "
           "1 - avg((y_pred - y_true)^2) / var_pop(y_true) AS r2, "
           "100 * avg(2 * abs(y_pred - y_true) / CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 1 ELSE abs(y_true) + abs(y_pred) END) AS smape, "
           "max(abs(y_pred - y_true)) AS max_error")


def results(keys: str = "series_id, seed") -> str:
    return f"results AS (SELECT {keys}, model, count(*) AS n_test, {METRICS} FROM forecasts GROUP BY {keys}, model)"


CELL_FORECASTS = f"{CELLS}, {forecasts()}"
CELL_RESULTS = f"{CELL_FORECASTS}, {results()}"
USER_FORECASTS = f"{USER}, {forecasts('series_id')}"
USER_RESULTS = f"{USER_FORECASTS}, {results('series_id')}"


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _sha(text: str, length: int = 16) -> str:
    return f"substr(sha256({text}), 1, {length})"


_FAMILY = ("CASE model WHEN 'drift' THEN 'ml' ELSE 'statistical' END")
REGISTRY = ", ".join([
    CELL_RESULTS,
    "content AS (SELECT series_id, seed, " + _sha("count(*) || ':' || CAST(sum(('0x' || substr(sha256(t || '|' || CAST(x AS VARCHAR)), 1, 15))::BIGINT) AS VARCHAR)")
    + " AS dataset_hash FROM series GROUP BY 1, 2)",
    "w0 AS (SELECT r.*, n, train_end, val_end, dataset_hash, CASE WHEN model = 'drift' THEN 'global' ELSE 'train' END AS scope, "
    + _sha("""'{"contract":"dataset/v1","random_seed":' || seed || ',"sample_count":' || n || ',"system":"' || series_id || '"}'""")
    + " AS dataset_id FROM results r JOIN bounds USING (series_id, seed) JOIN content USING (series_id, seed))",
    "w1 AS (SELECT *, "
    + _sha("""'{"contract":"split/v1","dataset_id":"' || dataset_id || '","horizon":1,"lookback":3,"scaler_fit_range":"' || scope || '","split_fracs":["0.6","0.2","0.2"],"washout":3}'""")
    + " AS split_id, "
    + _sha("""'{"alpha":"1e-06","horizon":1,"lookback":3,"model":"' || model || '","scaler_scope":"' || scope || '","seed":' || seed || '}'""")
    + " AS configuration_id, " + _sha("'[[0, ' || train_end || '], [' || train_end || ', ' || val_end || '], [' || val_end || ', ' || n || ']]'") + " AS split_hash FROM w0)",
    "w AS (SELECT *, " + _sha("dataset_id || '/' || split_id || '/' || configuration_id", 32) + f" AS run_id, {_FAMILY} AS model_family, "
    "CASE WHEN nrmse > 1.5 THEN 'failed' ELSE 'success' END AS status FROM w1)",
    "datasets AS (SELECT DISTINCT dataset_id, series_id AS system, '{\"source\":\"events\"}' AS system_parameters, seed AS random_seed, 'observed' AS integration_method, "
    "1.0::DOUBLE AS time_step, n AS sample_count, 0 AS transient_removed, dataset_hash FROM w)",
    "splits AS (SELECT DISTINCT split_id, dataset_id, 0 AS train_start, train_end, train_end AS validation_start, val_end AS validation_end, val_end AS test_start, n AS test_end, "
    "scope AS scaler_fit_range, 3 AS window_length, 1 AS prediction_horizon, split_hash FROM w)",
    "runs AS (SELECT run_id, dataset_id, split_id, model, model_family, configuration_id, seed, 'one_step' AS forecast_mode, status, 'reconstructed' AS provenance_source, "
    "CAST(NULL AS VARCHAR) AS git_commit, CASE WHEN status = 'failed' THEN 'score above 1.5' END AS error_message FROM w)",
    "metrics AS (SELECT run_id, nrmse, mae, 3.0::DOUBLE AS feature_count FROM w)"])
