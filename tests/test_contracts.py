"""Contracts, registry writes, diffs and incremental work."""

import uuid

import pytest
from pyspark.sql import functions as F

from foretally.functions import text as tx
from foretally.operators import audit, contracts
from foretally.operators.split import split_bounds, oversized_washout
from foretally.sources import registry

RUN = dict(run_id="r1", dataset_id="d", split_id="s", model="m", model_family="ml", configuration_id="c", seed=0, forecast_mode="one_step",
           status="success", provenance_source="reconstructed", start_time=None, end_time=None, git_commit=None, environment_id=None, error_message=None)


def runs(spark, *rows):
    return spark.createDataFrame([tuple({**RUN, **r}[f] for f in contracts.SCHEMAS["runs"].names) for r in rows], contracts.SCHEMAS["runs"])


@pytest.mark.parametrize("change, rule", [
    ({"status": "completed"}, "status not a known word"), ({"seed": -1}, "seed out of range"), ({"dataset_id": None}, "dataset_id is null"),
    ({"git_commit": "abc"}, "reconstructed row claims execution facts"), ({"provenance_source": "captured"}, "captured row lacks execution facts")])
def test_bad_run_rows(spark, change, rule):
    assert [r["rule"] for r in contracts.registry_violations("runs", runs(spark, change)).collect()] == [rule]


def test_good_and_repeated_rows(spark):
    assert contracts.registry_violations("runs", runs(spark, {})).count() == 0
    assert [r["rule"] for r in contracts.registry_violations("runs", runs(spark, {}, {})).collect()] == ["key not unique"]


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="unknown column"):
        contracts.conform("runs", runs(spark, {}).withColumn("bogus", F.lit(1)))


def test_append_policies(spark, tmp_path):
    root = str(tmp_path / uuid.uuid4().hex)
    assert registry.read_table(spark, root, "runs").count() == 0
    assert registry.append_rows(spark, root, "runs", runs(spark, {}, {"run_id": "r2"})) == 2
    assert registry.append_rows(spark, root, "runs", runs(spark, {}, {"run_id": "r3"})) == 1
    with pytest.raises(ValueError, match="duplicate"):
        registry.append_rows(spark, root, "runs", runs(spark, {}), "error")
    assert registry.append_rows(spark, root, "runs", runs(spark, {"model": "new"}), "replace") == 1
    got = {r["run_id"]: r["model"] for r in registry.read_table(spark, root, "runs").collect()}
    assert got == {"r1": "new", "r2": "m", "r3": "m"}
    with pytest.raises(ValueError, match="contract"):
        registry.append_rows(spark, root, "runs", runs(spark, {"run_id": "r4", "seed": -1}))
    assert registry.current_version(spark, root, "metrics") == 0


GATE = dict(comparison_id="c", dataset_id="d", split_id="s", scaler_scope="train", horizon=1, n_features=10, seed_set="0-4", tuning_budget=50)


@pytest.mark.parametrize("change, rule", [
    ({"dataset_id": "e"}, "unequal dataset_id"), ({"split_id": "e"}, "unequal split_id"), ({"horizon": 2}, "unequal horizon"),
    ({"scaler_scope": "global"}, "scaler scope not train"), ({"n_features": 11}, "unmatched feature counts"),
    ({"seed_set": None}, "seed_set unequal or partly declared"), ({"tuning_budget": 60}, "tuning_budget unequal or partly declared"),
    ({"split_id": None}, "missing required field")])
def test_fairness_gate(spark, change, rule):
    schema = "comparison_id string, dataset_id string, split_id string, scaler_scope string, horizon long, n_features long, seed_set string, tuning_budget long"
    pair = lambda c: spark.createDataFrame([tuple(GATE.values()), tuple({**GATE, **c}.values())], schema)
    assert contracts.fairness_violations(pair({})).count() == 0
    assert rule in [r["rule"] for r in contracts.fairness_violations(pair(change)).collect()]
    assert contracts.fairness_violations(pair({"n_features": 11}), f_tolerance=1).count() == 0


def test_forecast_contract_lets_predictions_blow_up(spark):
    df = spark.createDataFrame([(0, 1.0, float("nan")), (1, 1.0, float("inf")), (-1, 1.0, 1.0), (2, float("nan"), 1.0)], "t long, y_true double, y_pred double")
    assert sorted(r["rule"] for r in contracts.violations(df, contracts.forecast_rules(), "t").collect()) == ["t", "y_true"]


def test_oversized_washout(spark):
    panel = spark.range(100).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    assert oversized_washout(split_bounds(panel, washout=100)).count() == 1
    assert oversized_washout(split_bounds(panel, washout=50)).count() == 0


@pytest.mark.parametrize("value, text", [(0.6, "0.6"), (1.0, "1"), (1e-6, "1e-06"), (0.0001, "0.0001"), (123456789012.0, "123456789012"),
                                         (1e12, "1e+12"), (-2.5, "-2.5"), (0.1 + 0.2, "0.3"), (0.0, "0"), (1234.5678901234567, "1234.56789012")])
def test_twelve_digit_text(spark, value, text):
    assert format(value, ".12g") == text
    assert spark.createDataFrame([(value,)], "v double").select(tx.g12(F.col("v"))).first()[0] == text


def test_tuple_text_is_never_evaluated(spark):
    got = spark.createDataFrame([("(0.6, __import__('os'), 0.2)",)], "s string").select(tx.number_list(F.col("s"))).first()[0]
    assert got == [0.6, None, 0.2]


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "u"), (2, 2.0, "v")], "k int, x double, s string")
    status = lambda b: audit.diff_tables(b, a, ["k"]).first()["status"]
    assert status(a) == "IDENTICAL"
    assert status(a.withColumn("x", F.col("x") * (1 + 1e-13))) == "EQUAL-TOL"
    assert status(a.withColumn("x", F.col("x") * 1.1)) == "DIFFERS"
    assert status(a.withColumn("s", F.lit("w"))) == "DIFFERS"
    assert status(a.limit(1)) == "DIFFERS"
    assert status(a.withColumn("x", F.col("x").cast("int").cast("string"))) == "EQUAL"


def test_sweep_isolates_a_failing_cell(spark):
    work = spark.createDataFrame([(i,) for i in range(4)], "cell int")

    def run_one(cell):
        if cell["cell"] == 2:
            raise RuntimeError("no")
        return {"score": 1.0}

    got = audit.run_cells(work, work.where("cell = 0"), ["cell"], run_one, "score double")
    row = audit.sweep_summary(work, got).first()
    assert (row["executed"], row["skipped"], row["failed"]) == (2, 1, 1)
    assert "no" in got.where("status = 'failed'").first()["error_message"]


def test_overwrite_guard(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert audit.guarded_write(df, path) == audit.guarded_write(df, path)
    df.withColumn("v", F.lit(9.0)).write.mode("overwrite").parquet(path)
    with pytest.raises(FileExistsError):
        audit.guarded_write(df, path)


def test_read_through_computes_only_what_is_missing_or_damaged(spark, tmp_path):
    import glob
    store, seen = str(tmp_path / "f"), []
    rows = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3), ("3", 4)], "key string, v int")

    def compute(missing):
        keys = {r["key"] for r in missing.select("key").collect()}
        if keys:
            seen.append(keys)
        return missing.select("key", (F.col("v") * 10).alias("f"))

    want = [("1", 10), ("2", 20), ("2", 30), ("3", 40)]
    rows_of = lambda df: sorted((r["key"], r["f"]) for r in df.collect())
    assert rows_of(audit.read_through(rows.where("key = '1'"), store, "key", compute)) == want[:1]
    assert rows_of(audit.read_through(rows, store, "key", compute)) == want
    assert seen == [{"1"}, {"2", "3"}]
    for file in glob.glob(f"{store}/data/key=2/*.parquet"):  # not to be read any more
        with open(file, "r+b") as f:
            f.truncate(20)
    assert rows_of(audit.read_through(rows, store, "key", compute)) == want and seen[2:] == [{"2"}]
    assert rows_of(audit.read_through(rows, store, "key", compute)) == want and len(seen) == 3
    # a job that broke off before it recorded its digest
    spark.createDataFrame([(99, "late")], "f int, _batch string").write.parquet(f"{store}/data/key=4")
    more = rows.union(spark.createDataFrame([("4", 5)], "key string, v int"))
    assert rows_of(audit.read_through(more, store, "key", compute)) == [*want, ("4", 50)] and seen[3:] == [{"4"}]
