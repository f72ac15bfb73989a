"""Partition-wise result writes (A10), result scans (A6) and the Spark ML registry."""

import tempfile

from pyspark.sql import functions as F

from reqscope.operators import evaluate
from reqscope.plans import classical, ml
from reqscope.sources import fixtures
from reqscope.sources.results import load_runs, save_runs

SF = "/root/testdata/sf0.001"


def test_save_runs_idempotent_and_partial(spark):
    res = evaluate.run_results(fixtures.instances(spark, SF))
    path = tempfile.mkdtemp(prefix="reqscope-results-", dir="/tmp") + "/runs"
    save_runs(res, path)
    n = res.count()
    assert load_runs(spark, path).count() == n
    # rewriting one run replaces only its partition
    one = res.where((F.col("model") == "google/flan-t5-small") & (F.col("seed") == 42))
    save_runs(one, path)
    assert load_runs(spark, path).count() == n
    got = load_runs(spark, path, models=["google/flan-t5-small"], settings=["intra"])
    assert got.count() == res.where((F.col("model") == "google/flan-t5-small") & (F.col("setting") == "intra")).count()
    assert set(r["model"] for r in got.select("model").distinct().collect()) == {"google/flan-t5-small"}


def test_tree_models_run_on_the_grid(spark):
    data = classical.ClassicalData(fixtures.requirements(spark, SF), seeds=[13, 42], materialize=True)
    reg = ml.model_registry(num_trees=5, gbt_iter=3)
    inst = ml.ml_instances(data, ["RandomForest", "GBT"], registry=reg)
    res = evaluate.run_results(inst)
    rows = res.collect()
    # 2 intra settings x 2 seeds + 2 cross settings x 2 seeds, x 3 variants, x 2 models
    assert len(rows) == 2 * 3 * (2 * 2 + 2 * 2)
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n_test"] for r in rows)
    assert inst.where(F.col("y_pred").isNull()).count() == 0
