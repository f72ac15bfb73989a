"""Registry by discovery: an optional library present and absent, plug-ins that load, fail or clash."""

import importlib
import sys

import pytest
from pyspark.ml.linalg import Vectors

from reqscope.plans import registry

LIBRARY = """
from pyspark.ml.classification import GBTClassifier
def SparkXGBClassifier(n_estimators, max_depth, random_state, label_col, features_col, **other):
    return GBTClassifier(maxIter=2, maxDepth=2, seed=random_state, labelCol=label_col, featuresCol=features_col)
"""
PLUGIN = """
from pyspark.ml.classification import LogisticRegression
from reqscope.plans.registry import ModelSpec
def models():
    return [ModelSpec("Logistic", lambda seed, n: LogisticRegression(labelCol="label"), seeded=False),
            ModelSpec("GBT", None), ModelSpec("Needy", None, ("no_such_library",))]
wrong = ["text"]
"""


@pytest.fixture
def installed(tmp_path, monkeypatch):
    """A folder on the path with a fake library and a fake installed plug-in."""
    (tmp_path / "xgboost").mkdir()
    (tmp_path / "xgboost" / "__init__.py").write_text("")
    (tmp_path / "xgboost" / "spark.py").write_text(LIBRARY)
    (tmp_path / "rq_plugin.py").write_text(PLUGIN)
    (tmp_path / "broken_lib.py").write_text("raise OSError('no shared object')")
    info = tmp_path / "rq_plugin-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: rq-plugin\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[reqscope.models]\na = rq_plugin:models\nb = rq_plugin:missing\nc = rq_plugin:wrong\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    importlib.invalidate_caches()
    yield
    for m in ("xgboost", "xgboost.spark", "rq_plugin", "broken_lib"):
        sys.modules.pop(m, None)


def test_absent_libraries_are_skipped_with_a_reason(spark):
    found = registry.discover([registry.ModelSpec("X", None, ("no_such_library.spark",))], group="no.such.group")
    assert set(found.models) == {"MultinomialNB", "LinearSVM", "RandomForest", "GBT"} and found.seeded == {"RandomForest", "GBT"}
    row = found.report(spark).where("not available").collect()
    assert [(r["model"], r["source"]) for r in row] == [("X", "optional library")] and "no_such_library" in row[0]["reason"]


def test_present_library_and_plugins(spark, installed):
    broken = registry.ModelSpec("Broken", None, ("broken_lib",))
    found = registry.discover([*registry.OPTIONAL, broken], num_trees=3)
    assert {"XGBoost", "Logistic"} <= set(found.models) and "LightGBM" not in found.models
    assert "XGBoost" in found.seeded and "Logistic" not in found.seeded
    why = {(r["model"], r["source"]): r["reason"] for r in found.report(spark).where("not available").collect()}
    assert why[("GBT", "rq_plugin:models")] == "the name is taken" and found.models["GBT"] is not None
    assert "no_such_library" in why[("Needy", "rq_plugin:models")] and "no shared object" in why[("Broken", "optional library")]
    assert "AttributeError" in why[("b", "rq_plugin:missing")] and "TypeError" in why[("c", "rq_plugin:wrong")]
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2), 1.0])) for i in range(20)], ["label", "features"])
    for name in ("XGBoost", "Logistic"):
        assert found.models[name](7, 20).fit(rows).transform(rows).where("label = prediction").count() == 20
