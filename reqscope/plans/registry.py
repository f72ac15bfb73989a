"""Model registry by discovery (I9): built-in models, optional libraries, plug-ins; absent ones are skipped with a reason.

A model is a ``ModelSpec``: a name and a factory ``(seed, n_train) -> estimator`` whose
estimator fits a table with ``features``, ``label`` and ``weight`` and predicts a
``prediction`` column, so it runs in ``ml.ml_instances`` as it is. It is offered when
all modules it ``needs`` can be imported. Specs come from three places, in this order:

1. MLlib's models (``ml.model_registry``), which are always there;
2. the Spark estimators of two boosting libraries, with the parameters of the grid;
3. installed packages that declare an entry point of the group ``reqscope.models``, which
   loads to a spec, a list of specs, or a function that returns either.

A name that is taken already keeps its first model. What cannot be used (library absent,
plug-in that fails to load, name taken) is a row of ``report`` and never an error.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession

from . import ml

GROUP = "reqscope.models"


@dataclass(frozen=True)
class ModelSpec:
    name: str
    factory: Callable[[int, int], object]
    needs: tuple[str, ...] = ()
    seeded: bool = True  # a cross run is fitted once per seed


@dataclass
class Registry:
    """``models`` for ``ml_instances(registry=...)``, ``seeded`` for its parameter of that name, and what became of every spec."""

    models: dict[str, Callable[[int, int], object]] = field(default_factory=dict)
    seeded: set[str] = field(default_factory=set)
    rows: list[tuple[str, str, bool, str]] = field(default_factory=list)

    def add(self, spec: ModelSpec, source: str) -> None:
        reason = "the name is taken" if spec.name in self.models else _absent(spec.needs)
        self.rows.append((spec.name, source, not reason, reason))
        if not reason:
            self.models[spec.name] = spec.factory
            if spec.seeded:
                self.seeded.add(spec.name)

    def report(self, spark: SparkSession) -> DataFrame:
        """(model, source, available, reason): one row a spec or plug-in."""
        return spark.createDataFrame(self.rows, "model string, source string, available boolean, reason string")


def _absent(modules: Iterable[str]) -> str:
    """Why the modules cannot be used, or an empty text. A library that fails while it loads counts as absent."""
    for m in modules:
        try:
            importlib.import_module(m)
        except Exception as e:
            return f"{m}: {type(e).__name__}: {e}"
    return ""


def _xgboost(seed: int, n: int):
    from xgboost.spark import SparkXGBClassifier

    return SparkXGBClassifier(n_estimators=600, learning_rate=0.05, max_depth=6, subsample=0.9, colsample_bytree=0.9, reg_lambda=1.0,
                              eval_metric="logloss", random_state=seed, label_col="label", features_col="features")


def _lightgbm(seed: int, n: int):
    from synapse.ml.lightgbm import LightGBMClassifier

    return LightGBMClassifier(numIterations=600, learningRate=0.05, numLeaves=31, baggingFraction=0.9, featureFraction=0.9, seed=seed,
                              labelCol="label", featuresCol="features")


OPTIONAL = [
    ModelSpec("LightGBM", _lightgbm, ("synapse.ml.lightgbm",)),
    ModelSpec("XGBoost", _xgboost, ("xgboost.spark",)),
]


def _specs(loaded) -> list[ModelSpec]:
    if callable(loaded) and not isinstance(loaded, ModelSpec):
        loaded = loaded()
    specs = [loaded] if isinstance(loaded, ModelSpec) else list(loaded)
    wrong = [s for s in specs if not isinstance(s, ModelSpec)]
    if wrong:
        raise TypeError(f"not a ModelSpec: {wrong[0]!r}")
    return specs


def discover(optional: Iterable[ModelSpec] = OPTIONAL, group: str = GROUP, **sizes) -> Registry:
    """Every model that can be used here; ``sizes`` go to ``ml.model_registry``."""
    found = Registry()
    for name, factory in ml.model_registry(**sizes).items():
        found.add(ModelSpec(name, factory, seeded=name in ml.SEEDED), "mllib")
    for spec in optional:
        found.add(spec, "optional library")
    for point in sorted(metadata.entry_points(group=group), key=lambda p: (p.name, p.value)):
        try:
            specs = _specs(point.load())
        except Exception as e:
            found.rows.append((point.name, point.value, False, f"{type(e).__name__}: {e}"))
            continue
        for spec in specs:
            found.add(spec, point.value)
    return found
