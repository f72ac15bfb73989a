"""Batch scoring of a text table by a supplied scorer.

``mapInPandas`` hands each task Arrow batches; the scorer is built once per
task (a model load) and applied to whole batches of texts. The scorer is any
callable ``list[str] -> list[str]`` (generated answers) or ``list[str] ->
list[list[float]]`` (logits) made by a factory, so a pretrained model plugs in
without changing the plan. Answers are read back to labels with the verbaliser
(H6), logits with argmax (H11), both as JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TRIGGER_TERMS
from ..functions.text import argmax, build_prompt, text_to_label


def trigger_stub_scorer() -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in for a text-to-text model: 'yes' when a lexicon term occurs (case-insensitive)."""
    terms = [t.lower() for t in TRIGGER_TERMS]

    def score(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            low = p.lower()
            out.append("yes" if any(t in low for t in terms) else "no")
        return out

    return score


def trigger_stub_logits() -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for a classifier: the second class's logit is the number of lexicon terms that occur (case-insensitive)."""
    terms = [t.lower() for t in TRIGGER_TERMS]
    return lambda texts: [[1.0, float(sum(t in x.lower() for t in terms))] for x in texts]


def score_texts(df: DataFrame, keys, text: str, scorer_factory=trigger_stub_scorer, prompt: bool = True) -> DataFrame:
    """(keys..., pred_text) for every row; the prompt template (H7) is applied JVM-side first."""
    keys = list(keys)
    src = df.select(*keys, (build_prompt(text) if prompt else F.col(text)).alias("_in"))
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", pred_text string"

    def run(batches):
        scorer = scorer_factory()  # once per task
        for pdf in batches:
            texts = pdf["_in"].fillna("").tolist()
            out = pdf[keys].copy()
            out["pred_text"] = pd.Series(scorer(texts), index=pdf.index, dtype="object")
            yield out

    return src.mapInPandas(run, schema)


def score_logits(df: DataFrame, keys, text: str, scorer_factory=trigger_stub_logits) -> DataFrame:
    """(keys..., logits array<double>) for every row: a classifier's outputs, one list a text."""
    keys = list(keys)
    src = df.select(*keys, F.col(text).alias("_in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys) + ", logits array<double>"

    def run(batches):
        scorer = scorer_factory()  # once per task
        for pdf in batches:
            out = pdf[keys].copy()
            out["logits"] = pd.Series(scorer(pdf["_in"].fillna("").tolist()), index=pdf.index, dtype="object")
            yield out

    return src.mapInPandas(run, schema)


def predict_argmax(scored: DataFrame) -> DataFrame:
    """Logits -> label (the first of equal ones)."""
    return scored.withColumn("y_pred", argmax("logits"))


def predict_labels(scored: DataFrame) -> DataFrame:
    """H6: generated answer -> label."""
    return scored.withColumn("y_pred", text_to_label("pred_text").cast("int"))
