"""Evaluation over prediction rows: confusion, metrics, report, per-reason.

Everything reduces to the four additive confusion counts first (partial
aggregation before the shuffle), then the metrics are plain expressions on
the small aggregated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KEY4, METRICS
from ..functions.metrics import confusion_aggs, metric_columns
from ..functions.text import parse_reasons

RUN_KEYS = ["setting", "variant", "train_dataset", "test_dataset", "model", "seed"]


def confusion(df: DataFrame, keys, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Tn, fp, fn, tp and n per group."""
    return df.groupBy(*keys).agg(*confusion_aggs(y_true, y_pred), F.count(F.lit(1)).alias("n"))


def with_metrics(conf: DataFrame, digits: int | None = None) -> DataFrame:
    """D4a-g: append the seven metrics to a confusion-count table."""
    return conf.select("*", *metric_columns(digits))


def run_results(instances: DataFrame, keys=RUN_KEYS, digits: int | None = None) -> DataFrame:
    """One row per run with 7 metrics, confusion counts and ``n_test``."""
    conf = with_metrics(confusion(instances, keys), digits)
    return conf.select(*keys, *METRICS, "tn", "fp", "fn", "tp", F.col("n").alias("n_test"))


def confusion_cells(conf: DataFrame, keys) -> DataFrame:
    """2x2 matrix cells as (true_label, pred_label, n)."""
    return conf.select(
        *keys,
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (true_label, pred_label, cnt)"),
    )


def classification_report(conf: DataFrame, keys, digits: int = 4) -> DataFrame:
    """Per-class precision/recall/f1/support, accuracy, macro and weighted averages.

    One output row per (group, row_name); accuracy only fills ``f1`` and ``support``.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def div(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    p0, r0, f0, s0 = div(tn, tn + fn), div(tn, tn + fp), div(2 * tn, 2 * tn + fn + fp), tn + fp
    p1, r1, f1, s1 = div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn), tp + fn
    n = s0 + s1
    def row(ordinal, name, p, r, f, s):
        return F.struct(
            F.lit(ordinal).alias("ord"), F.lit(name).alias("row_name"), p.alias("precision"),
            r.alias("recall"), f.alias("f1"), s.alias("support"),
        )

    none = F.lit(None).cast("double")
    rows = F.array(
        row(0, "clear", p0, r0, f0, s0),
        row(1, "ambiguous", p1, r1, f1, s1),
        row(2, "accuracy", none, none, div(tp + tn, n), n),
        row(3, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row(4, "weighted avg", div(p0 * s0 + p1 * s1, n), div(r0 * s0 + r1 * s1, n), div(f0 * s0 + f1 * s1, n), n),
    )
    return conf.select(*keys, F.inline(rows)).select(
        *keys, "row_name",
        F.round("precision", digits).alias("precision"),
        F.round("recall", digits).alias("recall"),
        F.round("f1", digits).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def reason_performance(instances: DataFrame, keys=KEY4, reasons: str = "reasons", digits: int | None = None) -> DataFrame:
    """Metrics per (group, reason), pooling all seeds.

    A row counts once per distinct reason it carries (C6: ``array_distinct``
    + ``explode`` replaces a rescan per reason); rows without reasons drop
    out; an input without a reasons column gives an empty table.
    """
    if reasons not in instances.columns:
        return instances.sparkSession.createDataFrame([], ", ".join([f"{k} string" for k in keys] + ["reason string", "n bigint"] + [f"{m} double" for m in METRICS]))
    exploded = instances.select(*keys, "y_true", "y_pred", F.explode(F.array_distinct(parse_reasons(reasons))).alias("reason"))
    conf = confusion(exploded, list(keys) + ["reason"])
    return conf.select(*keys, "reason", "n", *metric_columns(digits))
