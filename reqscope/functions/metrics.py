"""Binary classification metrics as expressions over confusion counts (D3a, D4a-g).

All metrics are computed from the four mergeable counts tn, fp, fn, tp, so a
metric over any grouping is one partial + final aggregation: no row ever has
to meet another row of its group in one task. Undefined values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import METRICS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _d(col) -> Column:
    return _c(col).cast("double")


def confusion_aggs(y_true="y_true", y_pred="y_pred") -> list[Column]:
    """The four confusion counts (labels 0/1), as aggregate expressions."""
    t, p = _c(y_true), _c(y_pred)
    return [
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    ]


def _div(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def metric_exprs(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, Column]:
    """D4a-g: the seven metrics from confusion counts."""
    tn, fp, fn, tp = _d(tn), _d(fp), _d(fn), _d(tp)
    n = tn + fp + fn + tp
    pos, neg = tp + fn, tn + fp
    rec_pos, rec_neg = _div(tp, pos), _div(tn, neg)
    balanced = (
        F.when(pos == 0, rec_neg).when(neg == 0, rec_pos).otherwise((rec_pos + rec_neg) / 2.0)
    )
    prod = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(prod == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / F.sqrt(prod))
    po = _div(tp + tn, n)
    pe = _div((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    kappa = F.when((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn) == n * n, F.lit(None).cast("double")).otherwise(
        (po - pe) / (1.0 - pe)
    )
    return {
        "accuracy": _div(tp + tn, n),
        "balanced_accuracy": balanced,
        "precision": F.coalesce(_div(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(_div(tp, tp + fn), F.lit(0.0)),
        "f1": F.coalesce(_div(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)),
        "mcc": mcc,
        "cohen_kappa": kappa,
    }


def metric_columns(digits: int | None = None, **counts) -> list[Column]:
    """The seven metric columns, aliased, optionally rounded."""
    exprs = metric_exprs(**counts)
    out = []
    for m in METRICS:
        e = exprs[m]
        out.append((F.round(e, digits) if digits is not None else e).alias(m))
    return out
